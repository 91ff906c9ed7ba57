"""Landed inputs and stored tables as DataFrames."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from tallyfold.sources import runs
from tallyfold.sources.landed import valid_text

REPOS = (
    "full_name string, default_branch string, stargazers_count bigint, size bigint, "
    "created_at string, pushed_at string, topics array<string>"
)
LISTINGS = "full_name string, tree array<struct<type:string,path:string,size:bigint>>"
PACKAGES = "info struct<name:string,version:string,summary:string,requires_python:string>, releases map<string,string>"


def raw_documents(spark: SparkSession, root: str, max_bytes: int | None = None, skip_unreadable: bool = False) -> DataFrame:
    """Landed ``.ipynb`` files under ``root/<owner>/<repository>/``, found by listing the tree; where a listing is
    stored, :mod:`tallyfold.sources.landed` opens the same files by name.

    ``max_bytes`` leaves larger files out; it reaches the file listing, so they
    are not opened.  ``skip_unreadable`` passes over files that cannot be read,
    which otherwise are an error.  Bytes that are not UTF-8 become replacement
    characters.
    """
    skip = str(skip_unreadable).lower()
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.ipynb")
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", skip)
        .option("ignoreMissingFiles", skip)
        .load(root)
    )
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    below = F.split_part("path", F.lit(f"{root.rstrip('/')}/"), F.lit(-1))
    return files.select(
        F.array_join(F.slice(F.split(below, "/"), 1, 2), "/").alias("full_name"),
        F.regexp_replace(below, "^[^/]+/[^/]+/", "").alias("path"),
        F.col("length").alias("size_bytes"),
        valid_text(F.col("content")).alias("raw"),
    )


CONTENT_BUCKETS = 1024


def content_bucket(full_name: Column) -> Column:
    """The folder that the contents of a repository are stored in."""
    return F.pmod(F.crc32(full_name.cast("binary")), F.lit(CONTENT_BUCKETS)).cast("int")


def contents(spark: SparkSession, path: str) -> DataFrame:
    """Contents stored by ``sinks.write_contents``, with their ``bucket``."""
    schema = "full_name string, path string, size_bytes bigint, raw string, bucket int"
    return spark.read.schema(schema).parquet(path)


def with_repo_defaults(rows: DataFrame) -> DataFrame:
    """Repository metadata with main, 0, '' and [] for absent members."""
    return rows.select(
        "full_name",
        F.coalesce("default_branch", F.lit("main")).alias("default_branch"),
        F.coalesce("stargazers_count", F.lit(0)).cast("bigint").alias("stars"),
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size_kb"),
        F.coalesce("created_at", F.lit("")).alias("created_at"),
        F.coalesce("pushed_at", F.lit("")).alias("pushed_at"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
    )


def repos(spark: SparkSession, path: str) -> DataFrame:
    return with_repo_defaults(spark.read.schema(REPOS).json(path))


def flat_listing(listings: DataFrame) -> DataFrame:
    """One row per file of a repository listing; missing text is empty, size 0."""
    # the outer form: no inferred filter that would read the listing twice
    entries = listings.select("full_name", F.posexplode_outer("tree").alias("pos", "entry"))
    return entries.where(F.col("pos").isNotNull()).select("full_name", "entry.*").select(
        "full_name",
        F.coalesce("type", F.lit("")).alias("type"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.coalesce("size", F.lit(0)).alias("size"),
    )


def repo_files(spark: SparkSession, path: str) -> DataFrame:
    return flat_listing(spark.read.schema(LISTINGS).json(path))


def package_rows(packages: DataFrame) -> DataFrame:
    return packages.select("info.*", F.size(F.map_keys("releases")).alias("release_count"))


def packages(spark: SparkSession, path: str) -> DataFrame:
    return package_rows(spark.read.schema(PACKAGES).json(path))


def enrich(registry: DataFrame, metadata: DataFrame) -> DataFrame:
    """Registry with package metadata; packages that do not exist stay null."""
    return registry.join(metadata.withColumnRenamed("name", "pypi"), "pypi", "left")


def stored(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame | None:
    """A table that a run has stored, by the newest manifest beside it; else a plain Parquet folder; or, when there
    is neither, an empty table of the given schema (None without a schema).

    A run's table has the columns of all its versions, a plain one without a schema the merged columns
    of its files.  Columns that a file lacks are null.
    """
    rows = runs.read_table(spark, *runs.located(spark, path), as_schema(schema))
    if rows is not None:
        return rows
    if runs.unseen(spark, path):
        return None if schema is None else spark.createDataFrame([], schema)
    reader = spark.read.option("mergeSchema", "true") if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None if schema is None else spark.createDataFrame([], schema)


def as_schema(schema: StructType | str | None) -> StructType | None:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def with_date(schema: StructType) -> StructType:
    """A schema with the partition column."""
    if "date" in schema.names:
        return schema
    return StructType([*schema.fields, StructField("date", DateType())])


def observations(
    spark: SparkSession,
    root: str,
    run_date: date | None = None,
    schema: StructType | None = None,
    collection_type: str | None = None,
) -> DataFrame | None:
    """Stored observations of all dates, or of one, whose folders alone are listed."""
    if run_date is None:
        return stored(spark, root, None if schema is None else with_date(schema))
    base, state, table = runs.located(spark, root)
    days = state["tables"].get(table, {"days": {}})["days"]
    if schema is None and not any(run_date.isoformat() in days[mode] for mode in days if collection_type in (None, mode)):
        return None
    rows = runs.read_table(spark, base, state, table, schema, collection_type, [run_date])
    if rows is None:
        return spark.createDataFrame([], with_date(schema))
    return rows.where(F.col("date") == F.lit(run_date))
