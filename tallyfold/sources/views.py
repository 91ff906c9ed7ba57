"""Temporary views over the stored tables, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.sources.readers import stored

TABLES = ("observations", "daily_snapshots", "library_adoption", "version_shares")


def register_views(spark: SparkSession, root: str) -> list[str]:
    """Create a view per stored table that exists; observations also show the
    file each row came from.  Returns the names of the views."""
    made = []
    for name in TABLES:
        rows = stored(spark, f"{root}/{name}")
        if rows is None:
            continue
        if name == "observations":
            rows = rows.withColumn("filename", F.col("_metadata.file_path"))
        rows.createOrReplaceTempView(name)
        made.append(name)
    return made


def query(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)
