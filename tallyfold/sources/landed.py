"""Landed files, read by name from a stored listing.

Listing a large tree is slow and leaves everything to the driver.  Here nothing
is listed: the listing of a run, or all of it, is dealt into batches of about equal
bytes, a stored file of names each, and a Python data source has one
partition for each of these.  Tasks open the files they are named; a file that cannot
be read is a row with its error, so a run counts it and goes on.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH_BYTES, BATCH_FILES = 128 << 20, 20_000
_SORTED = 100_000  # files whose sizes are summed up in one task, about
_YIELD = 8 << 20  # bytes of contents handed on together, besides the last file
_ARROW = pa.schema([("full_name", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])
_DDL = "full_name string, path string, content binary, error string"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder on any store that Arrow opens, and the folder's path in it."""
    return pafs.FileSystem.from_uri(uri.rstrip("/"))


def store_batches(files: DataFrame, folder: str, batch_bytes: int = BATCH_BYTES, batch_files: int = BATCH_FILES) -> None:
    """Deal a listing (full_name, path, size) into batches under ``folder``, and store what they are.

    A batch has fewer than ``batch_bytes`` before its last file, and ``batch_files`` files at most; a larger file stands
    in a batch with what came before it.  Sizes are summed up in hashed groups, so no task sorts all names.  A file
    listed twice is read twice.
    """
    spark = files.sparkSession
    rows = files.select("full_name", "path", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
    groups = max(1, math.ceil(rows.count() / _SORTED))
    group = F.pmod(F.xxhash64("full_name", "path"), F.lit(groups))
    order = Window.partitionBy("group").orderBy("full_name", "path").rowsBetween(Window.unboundedPreceding, -1)
    before = F.struct(F.floor(F.coalesce(F.sum("size").over(order), F.lit(0)) / batch_bytes).alias("bytes"), F.floor(F.count("*").over(order) / batch_files).alias("files"))
    batch = F.concat_ws("-", "group", "before.bytes", "before.files")
    dealt = rows.withColumn("group", group).withColumn("before", before).withColumn("batch", batch).drop("group", "before")
    dealt.write.mode("overwrite").partitionBy("batch").parquet(f"{folder}/names")
    stored = spark.read.schema("full_name string, path string, size bigint, batch string").parquet(f"{folder}/names")
    batches = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    batches.coalesce(1).write.mode("overwrite").json(f"{folder}/batches")


class Batch(InputPartition):
    def __init__(self, names: str):
        super().__init__(names)


class LandedFiles(DataSource):
    """Options: ``batches``, the folder of :func:`store_batches`; ``root``, the folder that names stand below."""

    @classmethod
    def name(cls) -> str:
        return "landed_files"

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options["batches"], self.options["root"])


class LandedReader(DataSourceReader):
    def __init__(self, batches: str, root: str):
        self.batches, self.root = batches, root

    def partitions(self) -> list[Batch]:
        """One for each batch, the largest first; of all folders only the small one of batches is looked into."""
        store, folder = file_system(f"{self.batches}/batches")
        found = []
        for info in store.get_file_info(pafs.FileSelector(folder)):
            if info.base_name.endswith(".json"):
                with store.open_input_stream(info.path) as stream:
                    found += [json.loads(line) for line in stream.read().decode().splitlines()]
        return [Batch(b["file"]) for b in sorted(found, key=lambda b: (-b["bytes"], b["file"]))]

    def read(self, partition: Batch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # how Spark asks for what has no partitions
            return
        store, root = file_system(self.root)
        names_store, names = file_system(partition.value)
        rows, held = [], 0
        with names_store.open_input_file(names) as stream:
            for part in pq.ParquetFile(stream).iter_batches(columns=["full_name", "path"]):
                for full_name, path in zip(*(c.to_pylist() for c in part.columns)):
                    rows.append((full_name, path, *contents(store, root, full_name, path)))
                    held += len(rows[-1][2] or b"")
                    if held >= _YIELD:
                        yield _arrow(rows)
                        rows, held = [], 0
        if rows:
            yield _arrow(rows)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def contents(store: pafs.FileSystem, root: str, full_name: str | None, path: str | None) -> tuple[bytes | None, str | None]:
    """The bytes of a file, or why there are none.  Names that lead out of ``root`` are refused."""
    parts = f"{full_name}/{path}".split("/")
    if full_name is None or path is None or {"", ".", ".."} & set(parts):
        return None, "no name below the root"
    try:
        with store.open_input_stream(f"{root}/{full_name}/{path}") as stream:
            return stream.read(), None
    except OSError as error:
        return None, type(error).__name__


def documents(spark: SparkSession, batches: str, root: str) -> DataFrame:
    """The files of stored batches: full_name, path, size_bytes, raw, error.

    Bytes that are not UTF-8 become replacement characters.  A file that cannot be read has a null ``raw`` and
    ``size_bytes`` and a non-null ``error``.
    """
    spark.dataSource.register(LandedFiles)
    rows = spark.read.format(LandedFiles.name()).option("batches", batches).option("root", root).load()
    return rows.select("full_name", "path", F.length("content").cast("bigint").alias("size_bytes"), valid_text(F.col("content")).alias("raw"), "error")


def valid_text(content: Column) -> Column:
    """Bytes as text, with U+FFFD for whatever is not UTF-8."""
    return F.make_valid_utf8(content.cast("string"))


def write_files(rows: DataFrame, root: str) -> int:
    """Write each row's ``content`` (null: nothing) to ``root/full_name/path`` from the tasks, and count them.  A file
    that exists is replaced, so a task may run twice.  For stores that Arrow writes to."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(root)
        made: set[str] = set()
        for batch in batches:
            for full_name, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                folder = f"{base}/{full_name}/{path}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                with store.open_output_stream(f"{base}/{full_name}/{path}") as stream:
                    stream.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    written = rows.select("full_name", "path", F.coalesce(F.col("content").cast("binary"), F.unhex(F.lit(""))).alias("content")).mapInArrow(write, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
