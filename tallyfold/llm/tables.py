"""Tables written between steps, and the input columns the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.session import scratch_folder

WORD = r"[^\x20\x09-\x0D]+"


def store(rows: DataFrame, label: str) -> DataFrame:
    """Write ``rows`` under the shared checkpoint folder and read them back: later steps start there,
    and a lost executor costs no more than the step it was in."""
    folder = scratch_folder(rows.sparkSession, label)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """CRC-32 of the UTF-8 text (null: of nothing): tells rows that share an id apart."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def matching(documents: DataFrame, keys: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that have (``left_semi``) or lack (``left_anti``) their id and text checksum in ``keys`` (doc_id, crc)."""
    keys = keys.select(F.col("doc_id").alias("key_id"), F.col("crc").alias("key_crc"))
    same = documents[id_col].eqNullSafe(keys.key_id) & (text_key(documents[text_col]) == keys.key_crc)
    return documents.join(keys, same, how)
