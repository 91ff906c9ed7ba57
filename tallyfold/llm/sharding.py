"""Sharding by weighted rendezvous hashing: the record key and the shards decide, nothing else.

Every shard draws a number for a key, -ln(u) / weight with u from a hash of key
and shard; the least one takes it.  A new shard takes a record only by drawing
less than all others, so no record moves between old shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.tables import text_key

_HEX, _RANGE = 13, float(1 << 52)
_GROUP = 20_000  # rows of a shard numbered together, about


def key_of(id_col: Column, text: Column) -> Column:
    """The record key: its id; without one, its text's checksum and length, so such rows spread."""
    return F.coalesce(id_col.cast("string"), F.concat(F.lit("null:"), text_key(text).cast("string"), F.lit(":"), F.coalesce(F.octet_length(text), F.lit(0)).cast("string")))


def draw(key: Column, shard: int, weight: float) -> Column:
    """What a shard draws for a key, with its number (ties go to the smaller number)."""
    whole = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, _HEX), 16, 10).cast("long")
    return F.struct((-F.log((whole + F.lit(0.5)) / F.lit(_RANGE)) / F.lit(float(weight))).alias("drawn"), F.lit(shard).alias("shard"))


def shard_records(documents: DataFrame, weights: list[float], grown_weight: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot, grown_shard.

    ``weights`` has one positive weight for each shard; ``grown_shard`` is the shard if one more with
    ``grown_weight`` were added (null without).  ``size`` is the UTF-8 length of the text and 1;
    null text counts as empty.  Rows with one id share a shard.  ``slot`` numbers a shard's rows
    from 0 without gaps, by MD5 of the key, then id, size and checksum; equal rows take slots in any
    order.  Other columns are not read.  No rows in, no rows out.
    Ids are whole numbers.
    """
    if not weights or min(weights) <= 0 or (grown_weight is not None and grown_weight <= 0):
        raise ValueError("every shard needs a positive weight")
    text = F.col(text_col)
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        key_of(F.col(id_col), text).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        text_key(text).alias("text_crc32"),
    )
    best = F.array_min(F.array(*(draw(F.col("key"), i, w) for i, w in enumerate(weights))))
    placed = rows.select("*", best.alias("best"), F.md5("key").alias("place"))
    grown = F.lit(None).cast("int")
    if grown_weight is not None:
        grown = F.least(F.col("best"), draw(F.col("key"), len(weights), grown_weight)).shard
    placed = placed.select("doc_id", "size", "text_crc32", "place", F.col("best.shard").alias("shard"), grown.alias("grown_shard"))
    return _numbered(placed, documents.count(), len(weights))


def _numbered(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """Slots: ranges of the hash are counted first, then rows are numbered inside their range."""
    digits = max(1, math.ceil(math.log(max(1, rows / shards / _GROUP), 16)) + 1)
    ranged = placed.withColumn("range", F.substring("place", 1, digits))
    counts = ranged.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")
    begins = counts.select("shard", "range", before.alias("begins"))
    order = Window.partitionBy("shard", "range").orderBy("place", "doc_id", "size", "text_crc32")
    numbered = ranged.withColumn("nth", F.row_number().over(order)).join(begins, ["shard", "range"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("begins") + F.col("nth") - 1).alias("slot"), "grown_shard")


def write_shards(documents: DataFrame, weights: list[float], path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every row of ``documents``, all columns, into one folder per shard (``shard=0``, ...), as
    :func:`shard_records` deals them; rows stand by MD5 of the key within a file.

    Rows are dealt by their own columns and joined with nothing, so null and repeated ids lose and repeat no row.
    A shard too large for one task is split over files.  A column named ``shard`` is replaced.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    key = key_of(F.col(id_col), F.col(text_col))
    shard = F.array_min(F.array(*(draw(key, i, w) for i, w in enumerate(weights)))).shard
    dealt = documents.withColumn("shard", shard).hint("rebalance", F.col("shard"))
    dealt.sortWithinPartitions("shard", F.md5(key)).write.partitionBy("shard").parquet(path)
