"""Importance resampling: draw the documents that look most like a target text collection.

Word runs are hashed to buckets.  The gain of a bucket is how much likelier it is in
the target than in the documents, on smoothed counts; a document's weight is the mean
gain of its runs, and its score the weight with Gumbel noise of its id, so that the
highest scores are a draw without replacement.

1. Counts of all buckets are added up per task and then by bucket; what reaches the
   driver is one number a bucket.  The gains go back as one array.
2. Weights are array look-ups over whole texts; scores are written without texts.
3. A mergeable quantile sketch of the scores brackets the cutoff.  Rows above
   and in the bracket are counted exactly; a bracket that misses the cutoff is widened,
   in the end to all scores.  Only the bracket is sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.ranking import ranked
from tallyfold.llm.tables import store
from tallyfold.llm.words import Words, flat, slices, split_words

_LONG = 64  # bytes; longer runs are hashed one by one
_MILLI = 1000

_TEXT_BYTES = np.full(256, 32, dtype=np.uint8)  # letters, digits and all beyond ASCII; the rest parts words
for _low, _high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _TEXT_BYTES[_low:_high] = np.arange(_low, _high)
_TEXT_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


@dataclass(frozen=True)
class Settings:
    """``share`` per cent of the documents with ``least`` features or more are drawn.  ``accuracy`` is the
    sketch's: the bracket starts at about two ranks in so many on either side of the cutoff."""

    longest: int = 1
    buckets: int = 10_000
    share: int = 10
    least: int = 20
    seed: int = 2024
    accuracy: int = 10_000


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[starts[i]:ends[i]]`` for all i, byte by byte over all spans that are as long."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    by_hand = int(np.searchsorted(-length, -_LONG, side="left"))
    crc = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(int(length[by_hand]) if by_hand < len(length) else 0):
        part = slice(by_hand, int(np.searchsorted(-length, -k, side="left")))
        crc[part] = _CRC[(crc[part] ^ data[starts[part] + k]) & np.uint32(255)] ^ (crc[part] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(by_hand):
        crc[i] = zlib.crc32(data[starts[i] : starts[i] + length[i]])
    out = np.empty(len(starts), dtype=np.uint32)
    out[order] = crc
    return out


def _runs(words: Words, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run length: the text and the bucket of every run."""
    one_space = np.append(True, words.data[:-1] != 32) | (words.data != 32) if len(words.data) else np.zeros(0, dtype=bool)
    data, moved = words.data[one_space], np.cumsum(one_space) - 1
    starts = moved[words.starts]
    ends, text_of = starts + (words.ends - words.starts), words.text_of
    for n in range(1, longest + 1):
        at = np.flatnonzero(words.windows(n))
        yield text_of[at], crc32_spans(data, starts[at], ends[at + n - 1]).astype(np.int64) % buckets


def _cut(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[int, int, list]]:
    data, offsets = flat(texts)
    for start, stop in slices(offsets):
        words = split_words(_TEXT_BYTES[data[offsets[start] : offsets[stop]]], offsets[start : stop + 1])
        yield start, stop, list(_runs(words, longest, buckets))


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """How many runs of all texts fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, runs in _cut(batch.column(0), longest, buckets):
                for _, bucket in runs:
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    parts = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of how much likelier a bucket is in the target, in thousandths, rounded down."""
    of_documents, of_target, n = float(documents.sum()), float(target.sum()), len(documents)
    ratio = ((target + 1.0) * (of_documents + n)) / ((documents + 1.0) * (of_target + n))
    return np.floor(_MILLI * np.log(ratio)).astype(np.int64)


def noise(seed: int, doc_id: Column) -> Column:
    """Gumbel noise of an id in thousandths, rounded down; a null id counts as empty."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(said.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(_MILLI)) * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))


def resample(documents: DataFrame, target: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per input row: doc_id (of its own type), n_features, weight, score, drawn, tie.

    Ties of scores go to the smaller id, null ids last, then to ``tie``, a number of the row; so of rows
    that share an id any may be drawn.  Null and empty texts have no features and weight 0; below
    ``least`` features nothing is drawn.  An empty target has smoothed counts only.  Other columns are
    not read.  No rows in, no rows out.
    """
    longest, buckets = settings.longest, settings.buckets
    gain = gains(bucket_counts(documents, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, runs in _cut(batch.column(1), longest, buckets):
                n, sums = np.zeros(stop - start, dtype=np.int64), np.zeros(stop - start, dtype=np.int64)
                for text_of, bucket in runs:
                    n += np.bincount(text_of, minlength=stop - start)
                    upto = np.concatenate([[0], np.cumsum(gain[bucket])])
                    edge = np.searchsorted(text_of, np.arange(stop - start + 1))
                    sums += upto[edge[1:]] - upto[edge[:-1]]
                columns = [batch.column(0).slice(start, stop - start), pa.array(n), pa.array(sums // np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_features", "weight"])

    own = documents.schema[id_col].dataType.simpleString()
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    weighed = texts.mapInArrow(weigh, f"doc_id {own}, n_features long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + noise(settings.seed, F.col("doc_id"))).withColumn("tie", F.monotonically_increasing_id())
    scored = store(scored, "resample-scores")
    fit = F.col("n_features") >= settings.least
    last = cutoff(scored.where(fit), settings.share, settings.accuracy)
    if last is None:
        return scored.withColumn("drawn", F.lit(False))
    same_id = F.col("doc_id").eqNullSafe(F.lit(last.doc_id)) & (F.col("tie") <= last.tie)
    smaller = F.col("doc_id").isNotNull() if last.doc_id is None else F.coalesce(F.col("doc_id") < F.lit(last.doc_id), F.lit(False))
    tied = (F.col("score") == last.score) & (smaller | same_id)
    return scored.withColumn("drawn", fit & ((F.col("score") > last.score) | tied))


def best_first() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]


def cutoff(scored: DataFrame, share: int, accuracy: int):
    """The last row that is drawn (None: no row is)."""
    rows = scored.count()
    wanted = rows * share // 100
    if not wanted:
        return None
    spread = [min(1.0, 2 * 8**k / accuracy) for k in range(2 + math.ceil(math.log(accuracy, 8)))]
    middle = 1 - wanted / rows
    levels = [q for s in spread for q in (max(0.0, middle - s), min(1.0, middle + s))]
    sketched = scored.agg(F.percentile_approx("score", levels, accuracy)).first()[0]
    for low, high in zip(sketched[::2], sketched[1::2]):
        counted = scored.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score") >= low)).first()
        if counted[0] < wanted <= counted[1]:
            break
    bracket = ranked(scored.where(F.col("score").between(low, high)), best_first(), "resample-bracket")
    return bracket.where(F.col("rank") == wanted - counted[0]).first()
