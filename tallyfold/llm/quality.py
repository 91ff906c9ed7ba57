"""Quality classifier: hashed word and character n-gram vectors, averaged, softmax, trained by SGD.

A document's features are its words, word pairs and the 3- and 4-byte runs of its
text, hashed into buckets.  Each bucket has a learned vector; a document is the
mean of its features' vectors; a softmax layer reads the class from it.  Training
is numpy gradient descent on the driver over at most ``max_rows`` labelled rows,
whose features are counted in tasks.  Once trained, vectors and layer fold into one
number per bucket, so scoring a text costs a table look-up for each feature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.tables import text_key
from tallyfold.llm.words import U64, chain, flat, slices, split_words

BITS = 16  # buckets of words, and as many of bytes
RUNS = (3, 4)


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled rows that training reads (feature counts of whole texts)."""

    max_rows: int = 3000
    dim: int = 16
    epochs: int = 8
    rate: float = 4.0
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """One number per bucket: what a feature adds to the log-odds of class 1; and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        data, offsets = flat(texts)
        out = np.full(len(texts), self.bias)
        for start, stop in slices(offsets):
            total = np.zeros(stop - start)
            count = np.zeros(stop - start, dtype=np.int64)
            for buckets, first in _features(data[offsets[start] : offsets[stop]], offsets[start : stop + 1]):
                sums = np.concatenate([[0.0], np.cumsum(self.weights[buckets], dtype=np.float64)])
                total += sums[first[1:]] - sums[first[:-1]]
                count += np.diff(first)
            out[start:stop] += total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of one sort of feature for neighbouring texts, and the index of each text's first."""
    offsets = offsets - offsets[0]
    words = split_words(data, offsets)
    lane = words.hashes(0)
    shift = U64(64 - BITS)
    yield (lane >> shift).astype(np.int32), words.first
    inside = np.flatnonzero(words.windows(2))
    pairs = (chain(lane[inside], lane[inside + 1]) >> shift).astype(np.int32) if len(inside) else np.zeros(0, dtype=np.int32)
    yield pairs, np.searchsorted(inside, words.first)
    padded = np.concatenate([data, np.zeros(4, dtype=np.uint8)])
    runs = np.ndarray((len(data),), dtype="<u4", buffer=padded, strides=(1,))
    length = np.diff(offsets)
    for n in RUNS:
        values = runs & np.uint32(0xFFFFFF) if n == 3 else runs.copy()
        values *= np.uint32(0x9E3779B1)
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x85EBCA77)
        buckets = (values >> np.uint32(32 - BITS)).astype(np.int32) + (1 << BITS)
        # a run that leaves its text counts nowhere
        keep = np.ones(len(data), dtype=bool)
        for back in range(1, n):
            ends = offsets[1:][length >= back] - back
            keep[ends] = False
        first = np.concatenate([[0], np.cumsum(np.maximum(length - n + 1, 0))])
        yield buckets[keep], first


@dataclass(frozen=True)
class Example:
    """Feature counts of one labelled text in few bytes: buckets of words and of bytes as uint16, counts as uint8,
    those of 255 and more in ``large`` as uint32."""

    label: int
    words: bytes
    runs: bytes
    counts: bytes
    large: bytes

    @staticmethod
    def of(text: str, label: int) -> Example:
        sorts = [buckets for buckets, _ in _features(*flat(pa.array([text], pa.string())))]
        buckets, counts = np.unique(np.concatenate(sorts), return_counts=True)
        half = int(np.searchsorted(buckets, 1 << BITS))
        large = counts[counts >= 255].astype(np.uint32)
        parts = (buckets[:half].astype(np.uint16), (buckets[half:] - (1 << BITS)).astype(np.uint16), np.minimum(counts, 255).astype(np.uint8), large)
        return Example(label, *(x.tobytes() for x in parts))

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and the share of each among the text's features."""
        buckets = np.concatenate([np.frombuffer(self.words, np.uint16).astype(np.int32), np.frombuffer(self.runs, np.uint16).astype(np.int32) + (1 << BITS)])
        counts = np.frombuffer(self.counts, np.uint8).astype(np.float32)
        counts[counts == 255] = np.frombuffer(self.large, np.uint32)
        return buckets, counts / np.float32(max(1.0, counts.sum()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
            e = Example.of(text.as_py(), label)
            packed = [pa.array([x], pa.binary()) for x in (e.words, e.runs, e.counts, e.large)]
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), *packed], names=["label", "words", "runs", "counts", "large"])


def train(documents: DataFrame, labels: DataFrame, label_col: str = "quality", settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn ``label_col`` (0 or 1) of ``labels`` from the texts of ``documents``.

    At most ``max_rows`` ids are used, the first in a hashed order, and at most as many of their rows, again
    the first in a hashed order of id and text; equal rows teach once.  Rows with a null id or a null
    label, and ids with both labels, teach nothing; a repeated label counts once.  Null text is empty.  Without examples every score is 0.5, with
    examples of one class the model says that class.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows)
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").withColumn("crc", text_key(F.col("text")))
    keys = rows.select("doc_id", "crc").distinct().orderBy(F.xxhash64("doc_id", "crc"), "doc_id", "crc").limit(settings.max_rows)
    taught = rows.join(F.broadcast(keys), ["doc_id", "crc"]).groupBy("doc_id", "crc").agg(F.first("text").alias("text"), F.first("label").alias("label"))
    examples = taught.select("text", "label").mapInArrow(_counted, "label int, words binary, runs binary, counts binary, large binary")
    found = [Example(r.label, *(bytes(x) for x in r[1:])) for r in examples.collect()]
    return fit(sorted(found, key=lambda e: (e.label, e.words, e.runs, e.counts)), settings)  # the order of tasks must not matter


def fit(examples: list[Example], settings: Settings) -> Model:
    """Stochastic gradient descent on the softmax loss, one document a step, with a falling rate."""
    draw = np.random.default_rng(settings.seed)
    vectors = draw.uniform(-1, 1, (2 << BITS, settings.dim)).astype(np.float32) / settings.dim
    layer = np.zeros((2, settings.dim), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    step, steps = 0, max(1, settings.epochs * len(examples))
    for _ in range(settings.epochs):
        for i in draw.permutation(len(examples)):
            buckets, shares = examples[i].shares()
            rate = np.float32(settings.rate * (1 - step / steps))
            hidden = shares @ vectors[buckets]
            odds = np.exp(layer @ hidden + bias - (layer @ hidden + bias).max())
            slope = odds / odds.sum()
            slope[examples[i].label] -= 1
            back = layer.T @ slope
            layer -= rate * np.outer(slope, hidden)
            bias -= rate * np.float32(0.1) * slope
            vectors[buckets] -= rate * np.outer(shares, back)
            step += 1
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """A fifth of all ids, kept from training: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def score_documents(documents: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher for class 1), predicted.

    Whole texts are scored; empty and null texts get the model's bias.  Equal texts get
    equal scores.  A null id is not held out.  Other columns are not read.  No rows in, no rows out.
    Ids are whole numbers.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = rows.sparkSession.sparkContext.broadcast(model)
    scored = rows.mapInArrow(_scored(sent), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` with a score of ``threshold`` or more, all columns as they were."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.score(batch.column(text_col)) >= threshold))

    return documents.mapInArrow(keep, documents.schema)


def _scored(sent) -> Callable:
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.score(batch.column("text")))], names=["doc_id", "score"])

    return scored
