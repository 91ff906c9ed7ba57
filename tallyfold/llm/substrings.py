"""Substring deduplication: a count-min prefilter, then exact grouping of what may repeat.

A window is ``window`` consecutive words of one text.  Its anchor is the least
hash among the runs of ``window // 2`` words inside it.  Equal windows have equal
anchors, so the number of documents with an anchor is never below the number with
the window: a count-min sketch over anchors overestimates window counts, and
takes a thirteenth of the entries that the windows would.

1. Each task sketches the distinct anchors of each of its documents.  Partition
   sketches travel as sparse cell lists and are merged block by block; what stays
   is one bit per cell, "reached by two documents or more".  The width follows the
   corpus up to ``max_sketch_mb``; beyond that the filter lets more through, and
   results stay the same.
2. Windows whose anchor is estimated repeated get a 128-bit identity.  A task
   settles its own documents first (only the least document of a batch with a window claims
   it, so a passage in a third of all rows makes a row a batch), then claims are
   grouped exactly by identity and the least document owns the window.
3. Documents meet the windows they lost and the words under these go.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.tables import text_key
from tallyfold.llm.words import U64, Words, flat, grams, mix, signed, slices, sliding_min, split_words

DEPTH = 2
MAX_SKETCH_MB = 128
_BYTES_PER_ANCHOR = 70  # about 6 bytes a word, an anchor every 13 words
_BLOCK_BITS = 20

_CLAIM = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("runs", pa.binary())])
_CLAIM_DDL = "h1 long, h2 long, doc_id long, tag long, runs binary"


def remove_repeats(documents: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", max_sketch_mb: int = MAX_SKETCH_MB) -> DataFrame:
    """One row per input row: doc_id, kept (words left, joined by one space), n_words, n_removed.

    A word goes when a window over it also starts in a row with a smaller doc_id; all windows are
    judged on the input.  Null text has no words; texts shorter than a window lose nothing; rows
    with a null id neither take nor lose words.  Rows that share an id are judged each by its own
    text and take nothing from each other.  Other columns are not read.  No rows in, no rows out.
    Ids are whole numbers.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.withColumn("crc", text_key(F.col("text")))
    sketch = build_sketch(rows, window, max_sketch_mb)
    claims = keyed.where("doc_id IS NOT NULL").mapInArrow(_claims(sketch, window), _CLAIM_DDL)
    owner = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    position = F.when(F.col("runs").isNull(), F.col("tag").bitwiseAND(F.lit(0xFFFFFFFF)))
    lost = (
        claims.withColumn("owner", owner)
        .where("runs IS NOT NULL OR doc_id > owner")
        .select("doc_id", F.shiftrightunsigned("tag", 32).alias("crc"), position.alias("at"), "runs")
        .groupBy("doc_id", "crc")
        .agg(F.collect_list("at").alias("at"), F.collect_list("runs").alias("runs"))
    )
    return keyed.join(lost, ["doc_id", "crc"], "left").mapInArrow(_keep(window), "doc_id long, kept string, n_words long, n_removed long")


def build_sketch(rows: DataFrame, window: int, max_sketch_mb: int = MAX_SKETCH_MB):
    """Broadcast bits per sketch row: was this cell reached by anchors of two documents or more?"""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = int(math.log2(max_sketch_mb * 8 * 2**20 / DEPTH))
    bits = min(most, max(16, math.ceil(math.log2(4 * size / _BYTES_PER_ANCHOR + 1))))
    parts = rows.select("text").mapInArrow(_partition_sketch(window, bits), "row int, block int, once binary, twice binary")
    merged = parts.groupBy("row", "block").applyInArrow(_merge(bits), "row int, block int, bits binary")
    table = np.zeros((DEPTH, (1 << bits) // 8), dtype=np.uint8)  # at most max_sketch_mb in all
    step = min(1 << bits, 1 << _BLOCK_BITS) // 8
    for row, block, packed in merged.collect():
        table[row, block * step : (block + 1) * step] = np.frombuffer(packed, dtype=np.uint8)
    return spark.sparkContext.broadcast((bits, table))


def _cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(anchors ^ U64(0xA0761D6478BD642F * (2 * row + 1) % 2**64)) >> U64(64 - bits)


def _anchors(words: Words, lane: np.ndarray, window: int) -> np.ndarray:
    return sliding_min(grams(lane, window // 2), window - window // 2 + 1)


def _partition_sketch(window: int, bits: int) -> Callable:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = [np.zeros(0, dtype=np.uint32)] * DEPTH
        twice = [np.zeros(0, dtype=np.uint32)] * DEPTH
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for start, stop in slices(offsets):
                words = split_words(data[offsets[start] : offsets[stop]], offsets[start : stop + 1])
                inside = words.windows(window)
                anchors = _anchors(words, words.hashes(0), window)[inside]
                if not len(anchors):
                    continue
                text_of = words.text_of[: len(inside)][inside]
                new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (text_of[1:] != text_of[:-1])])
                anchors, text_of = anchors[new], text_of[new]
                order = np.lexsort((anchors, text_of))
                anchors, text_of = anchors[order], text_of[order]
                new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (text_of[1:] != text_of[:-1])])
                for row in range(DEPTH):
                    cells, counts = np.unique(_cells(anchors[new], row, bits).astype(np.uint32), return_counts=True)
                    again = np.union1d(cells[counts > 1], np.intersect1d(cells, once[row], assume_unique=True))
                    once[row] = np.union1d(once[row], cells)
                    twice[row] = np.union1d(twice[row], again)
        block_bits = min(bits, _BLOCK_BITS)
        for row in range(DEPTH):
            edges = np.arange(0, (1 << (bits - block_bits)) + 1, dtype=np.uint64) << U64(block_bits)
            a, b = np.searchsorted(once[row], edges), np.searchsorted(twice[row], edges)
            for block in np.flatnonzero(np.diff(a)).tolist():
                packed = [[cells[at[block] : at[block + 1]].tobytes()] for cells, at in ((once[row], a), (twice[row], b))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row], pa.int32()), pa.array([block], pa.int32()), *(pa.array(x, pa.binary()) for x in packed)],
                    names=["row", "block", "once", "twice"],
                )

    return sketch


def _merge(bits: int) -> Callable:
    block_bits = min(bits, _BLOCK_BITS)

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        seen = np.zeros(1 << block_bits, dtype=np.uint8)  # 0, 1 or 2 documents
        mask = np.uint32((1 << block_bits) - 1)
        for once, twice in zip(group["once"], group["twice"]):
            cells = np.frombuffer(once.as_py(), dtype=np.uint32) & mask
            seen[cells] = np.minimum(seen[cells] + 1, 2)
            seen[np.frombuffer(twice.as_py(), dtype=np.uint32) & mask] = 2
        packed = np.packbits(seen == 2, bitorder="little").tobytes()
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "bits": pa.array([packed], pa.binary())})

    return merge


def _maybe_repeated(anchors: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    out = np.ones(len(anchors), dtype=bool)
    for row in range(DEPTH):
        cells = _cells(anchors, row, bits)
        out &= (table[row][cells >> U64(3)] >> (cells & U64(7)).astype(np.uint8)) & 1 == 1
    return out


def _claims(sketch, window: int) -> Callable:
    """Rows (identity, document, position) for windows that may repeat, and, with ``runs``, the
    windows which a document has lost already to another of its batch."""

    def claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, table = sketch.value
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch, sort_keys=[("doc_id", "ascending")]))
            ids, crcs = batch.column("doc_id").to_numpy(), batch.column("crc").to_numpy()
            found = _flagged(batch.column("text"), bits, table, window)
            if not found:
                continue
            h1, h2, row, at = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(h1, kind="stable")  # within equal hashes: by document, then position
            h1, h2, row, at = h1[order], h2[order], row[order], at[order]
            doc = ids[row]
            opens = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            first = np.flatnonzero(opens)[np.cumsum(opens) - 1]
            anew = opens | np.concatenate([[True], row[1:] != row[:-1]])  # one position a row is enough
            mine, lost = anew & (doc == doc[first]), anew & (doc > doc[first])
            tags = (crcs.astype(U64)[row] << U64(32)) | at.astype(U64)
            yield pa.RecordBatch.from_arrays(
                [signed(h1[mine]), signed(h2[mine]), pa.array(doc[mine]), signed(tags[mine]), pa.nulls(int(mine.sum()), pa.binary())], schema=_CLAIM
            )
            yield from _lost_runs(ids, crcs, row[lost], at[lost])

    return claims


def _flagged(texts: pa.Array, bits: int, table: np.ndarray, window: int) -> list[tuple[np.ndarray, ...]]:
    out = []
    data, offsets = flat(texts)
    half = window // 2
    for start, stop in slices(offsets):
        words = split_words(data[offsets[start] : offsets[stop]], offsets[start : stop + 1])
        inside = words.windows(window)
        if not inside.any():
            continue
        lane = words.hashes(0)
        at = np.flatnonzero(inside & _maybe_repeated(_anchors(words, lane, window), bits, table))
        if not len(at):
            continue
        text_of = words.text_of[at]
        whole = [grams(x, half) if window == 2 * half else grams(x, window) for x in (lane, words.hashes(1))]
        ids = [chain_at(x, at, half) if window == 2 * half else x[at] for x in whole]
        out.append((*ids, text_of + start, at - words.first[text_of]))
    return out


def chain_at(halves: np.ndarray, at: np.ndarray, half: int) -> np.ndarray:
    """Hash of the window at each position, from the hashes of its two halves."""
    return mix(mix(halves[at].copy()) * U64(0x9E3779B97F4A7C15) + halves[at + half])


def _lost_runs(ids: np.ndarray, crcs: np.ndarray, row: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(row):
        return
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    opens = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)])
    starts = np.flatnonzero(opens)
    runs = np.stack([at[starts], at[np.concatenate([starts[1:], [len(at)]]) - 1] + 1], axis=1).astype(np.uint32)
    owners = row[starts]
    cut = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
    packed = [runs[a:b].tobytes() for a, b in zip(cut, np.concatenate([cut[1:], [len(runs)]]))]
    rows = owners[cut]
    spread = mix(ids[rows].astype(U64) ^ crcs[rows].astype(U64))  # nothing to group: dealt evenly
    tags = crcs[rows].astype(U64) << U64(32)
    yield pa.RecordBatch.from_arrays(
        [signed(spread), pa.array(np.full(len(rows), -1)), pa.array(ids[rows]), signed(tags), pa.array(packed, pa.binary())], schema=_CLAIM
    )


def _keep(window: int) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.large_string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            at, runs = batch.column("at"), batch.column("runs")
            for start, stop in slices(offsets):
                words = split_words(data[offsets[start] : offsets[stop]], offsets[start : stop + 1])
                gone = _removed(words, [_positions(at[d], runs[d]) for d in range(start, stop)], window)
                kept, bounds = _joined(words, ~gone)
                n = stop - start
                text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(kept.tobytes())])
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) if len(gone) else np.zeros(n, dtype=np.int64)
                removed[words.counts == 0] = 0
                columns = [batch.column("doc_id").slice(start, n), text, pa.array(words.counts.astype(np.int64)), pa.array(removed)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return keep


def _positions(at: pa.Scalar, runs: pa.Scalar) -> np.ndarray:
    if not at.is_valid:
        return np.zeros(0, dtype=np.int64)
    parts = [np.asarray(at.values.to_numpy(zero_copy_only=False), dtype=np.int64)]
    for packed in runs.as_py():
        parts += [np.arange(a, b) for a, b in np.frombuffer(packed, dtype=np.uint32).reshape(-1, 2).astype(np.int64)]
    return np.concatenate(parts)


def _removed(words: Words, lost: list[np.ndarray], window: int) -> np.ndarray:
    """Which words lie under a lost window?  A lost window is lost wherever it stands in its text."""
    edge = np.zeros(len(words.starts) + 1, dtype=np.int64)
    if any(len(x) for x in lost):
        hashes = grams(words.hashes(0), window)
        for text, positions in enumerate(lost):
            if len(positions):
                first, last = words.first[text], words.first[text + 1] - window + 1
                own = hashes[first:last]
                at = np.flatnonzero(np.isin(own, own[positions])) + first
                edge[at] += 1
                edge[at + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def _joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space: all bytes, and where each text begins."""
    data = words.data.copy()
    mask = np.zeros(len(data) + 1, dtype=bool)
    at = np.flatnonzero(keep)
    if len(at):
        step = np.zeros(len(data) + 1, dtype=np.int8)
        step[words.starts[at]] += 1
        step[words.ends[at]] -= 1
        mask = np.cumsum(step, dtype=np.int8) > 0
        text_of = words.text_of[at]
        gaps = words.ends[at[:-1][text_of[1:] == text_of[:-1]]]  # after each kept word but a text's last
        data[gaps] = 32
        mask[gaps] = True
    size = np.concatenate([[0], np.cumsum(mask[:-1])])
    return data[mask[:-1]], size[words.offsets].astype(np.int64)
