"""Benchmark decontamination by template windows and slot consistency.

A text becomes a sequence of tokens: words without the punctuation around them,
in lower case; numbers, names and units of measure are replaced by a
placeholder of their type and remembered as slots.  Windows of ``window`` tokens
are hashed; those of a document are looked up among the benchmark's.  The
slots of a window must be consistent: one benchmark value stands for one document
value and the other way round.  A window that contradicts itself also takes those
with it that share tokens with it and lie on its diagonal, but for windows that hold
the benchmark's own values.  So a question asked
with other numbers is still found, while a table row that merely has its shape is
not, and a long passage is found though one of its numbers was changed.

Templates of few plain tokens fit too much: windows below ``LITERAL_SHARE`` and
items below ``least`` tokens are not looked up as templates.  All windows are
also looked up by their words alone, so that verbatim copies are found whatever
their slots, line breaks or length.

The benchmark's windows are a stored table.  A bitmap of their hashes, of bounded
size, goes to every task and lets through nearly only documents' windows that are among
them; these are hash-joined with the table, and each document and item is judged once,
from its joined windows.  Nothing of the benchmark but this bitmap passes through the driver.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.tables import store, text_key
from tallyfold.llm.words import U64, Words, chain, flat, grams, mix, slices, split_words

MOST_BITS = 27  # of the filter of benchmark windows: 16 MB
_BLOCK_BITS = 20
_ROWS = 10_000  # rows handed on together
LITERAL_SHARE = 0.5  # a window needs this share of plain tokens to be looked up as a template

UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds ounce ounces ml cl l liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms "
    "dollar dollars euro euros cent cents usd eur gbp percent % degree degrees kmh mph"
).split()

_NUMBER = re.compile(rb"[0-9][0-9.,:/]*")
_PLAIN, _NUM, _NAME, _UNIT = 0, 1, 2, 3
_PLACEHOLDER = np.array([0, 0x6C62272E07BB0142, 0x62B821756295C58D, 0x27D4EB2F165667C5], dtype=U64)

_STRIP = np.zeros(256, dtype=bool)
_STRIP[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?:"]] = True


@dataclass
class Templates:
    """Tokens of neighbouring texts: hashes of words and of templates, types, and the words without punctuation."""

    words: Words
    word: np.ndarray
    lane: np.ndarray
    kind: np.ndarray
    first: np.ndarray

    def value(self, token: int) -> bytes:
        return self.words.data[self.words.starts[token] : self.words.ends[token]].tobytes()

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of windows of n tokens that may be looked up, and their hashes.

        Whether the first token is a name or a unit depends on what stands before the window, so such a
        window has a second hash, with the word itself.
        """
        if len(self.lane) < n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
        rest = grams(self.lane, n - 1)[1:] if n > 1 else np.zeros(len(self.lane), dtype=U64)
        plain = np.concatenate([[0], np.cumsum(self.kind == _PLAIN)])
        share, least, inside = plain[n:] - plain[:-n], np.ceil(LITERAL_SHARE * n), self.words.windows(n)
        first = self.kind[: len(rest)]
        typed = np.flatnonzero(inside & (share >= least))
        worded = np.flatnonzero(inside & ((first == _NAME) | (first == _UNIT)) & (share + 1 >= least))
        return np.concatenate([typed, worded]), np.concatenate([chain(self.lane[typed], rest[typed]), chain(self.word[worded], rest[worded])])

    def verbatim(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all windows of n tokens, and hashes of their words."""
        at = np.flatnonzero(self.words.windows(n))
        return at, grams(self.word, n)[at]


def templates(data: np.ndarray, offsets: np.ndarray) -> Templates:
    lower = _lowered(data)
    words = split_words(data, offsets)
    starts, ends, text_of = words.starts.copy(), words.ends.copy(), words.text_of
    last = data[ends - 1] if len(ends) else np.zeros(0, dtype=np.uint8)
    while (at := np.flatnonzero((ends > starts) & _STRIP[data[np.minimum(starts, len(data) - 1)]])).size if len(starts) else False:
        starts[at] += 1
    while (at := np.flatnonzero((ends > starts) & _STRIP[data[ends - 1]])).size if len(starts) else False:
        ends[at] -= 1
    bare = ends == starts
    ended = _ENDS[last] | bare  # a word without letters separates, as a full stop does
    keep = np.flatnonzero(~bare)
    begins = np.ones(len(words.starts), dtype=bool)
    begins[1:] = (text_of[1:] != text_of[:-1]) | ended[:-1]
    begins[1:] |= _line_between(data, words.ends[:-1], words.starts[1:])
    starts, ends, begins = starts[keep], ends[keep], begins[keep]
    stripped = Words(lower, words.offsets, starts, ends, np.searchsorted(keep, words.first))
    word = stripped.hashes(0)
    lane = word.copy()
    kind = _kinds(data, lower, stripped, begins)
    slots = kind != _PLAIN
    lane[slots] = _PLACEHOLDER[kind[slots]]
    return Templates(stripped, word, lane, kind, stripped.first)


def _lowered(data: np.ndarray) -> np.ndarray:
    """A-Z, and the Latin-1 capitals in UTF-8, in lower case."""
    out = data.copy()
    upper = (out >= 65) & (out <= 90)
    upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[upper] += 32
    return out


def _line_between(data: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    breaks = np.flatnonzero(data == 10)
    return np.searchsorted(breaks, ends) < np.searchsorted(breaks, starts)


def _kinds(data: np.ndarray, lower: np.ndarray, words: Words, begins: np.ndarray) -> np.ndarray:
    kind = np.zeros(len(words.starts), dtype=np.int8)
    if not len(kind):
        return kind
    head = data[words.starts]
    for i in np.flatnonzero((head >= 48) & (head <= 57)).tolist():
        if _NUMBER.fullmatch(data[words.starts[i] : words.ends[i]].tobytes()):
            kind[i] = _NUM
    numbers = np.flatnonzero(kind == _NUM)
    after = numbers[numbers + 1 < len(kind)] + 1
    text_of = words.text_of
    units = {u.encode() for u in UNITS}
    for i in after[text_of[after] == text_of[after - 1]].tolist():
        if lower[words.starts[i] : words.ends[i]].tobytes() in units:
            kind[i] = _UNIT
    changed = data != lower
    first = changed[words.starts] | ((head == 0xC3) & changed[np.minimum(words.starts + 1, len(data) - 1)])
    upper = np.concatenate([[0], np.cumsum(changed)])
    several = (upper[words.ends] - upper[words.starts] > 1) | (words.ends - words.starts == 1)  # shouting and a lone letter are no names
    kind[first & ~several & ~begins & (kind == _PLAIN)] = _NAME
    return kind


BY_TEMPLATE, BY_WORDS = 0, 1
_WINDOW_TYPES = [
    ("sort", pa.int32()), ("n", pa.int32()), ("hash", pa.int64()), ("item", pa.int64()), ("number", pa.int64()), ("item_at", pa.int32()), ("sure", pa.bool_()),
    ("offsets", pa.list_(pa.int32())), ("kinds", pa.list_(pa.int32())), ("values", pa.list_(pa.binary())),
]
_WINDOW_DDL = "sort int, n int, hash long, item long, number long, item_at int, sure boolean, offsets array<int>, kinds array<int>, values array<binary>"
_HIT_TYPES = [("sort", pa.int32()), ("n", pa.int32()), ("hash", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("at", pa.int32()), ("words", pa.list_(pa.binary()))]
_HIT_DDL = "sort int, n int, hash long, row long, doc_id long, crc long, at int, words array<binary>"
_FOUND_DDL = "doc_id long, crc long, item_id long, n_windows int, n_tokens int, changed_slots int"


def benchmark_windows(items: DataFrame, window: int, id_col: str, text_col: str, least: int) -> DataFrame:
    """All windows of the benchmark's texts, stored: sort (by template or by words), length and hash, item, a number of
    the text, position, whether the words alone decide (no template covers the window), and the slots under it."""
    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    numbered = rows.withColumn("number", F.xxhash64("item", "text"))
    return store(numbered.select("item", "number", "text").mapInArrow(_windows(window, least), _WINDOW_DDL), "benchmark-windows")


def _windows(window: int, least: int) -> Callable:
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, number, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows = list(_windows_of(templates(*flat(pa.array([text]))), window, least))
                if rows:
                    sort, n, hashes, at, sure, slots = zip(*rows)
                    offsets, kinds, values = ([[slot[k] for slot in s] for s in slots] for k in range(3))
                    columns = [sort, n, hashes, [item] * len(rows), [number] * len(rows), at, sure, offsets, kinds, values]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _WINDOW_TYPES)], names=[name for name, _ in _WINDOW_TYPES])

    return windows


def _windows_of(t: Templates, window: int, least: int) -> Iterator[tuple]:
    n = min(window, len(t.lane))
    if not n:
        return
    every, words = t.verbatim(n)
    at, hashes = t.windows(n) if n >= least else (every[:0], words[:0])
    covered = set(at.tolist())
    found = [(BY_TEMPLATE, h, i, False) for i, h in zip(at.tolist(), hashes.view(np.int64).tolist())]
    found += [(BY_WORDS, h, i, i not in covered) for i, h in zip(every.tolist(), np.ascontiguousarray(words).view(np.int64).tolist())]
    for sort, h, i, sure in found:
        yield sort, n, h, i, sure, [(k - i, int(t.kind[k]), t.value(k)) for k in range(i, i + n) if t.kind[k]]


@dataclass(frozen=True)
class Filter:
    """A bitmap of the benchmark's hashes with two probes, of at most 2^``MOST_BITS`` bits: what does not pass is in no
    window; what passes by accident finds no partner in the join."""

    bits: int
    cells: np.ndarray

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for cell in _cells(hashes, self.bits):
            out &= (self.cells[cell >> U64(3)] >> (cell & U64(7)).astype(np.uint8)) & 1 == 1
        return out


def _cells(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [x >> U64(64 - bits) for x in (mix(hashes.copy()), mix(hashes ^ U64(0x9E3779B97F4A7C15)))]


def window_filter(windows: DataFrame, most_bits: int = MOST_BITS) -> Filter:
    """The filter of stored windows: tasks set bits block by block, and blocks are merged before they come to the driver."""
    bits = min(most_bits, max(16, math.ceil(math.log2(1024 * windows.count() + 1))))
    block = min(bits, _BLOCK_BITS)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.unique(np.concatenate(_cells(batch.column(0).to_numpy().view(U64), bits)))
            blocks = (cells >> U64(block)).astype(np.int32)
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            parts = [(int(blocks[p[0]]), cells[p].astype(np.uint32).tobytes()) for p in np.split(np.arange(len(cells)), cuts) if len(p)]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], names=["block", "cells"])

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        seen = np.zeros(1 << block, dtype=bool)
        for cells in group["cells"]:
            seen[np.frombuffer(cells.as_py(), dtype=np.uint32) & np.uint32((1 << block) - 1)] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "packed": pa.array([np.packbits(seen, bitorder="little").tobytes()], pa.binary())})

    out, step = np.zeros((1 << bits) // 8, dtype=np.uint8), (1 << block) // 8
    merged = windows.select("hash").mapInArrow(marked, "block int, cells binary").groupBy("block").applyInArrow(merge, "block int, packed binary")
    for number, packed in merged.collect():  # 2^MOST_BITS bits in all
        out[number * step : (number + 1) * step] = np.frombuffer(packed, dtype=np.uint8)
    return Filter(bits, out)


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = 13, least: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """One row per document row and item found in it: doc_id, crc (of the text), item_id, n_windows, n_tokens (of the
    document under them), changed_slots (values that differ from the benchmark's).

    Items shorter than ``window`` tokens are one window.  Items below ``least`` tokens and windows with less than
    ``LITERAL_SHARE`` plain tokens are found word for word only, all others with other slots too; so an item of one
    word is found wherever this word is.  Items without words, null texts and null item ids are not looked for.  Null and empty documents hold nothing.  Items that share an id are
    judged together only where their texts are equal.  Repeated document rows give repeated rows.
    Other columns are not read.  No documents or no items, no rows.
    Ids are whole numbers.
    """
    spark = documents.sparkSession
    windows = benchmark_windows(benchmark, window, item_col, item_text_col, least)
    lengths = sorted((r.sort, r.n) for r in windows.select("sort", "n").distinct().collect())  # two for each length up to ``window``
    sent = spark.sparkContext.broadcast(window_filter(windows, most_bits))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("crc"), F.col(text_col).cast("string").alias("text"))
    hits = store(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_hits(sent, lengths), _HIT_DDL), "benchmark-hits")
    pairs = hits.join(windows, ["sort", "n", "hash"])
    return pairs.groupBy("row", "item").applyInArrow(_judged, _FOUND_DDL)


def _hits(sent, lengths: list[tuple[int, int]]) -> Callable:
    """The documents' windows that pass the filter, with their words."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for start, stop in slices(offsets):
                t = templates(data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start])
                text_of = t.words.text_of
                for sort, n in lengths:
                    at, hashes = t.windows(n) if sort == BY_TEMPLATE else t.verbatim(n)
                    known = np.flatnonzero(sent.value.passes(hashes))
                    for low in range(0, len(known), _ROWS):
                        these = known[low : low + _ROWS]
                        owner = pa.array(start + text_of[at[these]])
                        words = [[t.value(k) for k in range(i, i + n)] for i in at[these].tolist()]
                        columns = [np.full(len(these), sort), np.full(len(these), n), hashes[these].view(np.int64), *(batch.column(c).take(owner) for c in ("row", "doc_id", "crc")), at[these], words]
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, (_, kind) in zip(columns, _HIT_TYPES)], names=[name for name, _ in _HIT_TYPES])

    return hits


def _judged(key: tuple, group: pa.Table) -> pa.Table:
    """What is consistently found of one item in one document, as one row; no row if nothing is."""
    hits: dict[tuple[int, int], set[tuple[int, int]]] = {}
    sure: dict[tuple[int, int], set[tuple[int, int]]] = {}
    values: dict[tuple[int, int], dict[int, tuple[int, bytes, bytes]]] = {}
    columns = [group[c].to_pylist() for c in ("number", "item_at", "at", "n", "sure", "offsets", "kinds", "values", "words")]
    for number, item_at, at, n, by_words, offsets, kinds, slots, words in zip(*columns):
        place = number, at - item_at
        (sure if by_words else hits).setdefault(place, set()).add((at, n))
        if not by_words:
            values.setdefault(place, {}).update({at + o: (kind, value, words[o]) for o, kind, value in zip(offsets, kinds, slots)})
    total, tokens, changes = 0, set(), 0
    for place in hits.keys() | sure.keys():
        windows, changed = _consistent(hits.get(place, set()), values.get(place, {}))
        windows |= sure.get(place, set())
        total, changes = total + len(windows), changes + changed
        tokens |= _under(windows)
    ids = [group[c].slice(0, 1).combine_chunks() for c in ("doc_id", "crc")] if total else [pa.array([], pa.int64())] * 2
    counts = [pa.array([x] if total else [], pa.int32()) for x in (total, len(tokens), changes)]
    return pa.table([*ids, pa.array([key[1].as_py()] if total else [], pa.int64()), *counts], names=["doc_id", "crc", "item_id", "n_windows", "n_tokens", "changed_slots"])


def _under(windows: set[tuple[int, int]]) -> set[int]:
    return {i for at, n in windows for i in range(at, at + n)}


def _consistent(windows: set[tuple[int, int]], values: dict[int, tuple[int, bytes, bytes]]) -> tuple[set[tuple[int, int]], int]:
    """The windows that hold the benchmark's own values, and of the others those that neither contradict themselves nor
    share tokens with one that does; and how many slots under them hold another value than the benchmark's.
    ``values`` has kind, benchmark's and document's word of the slots under the windows, by position."""
    lost = _under({(at, n) for at, n in windows if _contradict(values[i] for i in range(at, at + n) if i in values)})
    other = sorted(i for i, (_, value, own) in values.items() if own != value) if lost else []
    kept = {(at, n) for at, n in windows if lost.isdisjoint(range(at, at + n)) or bisect_left(other, at) == bisect_left(other, at + n)} if lost else set(windows)
    changed = [values[i] for i in _under(kept) if i in values]
    return kept, sum(own != value for _, value, own in changed)


def _contradict(slots: Iterator[tuple[int, bytes, bytes]]) -> bool:
    """Does one benchmark value stand for two document values, or the other way round?"""
    there: dict[tuple[int, bytes], bytes] = {}
    back: dict[tuple[int, bytes], bytes] = {}
    return any(there.setdefault((kind, value), own) != own or back.setdefault((kind, own), value) != value for kind, value, own in slots)
