"""Periodic runs of words: maximal stretches that repeat with a smallest period.

The texts of a block are one sequence of word numbers, each text between two marks
that occur once, so that nothing common crosses a text's edge.

* ``Extensions`` answers how many words two positions have in common from there on.  Only
  suffixes at positions of a difference cover (5 of 16 residues) are sorted, by
  their first 16 words and then by doubling along one residue.  Any two positions
  reach the cover together within a few words, which are compared; from there
  the answer is the least of the neighbours' common prefixes between two
  ranks, read from a sparse table.
* A run of period p holds two neighbouring points of the grid 0, p, 2p, ...  For all
  p the grids have n log n points together.  Where two neighbours hold equal words,
  their common extension to both sides is the longest stretch of period p.
* A stretch that is found with several periods is kept with its smallest.

A block is about 1 MB of texts or one longer text, with some 100 bytes a word.
Nothing is shuffled and a lost task is run again by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.substrings import _joined
from tallyfold.llm.words import Words, flat, slices, split_words

CYCLE = 16
COVER = (0, 1, 2, 5, 8)  # every distance modulo CYCLE lies between two of these
PAIRS = 1 << 21  # grid neighbours compared at a time

_PLACE = np.full(CYCLE, -1, dtype=np.int64)
_PLACE[list(COVER)] = np.arange(len(COVER))
_SHIFT = np.array([[next(s for s in range(CYCLE) if {(a + s) % CYCLE, (b + s) % CYCLE} <= set(COVER)) for b in range(CYCLE)] for a in range(CYCLE)])

_RUNS = "array<struct<start: long, length: long, period: long>>"


def _dense(keys: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Ranks of rows by their keys, equal rows equal, and how many ranks there are."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    ranks = np.empty(len(order), dtype=np.int32)
    ranks[order] = np.cumsum(new)
    return ranks, int(new.sum()) + 1


class Extensions:
    """Longest common extensions to the right in a sequence whose last number occurs once."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        sampled = (np.arange(0, len(codes), CYCLE)[:, None] + np.array(COVER)).ravel()
        sampled = sampled[sampled < len(codes)]
        levels = self._sort(sampled)
        self.rank = levels[-1]
        order = np.empty(len(sampled), dtype=np.int64)
        order[self.rank] = np.arange(len(sampled))
        self.table = [self._neighbours(sampled, levels, order)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _sort(self, sampled: np.ndarray) -> list[np.ndarray]:
        """Ranks by the first 16, 32, 64, ... words, until all differ."""
        padded = np.concatenate([self.codes, np.full(CYCLE, -1)]).astype(np.int64) + 1
        bits = max(1, int(padded.max()).bit_length())
        each = min(CYCLE, 63 // bits)
        keys = []
        for begin in range(0, CYCLE, each):
            key = np.zeros(len(sampled), dtype=np.int64)
            for k in range(begin, min(begin + each, CYCLE)):
                key = (key << bits) | padded[sampled + k]
            keys.append(key)
        ranks, found = _dense(keys)
        levels = [ranks]
        while found < len(sampled):
            behind = np.full(len(sampled), -1, dtype=np.int64)
            ahead = len(COVER) << (len(levels) - 1)
            behind[:-ahead] = levels[-1][ahead:]
            ranks, found = _dense([levels[-1].astype(np.int64) * (found + 1) + behind + 1])
            levels.append(ranks)
        return levels

    def _neighbours(self, sampled: np.ndarray, levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        """Common prefix of each sampled suffix and the next in order, from the longest level down."""
        one, other = order[:-1].copy(), order[1:].copy()
        length = np.zeros(len(one), dtype=np.int32)
        for level in range(len(levels) - 2, -1, -1):
            ranks = levels[level]
            inside = np.maximum(one, other) < len(ranks)
            same = inside & (ranks[np.minimum(one, len(ranks) - 1)] == ranks[np.minimum(other, len(ranks) - 1)])
            length[same] += CYCLE << level
            one[same] += len(COVER) << level
            other[same] += len(COVER) << level
        one, other = sampled[order[:-1]], sampled[order[1:]]
        at = np.arange(len(one))
        for _ in range(CYCLE - 1):
            a, b = one[at] + length[at], other[at] + length[at]
            inside = np.maximum(a, b) < len(self.codes)
            at, a, b = at[inside], a[inside], b[inside]
            at = at[self.codes[a] == self.codes[b]]
            length[at] += 1
        return length

    def __call__(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many words are equal from each pair of different positions on."""
        shift = _SHIFT[one % CYCLE, other % CYCLE]
        out = np.zeros(len(one), dtype=np.int64)
        at = np.flatnonzero(shift)
        step = 0
        while len(at):
            at = at[self.codes[one[at] + step] == self.codes[other[at] + step]]
            out[at] += 1
            step += 1
            at = at[shift[at] > step]
        at = np.flatnonzero(out == shift)
        a, b = (self.rank[(x // CYCLE) * len(COVER) + _PLACE[x % CYCLE]].astype(np.int64) for x in (one[at] + shift[at], other[at] + shift[at]))
        low, size = np.minimum(a, b), np.abs(a - b)
        row = np.frexp(size.astype(np.float64))[1] - 1  # floor of the binary logarithm
        for k in np.unique(row).tolist():
            this = row == k
            begin, end = low[this], low[this] + size[this] - (1 << k)
            out[at[this]] += np.minimum(self.table[k][begin], self.table[k][end])
        return out


def _grid(n: np.ndarray, base: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All grid neighbours of texts with ``n`` words from ``base`` on: positions and period, in parts of ``most``."""
    half = n // 2
    text = np.repeat(np.arange(len(n)), half)
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    upto = np.cumsum((n[text] - 1) // period) if len(text) else np.zeros(0, dtype=np.int64)
    begins = np.concatenate([[0], upto])[:-1]
    for low in range(0, int(upto[-1]) if len(upto) else 0, most):
        high = min(low + most, int(upto[-1]))
        these = slice(int(np.searchsorted(upto, low, side="right")), int(np.searchsorted(upto, high - 1, side="right")) + 1)
        count = np.minimum(upto[these], high) - np.maximum(begins[these], low)
        point = np.arange(low, high) - np.repeat(begins[these], count)
        periods = np.repeat(period[these], count)
        yield np.repeat(base[text[these]], count) + point * periods, periods


def runs_of(codes: np.ndarray, n: np.ndarray, base: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end, period) of all runs of ``least`` words or more, by start and then period.

    ``codes`` begins and ends with a number that occurs once, and has such a one between texts.
    """
    right, left, last = Extensions(codes), Extensions(codes[::-1]), len(codes) - 1
    found = [np.zeros((0, 3), dtype=np.int64)]
    for one, period in _grid(n, base):
        same = np.flatnonzero(codes[one] == codes[one + period])
        one, period = one[same], period[same]
        other = one + period
        # A stretch of two or more periods and ``least`` words has matches beside this one.
        near = (codes[one - 1] == codes[other - 1]) | (codes[one + 1] == codes[other + 1]) if least > 3 else np.ones(len(one), dtype=bool)
        one, other, period = one[near], other[near], period[near]
        end = other + right(one, other)
        start = one - left(last - one + 1, last - other + 1)
        whole = end - start >= np.maximum(least, 2 * period)
        found.append(_smallest(np.stack([start[whole], end[whole], period[whole]], axis=1)))
    out = _smallest(np.concatenate(found))
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Each stretch once, with its smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def word_numbers(words: Words) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    size = words.ends - words.starts
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    step = np.zeros(len(words.data) + 1, dtype=np.int8)
    step[words.starts] += 1
    step[words.ends] -= 1
    data = words.data[np.cumsum(step[:-1], dtype=np.int8) > 0]
    texts = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return texts.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def find_runs(documents: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id (of its own type), n_words, runs (start, length, period; by start, then
    period), collapsed (the text without what any run repeats after its first period, words joined by one space).

    A run is a stretch of words with smallest period q and ``least`` words or more, and 2q or more, that no
    neighbouring word extends.  Null and empty texts have no words and no runs.  Rows that share an id or
    are equal are separate.  Other columns are not read.  No rows in, no rows out.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for start, stop in slices(offsets):
                words = split_words(data[offsets[start] : offsets[stop]], offsets[start : stop + 1])
                columns = _result(words, least)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *columns], names=["doc_id", "n_words", "runs", "collapsed"])

    own = documents.schema[id_col].dataType.simpleString()
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(search, f"doc_id {own}, n_words long, runs {_RUNS}, collapsed string")


def _result(words: Words, least: int) -> list[pa.Array]:
    n, texts = words.counts, len(words.counts)
    base = words.first[:-1] + np.arange(texts) + 1  # a mark before each text
    numbers = word_numbers(words)
    codes = np.arange(len(numbers) + texts + 1) + len(numbers)  # above all word numbers, each once
    codes[np.arange(len(numbers)) + words.text_of + 1] = numbers
    long = np.flatnonzero(n >= max(least, 2))
    runs = runs_of(codes, n[long], base[long], least) if len(long) else np.zeros((0, 3), dtype=np.int64)
    text = np.searchsorted(base, runs[:, 0], side="right") - 1
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 1], -1)
    gone = (np.cumsum(edge[:-1]) > 0)[np.arange(len(numbers)) + words.text_of + 1]
    kept, bounds = _joined(words, ~gone)
    fields = [pa.array(x) for x in (runs[:, 0] - base[text], runs[:, 1] - runs[:, 0], runs[:, 2])]
    listed = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
    cuts = pa.array(np.searchsorted(text, np.arange(texts + 1)).astype(np.int32))
    collapsed = pa.Array.from_buffers(pa.large_string(), texts, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(kept.tobytes())])
    return [pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(cuts, listed), collapsed.cast(pa.string())]
