"""Words, hashes and word windows of many texts at once, as numpy arrays.

Texts come as Arrow columns inside tasks.  A word is a run of bytes other than
space and 0x09-0x0D, so UTF-8 letters stay whole.  Hashes are 64 bits, mixed at
every step; two lanes with separate seeds make a 128-bit identity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
LANES = (0x243F6A8885A308D3, 0x13198A2E03707344)
_LONG_WORD = 256  # bytes; longer words are hashed one by one

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KEEP_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=U64)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values in place (each output bit depends on each input bit)."""
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbours; the order counts."""
    out = left * U64(0x9E3779B97F4A7C15)
    out ^= out >> U64(31)
    out += right
    out *= U64(0xD6E8FEB86659FD93)
    out ^= out >> U64(32)
    return out


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset where each begins (one more than texts); null is empty."""
    column = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or ends[-1] == ends[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with about ``most`` bytes together; a longer text stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


@dataclass
class Words:
    """Words of neighbouring texts; ``first[d]`` is the index of the first word of text ``d``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lane: int) -> np.ndarray:
        """One 64-bit hash for each word, over all of its bytes."""
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        at = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        length = self.ends - self.starts
        h = at[self.starts] & _KEEP_BYTES[np.minimum(length, 8)]
        h ^= U64(LANES[lane])
        h += length.astype(U64) * U64(0x9E3779B97F4A7C15)
        mix(h)
        for i in np.flatnonzero(length > _LONG_WORD):
            word = self.data[self.starts[i] : self.ends[i]].tobytes()
            digest = hashlib.blake2b(word, digest_size=8, key=LANES[lane].to_bytes(8, "little")).digest()
            h[i] = int.from_bytes(digest, "little")
        rest = np.flatnonzero((length > 8) & (length <= _LONG_WORD))
        done = 8
        while len(rest):
            left = length[rest] - done
            block = at[self.starts[rest] + done] & _KEEP_BYTES[np.minimum(left, 8)]
            h[rest] = mix(chain(h[rest], block))
            done += 8
            rest = rest[left > 8]
        return h

    def windows(self, n: int) -> np.ndarray:
        """For each word but the last n-1: is the window of n words from it inside one text?"""
        if len(self.starts) < n:
            return np.zeros(0, dtype=bool)
        text_of = self.text_of
        return text_of[: len(text_of) - n + 1] == text_of[n - 1 :]


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Find the words of the texts ``data[offsets[d]:offsets[d+1]]``; ``lower`` maps A-Z first."""
    data = _LOWER[data] if lower else data
    offsets = offsets - offsets[0]
    n = len(data)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return Words(data, offsets, empty, empty, np.zeros(len(offsets), dtype=np.int64))
    space = _SPACE[data]
    opens = np.empty(n, dtype=bool)
    opens[0] = True
    opens[1:] = space[:-1]
    opens[offsets[:-1][offsets[:-1] < n]] = True
    closes = np.empty(n, dtype=bool)
    closes[-1] = True
    closes[:-1] = space[1:]
    closes[offsets[1:] - 1] = True  # -1 (no text yet) is the last byte, which is set anyway
    starts = np.flatnonzero(opens & ~space)
    ends = np.flatnonzero(closes & ~space) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n neighbours, by doubling; its length is len(hashes) - n + 1."""
    if len(hashes) < n:
        return np.zeros(0, dtype=U64)
    whole, covered, power, size = None, 0, hashes, 1
    while True:
        if n & size:
            rest = power[covered : covered + len(hashes) - n + 1] if whole is not None or size != n else power
            whole = rest if whole is None else chain(whole[: len(rest)], rest)
            covered += size
        if 2 * size > n:
            return whole[: len(hashes) - n + 1]
        power = chain(power[:-size], power[size:])
        size *= 2


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Least of every n neighbours, by doubling."""
    if len(values) < n:
        return values[:0]
    size, least = 1, values
    while 2 * size <= n:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(values) - n + 1], least[n - size : n - size + len(values) - n + 1])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> Iterator[list[np.ndarray]]:
    """For each text, the sorted distinct hashes of its n-word shingles, A-Z lower-cased; in lists of neighbours.

    A text of fewer words has one: its whole sequence; a text of no words has none.
    """
    for start, stop in slices(offsets):
        words = split_words(data[offsets[start] : offsets[stop]], offsets[start : stop + 1], lower=True)
        lane = words.hashes(0)
        shingles = grams(lane, n)
        sets = []
        for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if last - first >= n:
                sets.append(np.unique(shingles[first : last - n + 1]))
            elif last > first:
                whole = lane[first : first + 1] ^ U64(last - first)
                for k in range(first + 1, last):
                    whole = chain(whole, lane[k : k + 1])
                sets.append(mix(whole.copy()))
            else:
                sets.append(np.zeros(0, dtype=U64))
        yield sets


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as a column of BIGINT."""
    return pa.array(np.ascontiguousarray(values).view(np.int64), type=pa.int64())
