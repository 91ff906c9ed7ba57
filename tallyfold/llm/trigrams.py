"""Boolean trigram queries of regular expressions, and inverted trigram indexes of blocks of texts.

A trigram is three neighbouring bytes of UTF-8 with A-Z lower-cased, as a number.
What a pattern needs is a tree of ``AllOf`` and ``AnyOf`` over trigrams: every
text with a match meets it, not every text that meets it has a match.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from re import _constants as kind
from re import _parser as parser

import numpy as np

MOST_STRINGS = 64  # spelled out for one part of a pattern; beyond, the part says less
MOST_CLASS = 16  # characters of a class that are spelled out

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class AllOf:
    """All trigrams and all parts; empty: no condition."""

    trigrams: frozenset[int] = frozenset()
    parts: tuple[AnyOf, ...] = ()


@dataclass(frozen=True)
class AnyOf:
    parts: tuple[AllOf, ...]


NOTHING = AllOf()


def trigrams_of(text: bytes) -> frozenset[int]:
    return frozenset(int.from_bytes(text[i : i + 3], "big") for i in range(len(text) - 2))


def both(one: AllOf, other: AllOf) -> AllOf:
    return AllOf(one.trigrams | other.trigrams, one.parts + tuple(p for p in other.parts if p not in one.parts))


def either(needs: Iterable[AllOf]) -> AllOf:
    """Parts that ask for more than another are left out; if one asks for nothing, nothing is asked."""
    parts = sorted(set(needs), key=lambda n: (len(n.trigrams), len(n.parts), sorted(n.trigrams)))
    least: list[AllOf] = []
    for part in parts:
        if not any(n.trigrams <= part.trigrams and set(n.parts) <= set(part.parts) for n in least):
            least.append(part)
    if len(least) == 1:
        return least[0]
    return AllOf(parts=(AnyOf(tuple(least)),)) if least else NOTHING


@dataclass(frozen=True)
class Said:
    """What is known of all strings that a part matches: all of them (``exact``) or how they begin and
    end, and the trigrams inside."""

    exact: frozenset[bytes] | None
    begins: frozenset[bytes] = frozenset([b""])
    ends: frozenset[bytes] = frozenset([b""])
    inside: AllOf = NOTHING

    @property
    def first(self) -> frozenset[bytes]:
        return self.begins if self.exact is None else self.exact

    @property
    def last(self) -> frozenset[bytes]:
        return self.ends if self.exact is None else self.exact

    @property
    def need(self) -> AllOf:
        return self.inside if self.exact is None else spelled(self.exact)


UNKNOWN, EMPTY = Said(None), Said(frozenset([b""]))


def spelled(strings: Iterable[bytes]) -> AllOf:
    return either(AllOf(trigrams_of(s)) for s in strings)


def joined(left: frozenset[bytes], right: frozenset[bytes]) -> frozenset[bytes] | None:
    return frozenset(a + b for a in left for b in right) if len(left) * len(right) <= MOST_STRINGS else None


def after(one: Said, other: Said) -> Said:
    if one.exact is not None and other.exact is not None:
        exact = joined(one.exact, other.exact)
        if exact is not None:
            return Said(exact)
    between = joined(one.last, other.first)
    inside = both(both(one.need, other.need), NOTHING if between is None else spelled(between))
    begins = joined(one.exact, other.first) if one.exact is not None else one.begins
    ends = joined(one.last, other.exact) if other.exact is not None else other.ends
    return Said(None, begins or frozenset(s[:2] for s in one.first), ends or frozenset(s[-2:] for s in other.last), inside)


def one_of(choices: list[Said]) -> Said:
    if all(c.exact is not None for c in choices):
        exact = frozenset().union(*(c.exact for c in choices))
        if len(exact) <= MOST_STRINGS:
            return Said(exact)
    return Said(None, frozenset().union(*(c.first for c in choices)), frozenset().union(*(c.last for c in choices)), either(c.need for c in choices))


def _folded(code: int, ignore_case: bool) -> frozenset[bytes]:
    """A character as bytes, A-Z lower-cased; with ``ignore_case`` letters beyond ASCII may have any case."""
    char = chr(code)
    if code > 127 and ignore_case:
        return frozenset(c.encode() for c in {char, char.lower(), char.upper()})
    return frozenset([char.lower().encode() if code < 128 else char.encode("utf-8", "surrogatepass")])


def _class(items: list, ignore_case: bool) -> Said:
    found: set[bytes] = set()
    for op, value in items:
        if op is kind.LITERAL:
            found |= _folded(value, ignore_case)
        elif op is kind.RANGE and value[1] - value[0] <= 2 * MOST_CLASS:
            for code in range(value[0], value[1] + 1):
                found |= _folded(code, ignore_case)
        else:
            return UNKNOWN
    return Said(frozenset(found)) if len(found) <= MOST_CLASS else UNKNOWN


def _sequence(items: Iterable, ignore_case: bool) -> Said:
    out = EMPTY
    for op, value in items:
        out = after(out, _part(op, value, ignore_case))
    return out


def _part(op, value, ignore_case: bool) -> Said:
    if op is kind.LITERAL:
        return Said(_folded(value, ignore_case))
    if op is kind.IN:
        return _class(value, ignore_case)
    if op is kind.BRANCH:
        return one_of([_sequence(choice, ignore_case) for choice in value[1]])
    if op is kind.SUBPATTERN:
        return _sequence(value[3], (ignore_case or bool(value[1] & re.IGNORECASE)) and not value[2] & re.IGNORECASE)
    if op is kind.ATOMIC_GROUP:
        return _sequence(value, ignore_case)
    if op in (kind.MAX_REPEAT, kind.MIN_REPEAT, kind.POSSESSIVE_REPEAT):
        least, most, items = value
        once = _sequence(items, ignore_case)
        if most == 1:
            return one_of([once, EMPTY]) if least == 0 else once
        if least == 0:
            return UNKNOWN
        out = once
        for _ in range(min(least, 4) - 1):
            out = after(out, once)
        return out if least == most <= 4 else after(after(out, UNKNOWN), Said(None, frozenset([b""]), once.last))
    if op in (kind.AT, kind.ASSERT, kind.ASSERT_NOT):
        return EMPTY
    return UNKNOWN


def needed(pattern: str, flags: int = 0) -> AllOf:
    """What every text with a match of ``pattern`` holds (``NOTHING``: the pattern has to be tried on all texts).

    Under IGNORECASE without ASCII, ASCII letters may match others (such as U+017F for s): ask for both flags.
    """
    tree = parser.parse(pattern, flags)
    flags = tree.state.flags
    if flags & re.IGNORECASE and not flags & re.ASCII:
        return NOTHING
    return _sequence(tree, bool(flags & re.IGNORECASE)).need


def all_trigrams(need: AllOf) -> frozenset[int]:
    return need.trigrams.union(*(all_trigrams(choice) for part in need.parts for choice in part.parts))


class Postings:
    """An inverted index of one block of texts: for each wanted trigram, the numbers of the texts that hold it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray):
        """``wanted`` has a true for each trigram to index (2^24 places)."""
        self.texts = len(offsets) - 1
        self.lists: dict[int, np.ndarray] = {}
        offsets = offsets - offsets[0]
        if len(data) < 3:
            return
        folded = _FOLD[data]
        code = (folded[:-2] << np.uint32(16)) | (folded[1:-1] << np.uint32(8)) | folded[2:]
        at = np.flatnonzero(wanted[code])
        text = np.searchsorted(offsets, at, side="right") - 1
        whole = at + 3 <= offsets[text + 1]
        pairs = np.unique((code[at[whole]].astype(np.int64) << 32) | text[whole])
        trigram = pairs >> 32
        cuts = np.flatnonzero(np.diff(trigram)) + 1
        for part in np.split(pairs, cuts) if len(pairs) else ():
            self.lists[int(part[0] >> 32)] = part & 0xFFFFFFFF

    def texts_with(self, need: AllOf) -> np.ndarray:
        """Numbers of the texts that meet ``need``, by merging lists, the shortest first."""
        none = np.zeros(0, dtype=np.int64)
        lists = sorted((self.lists.get(t, none) for t in need.trigrams), key=len)
        lists += [np.unique(np.concatenate([self.texts_with(choice) for choice in part.parts])) for part in need.parts]
        if not lists:
            return np.arange(self.texts)
        out = lists[0]
        for other in lists[1:]:
            if not len(out):
                break
            out = np.intersect1d(out, other, assume_unique=True)
        return out


def table_of(trigrams: Iterable[int]) -> np.ndarray:
    wanted = np.zeros(1 << 24, dtype=bool)
    wanted[list(trigrams)] = True
    return wanted
