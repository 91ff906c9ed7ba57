"""Secret scans: regular expressions behind an inverted trigram index.

Each rule's pattern gives a Boolean trigram query.  A task takes its texts in
blocks, indexes the trigrams that the rules ask for, merges the posting lists of
each rule and tries its pattern on the candidates alone; a rule without mandatory
trigrams is tried on all texts.  Postings live as long as their block, so no list
outgrows a task however common a trigram is, nothing is shuffled, and a lost
task is run again by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import trigrams
from tallyfold.llm.words import flat, slices

_SPANS = "array<struct<kind: string, begin: int, end: int>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 1

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.any_case else 0)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for found in re.finditer(self.pattern, text, self.flags):
            if found.end(self.group) - found.start(self.group) >= self.least:
                yield found.span()


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    Rule("access", "AKIA[A-Z0-9]{14,}"),  # 18 characters or more
    Rule("hex", "[0-9a-f]{16,}"),
)
# Published forms of keys; every part has a bound or a marker that cannot recur in it, so texts are read in linear time.
MORE_RULES = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"://[^/:@\x00-\x20]{1,64}:[^/:@\x00-\x20]{1,64}@"),
)


def find_secrets(documents: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id (of its own type) and ``spans`` (kind, begin, end in code points, the
    end exclusive), by begin and then in the order of the rules.

    Spans of one kind do not overlap, those of different kinds may.  Null and empty texts have none.
    Rows that share an id or are equal are separate.  Other columns are not read.  No rows in, no rows out.
    """
    needs = [trigrams.needed(rule.pattern, rule.flags) for rule in rules]
    asked = sorted(frozenset().union(*map(trigrams.all_trigrams, needs)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = trigrams.table_of(asked)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for start, stop in slices(offsets):
                index = trigrams.Postings(data[offsets[start] : offsets[stop]], offsets[start : stop + 1], wanted)
                candidates = [index.texts_with(need) for need in needs]
                found = _verified(batch.column(1).slice(start, stop - start), candidates, rules)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), found], names=["doc_id", "spans"])

    own = documents.schema[id_col].dataType.simpleString()
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(scan, f"doc_id {own}, spans {_SPANS}")


def _verified(texts: pa.Array, candidates: list[np.ndarray], rules: tuple[Rule, ...]) -> pa.Array:
    found: list[list[tuple]] = [[] for _ in range(len(texts))]
    asked: list[list[int]] = [[] for _ in range(len(texts))]
    for nth, numbers in enumerate(candidates):
        for number in numbers.tolist():
            asked[number].append(nth)
    for number, nths in enumerate(asked):
        text = texts[number].as_py() if nths else None
        if text:
            spans = [(begin, nth, end) for nth in nths for begin, end in rules[nth].spans(text)]
            found[number] = [{"kind": rules[nth].kind, "begin": begin, "end": end} for begin, nth, end in sorted(spans)]
    return pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])))
