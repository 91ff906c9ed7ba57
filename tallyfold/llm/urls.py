"""URL rules by a sort-merge range join.

A host's labels, last one first and each followed by a dot, make its key:
``example.net`` is ``net.example.``.  A rule's host and all its subdomains are then
the keys that start with the rule's key, one interval.  Pages and rules are dealt
into ranges of (key, a hash of the page), each rule to every range its interval meets, so
a hot host, even a hot URL, lies in many ranges.  A range is sorted and swept
once, with a stack of the rules whose intervals are open.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SAMPLED = 32  # keys drawn for each range, to place its bounds
_LAST = "\U0010ffff"

_ROW = "range int, key string, page boolean, page_id long, host string, path string, verdict string"
_OUT = "page_id long, host string, path string, rule string, verdict string"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def judge_pages(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path of the one that decides, else null), verdict.

    ``rules`` has host, path and verdict.  A rule fits its host and all subdomains if the page's path
    starts with the rule's.  The longest (host and path together) decides; of equally long ones
    that with the longer host; of equal ones the last verdict in the alphabet, so block before
    allow.  Without a fitting rule the verdict is ``default``.  Null URLs, and those without ``://``,
    have empty host and path.  Rules with a null host or verdict are ignored, a null path is empty.
    Other columns are not read.  No pages in, no rows out; no rules, default verdicts.
    Page ids are whole numbers.
    """
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keyed = keyed.withColumn("key", host_key(F.col("host"))).withColumn("spread", F.xxhash64("page_id", "path"))
    lawful = rules.where("host IS NOT NULL AND verdict IS NOT NULL").select(
        F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    lawful = lawful.distinct().withColumn("key", host_key(F.col("host")))
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(keyed, n)
    rows = keyed.select("key", "spread", "page_id", "host", "path").mapInArrow(_place_pages(cuts), _ROW)
    spans = lawful.select("key", "host", "path", "verdict").mapInArrow(_place_rules(cuts), _ROW)
    dealt = rows.unionByName(spans).repartitionById(n, "range").sortWithinPartitions("range", "key", "page")
    return dealt.mapInArrow(_sweep(default), _OUT)


def _cuts(keyed: DataFrame, n: int) -> list[tuple[str, int]]:
    """Bounds of n ranges with about as many pages each, from a bounded draw; they move work, never results."""
    drawn = keyed.select("key", "spread").orderBy(F.xxhash64("spread"), "spread", "key").limit(_SAMPLED * n).collect()
    keys = sorted((r.key, r.spread) for r in drawn)
    return [keys[len(keys) * i // n] for i in range(1, n)] if keys else []


def _place_pages(cuts: list[tuple[str, int]]) -> Callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranges = [bisect_right(cuts, at) for at in zip(b.column("key").to_pylist(), b.column("spread").to_pylist())]
            columns = [pa.array(ranges, pa.int32()), b.column("key"), pa.array([True] * len(b), pa.bool_()), b.column("page_id"), b.column("host"), b.column("path"), pa.nulls(len(b), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "key", "page", "page_id", "host", "path", "verdict"])

    return place


def _place_rules(cuts: list[tuple[str, int]]) -> Callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rule in b.to_pylist():
                low, high = bisect_left(cuts, (rule["key"], -(1 << 63))), bisect_right(cuts, (rule["key"] + _LAST, 1 << 63))
                n = high - low + 1
                columns = [pa.array(range(low, high + 1), pa.int32()), pa.array([rule["key"]] * n), pa.array([False] * n), pa.nulls(n, pa.int64())]
                columns += [pa.array([rule[k]] * n) for k in ("host", "path", "verdict")]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "key", "page", "page_id", "host", "path", "verdict"])

    return place


class _Open:
    """The rules of one host while the sweep is inside its interval."""

    def __init__(self, key: str):
        self.key, self.by_path, self.lengths = key, {}, []

    def add(self, host: str, path: str, verdict: str) -> None:
        if path not in self.by_path or verdict > self.by_path[path][1]:
            self.by_path[path] = (host, verdict)
        if len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)

    def longest(self, path: str) -> str | None:
        return next((path[:n] for n in self.lengths if n <= len(path) and path[:n] in self.by_path), None)


def _sweep(default: str) -> Callable:
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Open] = []
        current = None
        for batch in batches:
            rules, verdicts, pages = [], [], []
            columns = (batch.column(k).to_pylist() for k in ("range", "key", "page", "host", "path", "verdict"))
            for i, (where, key, page, host, path, verdict) in enumerate(zip(*columns)):
                if where != current:
                    stack, current = [], where
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if not page:
                    if not stack or stack[-1].key != key:
                        stack.append(_Open(key))
                    stack[-1].add(host, path, verdict)
                    continue
                best, decided = (-1, -1), (None, default)
                for rule in stack:
                    fits = rule.longest(path)
                    if fits is not None:
                        of, says = rule.by_path[fits]
                        if (len(of) + len(fits), len(of)) > best:
                            best, decided = (len(of) + len(fits), len(of)), (of + fits, says)
                pages.append(i)
                rules.append(decided[0])
                verdicts.append(decided[1])
            if pages:
                kept = batch.select(["page_id", "host", "path"]).take(pa.array(pages, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], schema=schema)

    return sweep
