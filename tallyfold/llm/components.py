"""Connected components of a link table, by alternating stars.

Links are first contracted inside each task (a task's links become a forest of
stars), then neighbours are hung on the least neighbour, larger ones and smaller
ones in turn, until nothing changes.  The rounds grow with the logarithm of the
longest chain.  Every round is written to the shared folder, and so are the minima
that its hubs are joined with: a join of two tables that were both read is one that
Spark splits at a hub, while behind an aggregation it would keep the hub's links in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.tables import store

_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def components(links: DataFrame, label: str) -> DataFrame:
    """``node, root`` for each node of ``links`` (a, b: BIGINT); the root is the least node it reaches.

    Links with a null end or with equal ends say nothing and are left out; without links there
    are no rows.  Repeated links change nothing.
    """
    ends = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    stars = store(ends.mapInArrow(_contract, "a long, b long"), f"{label}-links")
    before = None
    while (now := _state(stars)) != before:
        before = now
        stars = store(_small_star(_large_star(stars, label)), f"{label}-stars")
    members = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())


def _state(stars: DataFrame) -> tuple:
    """Equal for equal sets of links (distinct, as both star steps leave them)."""
    sums = (F.sum(F.xxhash64("a", "b", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2))
    return tuple(stars.agg(F.count("*"), *sums).first())


def _large_star(stars: DataFrame, label: str) -> DataFrame:
    """Each larger neighbour of a node is hung on the least of the node and its neighbours."""
    both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{label}-least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the least of them.  Links go from large to small."""
    least = stars.groupBy("a").agg(F.min("b").alias("m"))
    moved = stars.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    members = [(x, root(x)) for x in list(parent)]
    members = [(x, r) for x, r in members if x != r]
    for start in range(0, len(members), 50_000):
        part = members[start : start + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(side, type=pa.int64()) for side in zip(*part)], schema=_LINK)
