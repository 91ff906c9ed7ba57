"""Gapless ranks of any number of rows in a global order."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.tables import store

_ROW_BITS = 33  # monotonically_increasing_id: task above, row below


def ranked(rows: DataFrame, order: list[Column], label: str, name: str = "rank") -> DataFrame:
    """``rows`` with their place in ``order`` as ``name`` (1, 2, 3, ...).

    Rows are sorted by ranges and written with the place inside their range; what goes before a range
    is a sum over as many numbers as there are shuffle partitions.  A range splits anywhere between
    rows that differ in ``order``, so end it with a column that tells all rows apart.  No rows in, no rows out.
    """
    placed = store(rows.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), label)
    part = F.shiftright(name, _ROW_BITS)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    ends = list(accumulate(size.n for size in sizes))
    begins = rows.sparkSession.createDataFrame([(s.part, end - s.n) for s, end in zip(sizes, ends)], "part long, begins long")
    within = F.col(name).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    joined = placed.join(F.broadcast(begins), part == begins.part)
    return joined.select(*(F.col(c) for c in rows.columns if c != name), (within + F.col("begins")).alias(name))
