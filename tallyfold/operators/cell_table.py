"""Feature columns from a cell table, for documents whose cells are rows.

``cells`` has a document key, a position and one JSON cell per row.  Nothing
gathers a document: every tally is a partial sum, execution order is compared
inside blocks of positions and then between block ends, so a document that
holds a third of all cells is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.operators.parse import cell_parts, measured_cell, text_ratios, typed_cell

BLOCK = 4096


def typed_cells(cells: DataFrame, key: str, position: str, cell: str = "cell") -> DataFrame:
    """Cell rows with ``kind``, ``lines``, ``chars``, ``blank``, ``tags`` and counts."""
    read = cells.select(key, position, cell_parts(F.parse_json(cell)).alias("parts"))
    read = read.select(key, position, typed_cell(F.col("parts")).alias("typed"))
    return read.select(key, position, measured_cell(F.col("typed")).alias("typed")).select(key, position, "typed.*")


def _sum(col: Column, among: Column | None = None) -> Column:
    value = col if among is None else F.when(among, col)
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def _tallies() -> list[Column]:
    is_object, kind = F.col("is_object"), F.col("kind")
    named = F.coalesce(kind.isin("code", "markdown", "raw"), F.lit(False))
    return [
        F.count_if(is_object).cast("int").alias("total_cells"),
        F.count_if(kind == "code").cast("int").alias("code_cells"),
        F.count_if(kind == "markdown").cast("int").alias("markdown_cells"),
        F.count_if(kind == "raw").cast("int").alias("raw_cells"),
        F.count_if(~named).cast("int").alias("other_cells"),
        F.count_if((kind == "code") & F.col("blank")).cast("int").alias("empty_code_cells"),
        _sum(F.col("lines"), is_object).alias("total_lines"),
        _sum(F.col("lines"), kind == "code").alias("code_lines"),
        _sum(F.col("lines"), kind == "markdown").alias("markdown_lines"),
        _sum(F.col("chars"), is_object).alias("total_source_chars"),
    ]


def cell_tallies(typed: DataFrame, key: str) -> DataFrame:
    """Cell, line and character tallies per document."""
    return typed.groupBy(key).agg(*_tallies())


def with_ratios(tallies: DataFrame) -> DataFrame:
    return tallies.withColumns(text_ratios())


def run_count() -> Column:
    """Execution count of a code cell that ran, else null."""
    ran = (F.col("kind") == "code") & (F.col("execution_count") > 0)
    return F.when(ran, F.col("execution_count"))


def executed(typed: DataFrame, key: str, position: str) -> DataFrame:
    runs = typed.select(key, position, run_count().alias("count"))
    return runs.where(F.col("count").isNotNull())


def order_anomalies(runs: DataFrame, key: str, position: str, block: int = BLOCK) -> DataFrame:
    """Adjacent executed pairs whose count does not rise, per document.

    Pairs inside a block of positions are compared there; the ends of the
    blocks, one row per block, give the pairs that straddle two blocks.
    """
    blocked = runs.withColumn("block", F.floor(F.col(position) / block))
    before = F.lag("count").over(Window.partitionBy(key, "block").orderBy(position))
    ends = (
        blocked.withColumn("back", F.col("count") <= before)
        .groupBy(key, "block")
        .agg(
            F.count_if("back").alias("inside"),
            F.min_by("count", position).alias("first"),
            F.max_by("count", position).alias("last"),
        )
    )
    earlier = F.lag("last").over(Window.partitionBy(key).orderBy("block"))
    across = ends.withColumn("across", F.when(F.col("first") <= earlier, 1).otherwise(0))
    return across.groupBy(key).agg(F.sum(F.col("inside") + F.col("across")).cast("int").alias("execution_order_anomalies"))


def _in_order(cells: DataFrame, key: str, position: str, tallies: list[Column], block: int = BLOCK) -> DataFrame:
    """Tallies, and the spread and order of ``run`` (null: did not run), per document.

    Blocks of positions are compared inside and summed, then the blocks of a
    document are compared and summed.  Different numbers are counted apart, by hashes that
    are combined before the shuffle: a million cells with one number are one row a task.
    """
    within = Window.partitionBy(key, "block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("run", ignorenulls=True).over(within)
    ran_at = F.when(F.col("run").isNotNull(), F.col(position))
    marked = cells.withColumn("block", F.floor(F.col(position) / block))
    blocks = (
        marked.withColumn("back", F.col("run") <= before)
        .groupBy(key, "block")
        .agg(
            *tallies,
            F.count("run").alias("n"),
            F.min("run").alias("low"),
            F.max("run").alias("high"),
            F.count_if("back").alias("inside"),
            F.min_by("run", ran_at).alias("first"),
            F.max_by("run", ran_at).alias("last"),
        )
    )
    until = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.last("last", ignorenulls=True).over(until)
    joined = blocks.withColumn("across", F.when(F.col("first") <= earlier, 1).otherwise(0))
    kinds = dict(blocks.dtypes)
    summed = [c for c in blocks.columns if c not in (key, "block", "low", "high", "inside", "first", "last")]
    documents = joined.groupBy(key).agg(
        *[F.sum(c).cast(kinds[c]).alias(c) for c in summed],
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum(F.col("inside") + F.col("across")).cast("int").alias("execution_order_anomalies"),
    )
    counted = different_numbers(cells, key).withColumnRenamed(key, "counted_key")
    with_numbers = documents.join(counted, documents[key].eqNullSafe(counted.counted_key), "left").drop("counted_key")
    return with_numbers.withColumn("different", F.coalesce("different", F.lit(0)))


def different_numbers(cells: DataFrame, key: str) -> DataFrame:
    """How many different numbers the executed cells of a document carry."""
    numbers = cells.where(F.col("run").isNotNull()).groupBy(key, "run").agg(F.lit(1).alias("one"))
    return numbers.groupBy(key).agg(F.sum("one").alias("different"))


def _execution_columns(rows: DataFrame) -> DataFrame:
    """Columns on the run from its spread and its anomalies.

    The counts are 1..n exactly when they are n different numbers with
    smallest 1 and largest n; a clean run also has no anomaly.
    """
    ran = F.col("n") > 0
    whole = ran & (F.col("n") == F.col("different")) & (F.col("low") == 1) & (F.col("high") == F.col("n"))
    return rows.withColumns(
        {
            "executed_code_cells": F.col("n").cast("int"),
            "max_execution_count": F.coalesce("high", F.lit(0).cast("bigint")),
            "has_execution_gaps": ran & ~F.coalesce(whole, F.lit(False)),
            "fully_executed_in_order": F.coalesce(whole & (F.col("execution_order_anomalies") == 0), F.lit(False)),
        }
    ).drop("n", "different", "low", "high")


def execution_profile(typed: DataFrame, key: str, position: str) -> DataFrame:
    """Executed cells, largest count, anomalies, gaps and clean runs of every
    document in which something ran."""
    runs = executed(typed, key, position).withColumnRenamed("count", "run")
    return _execution_columns(_in_order(runs, key, position, []))


def cell_table_features(typed: DataFrame, key: str, position: str) -> DataFrame:
    """Tallies, ratios and execution columns of every document in the table."""
    cells = typed.withColumn("run", run_count())
    return with_ratios(_execution_columns(_in_order(cells, key, position, _tallies())))
