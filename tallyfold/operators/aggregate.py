"""Roll observation rows up to snapshots, value shares and adoption.

One job covers every run date.  Means and shares sum whole numbers, so partial
results merge exactly in any order; a date that holds a third of all rows only
adds to the map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.fixed_values import CATEGORY_OF, SCORE_COLUMNS
from tallyfold.functions.rounding import mean_of, median_of, ratio

MEANS = {
    "mean_total_cells": "total_cells",
    "mean_code_cells": "code_cells",
    "mean_markdown_cells": "markdown_cells",
    "mean_total_lines": "total_lines",
    "mean_imports": "import_count",
    "mean_outputs": "total_outputs",
}
SHARES = {
    "pct_with_output": "has_any_output",
    "pct_executed_in_order": "fully_executed_in_order",
    "pct_with_widgets": "has_widget_state",
}


def parsed() -> Column:
    return F.col("parse_ok")


def of_parsed(col: Column) -> Column:
    return F.when(parsed(), col)


def mode_label() -> Column:
    """Collection mode of a date; rows that predate the column are daily.

    There are two modes and a date has one, so counting decides it.  A minimum
    over text would make Spark sort all rows instead of hashing them.
    """
    return F.when(F.count_if(F.col("collection_type") == "cohort") > 0, F.lit("cohort")).otherwise(F.lit("daily"))


def volume() -> list[Column]:
    collected, ok = F.count(F.lit(1)), F.count_if(parsed())
    return [
        collected.alias("notebooks_collected"),
        ok.alias("notebooks_parsed"),
        F.coalesce(ratio(ok, collected, 4), F.lit(0.0)).alias("parse_success_rate"),
    ]


def score_summary(scores: tuple[str, ...] = SCORE_COLUMNS) -> list[Column]:
    """Mean and exact median of each score over parsed rows, 4 places."""
    out = []
    for name in scores:
        value = of_parsed(F.col(name))
        out += [mean_of(value, 4, 4).alias(f"{name}_mean"), median_of(value, 4, 4).alias(f"{name}_median")]
    return out


def structure_means() -> list[Column]:
    means = [mean_of(of_parsed(F.col(c)), 0, 3).alias(name) for name, c in MEANS.items()]
    return [*means, F.median(of_parsed(F.col("total_cells"))).alias("median_total_cells")]


def share_of(condition: Column, among: Column, places: int = 4) -> Column:
    """Aggregate: share of rows meeting a condition among rows meeting another."""
    return ratio(F.count_if(among & condition), F.count_if(among), places)


def boolean_shares() -> list[Column]:
    return [share_of(F.col(c), parsed()).alias(name) for name, c in SHARES.items()]


def declares_version() -> Column:
    return parsed() & F.col("python_major_minor").isNotNull() & (F.col("python_major_minor") != "")


def format_mix() -> list[Column]:
    stated = parsed() & F.col("nbformat").isNotNull()
    return [
        mean_of(F.when(stated, F.col("nbformat")), 0, 3).alias("mean_nbformat"),
        share_of(F.col("nbformat") == 4, stated).alias("pct_nbformat_4"),
    ]


def contributors(observations: DataFrame) -> DataFrame:
    """Distinct repositories and strata per date, over all rows.

    Repeats are combined before anything is counted, and each count is grouped
    by (date, value) first, so a hot date spreads over all tasks.
    """
    return observations.groupBy("run_date").agg(
        F.countDistinct("repo_full_name").alias("repos_contributing"),
        F.countDistinct("stratum").alias("strata_sampled"),
    )


def daily_snapshot(observations: DataFrame, run_dates: DataFrame | None = None, mode: str = "daily") -> DataFrame:
    """One row per run date; a frame of ``run_dates`` adds dates without rows,
    which are of the given mode."""
    return filled(measured_days(observations).join(contributors(observations), "run_date"), run_dates, mode)


def measured_days(observations: DataFrame) -> DataFrame:
    """The figures of each run date that one pass of partial aggregates gives."""
    declared = ratio(F.count_if(declares_version()), F.count_if(parsed()), 4)
    return observations.groupBy("run_date").agg(
        mode_label().alias("collection_type"),
        *volume(),
        *score_summary(),
        *structure_means(),
        *boolean_shares(),
        declared.alias("pct_with_python_version"),
        *format_mix(),
    )


def filled(snapshot: DataFrame, run_dates: DataFrame | None, mode: str) -> DataFrame:
    """The snapshot with a row for each of ``run_dates``; dates without rows have counts of 0."""
    if run_dates is None:
        return snapshot
    empty = {c: 0 for c in ("notebooks_collected", "notebooks_parsed", "repos_contributing", "strata_sampled")}
    return run_dates.join(snapshot, "run_date", "left").fillna({**empty, "parse_success_rate": 0.0, "collection_type": mode})


def value_share(observations: DataFrame, value: str, among: Column | None = None, keys: tuple[str, ...] = ("run_date",)) -> DataFrame:
    """Percentage of each value per date among rows that state one, long form.

    Rows are counted under a condition rather than filtered first: a filter
    would be pushed below the projections that compute ``value`` and repeat
    them.  The window runs over already counted values, a handful per date.
    """
    stated = F.col(value).isNotNull() & (F.col(value) != "")
    if among is not None:
        stated = stated & among
    counted = observations.groupBy(*keys, value).agg(F.count_if(stated).alias("n")).where(F.col("n") > 0)
    whole = F.sum("n").over(Window.partitionBy(*keys))
    return counted.select(*keys, F.col(value).alias("value"), "n", ratio(F.col("n"), whole, 2, 100).alias("pct"))


def version_share(observations: DataFrame, language: str | None = None) -> DataFrame:
    """Stated versions of parsed rows, of any language unless one is named."""
    among = parsed() if language is None else parsed() & (F.col("language") == language)
    return value_share(observations, "python_major_minor", among)


def version_columns(shares: DataFrame, versions: list[str]) -> DataFrame:
    """The long shares as one ``pyver_<major>_<minor>_pct`` column per version."""
    named = F.concat(F.lit("pyver_"), F.replace("value", F.lit("."), F.lit("_")), F.lit("_pct"))
    names = [f"pyver_{v.replace('.', '_')}_pct" for v in versions]
    return shares.withColumn("name", named).groupBy("run_date").pivot("name", names).agg(F.max("pct"))


def library_adoption(
    observations: DataFrame, categories: dict[str, str] = CATEGORY_OF, run_dates: DataFrame | None = None, mode: str = "daily"
) -> DataFrame:
    """Dense adoption: a row per date and known library, unseen ones with 0.

    All flags are summed in one pass per date and the sums turned into rows.
    """
    known = sorted(categories)
    counts = observations.groupBy("run_date").agg(
        mode_label().alias("collection_type"),
        F.count_if(parsed()).alias("parsed"),
        *[F.count_if(parsed() & F.col(f"lib_{name}")).alias(name) for name in known],
    )
    if run_dates is not None:
        counts = run_dates.join(counts, "run_date", "left")
        counts = counts.fillna({**dict.fromkeys([*known, "parsed"], 0), "collection_type": mode})
    return value_rows(counts, categories)


def value_rows(counts: DataFrame, categories: dict[str, str], keys: tuple[str, ...] = ("run_date",)) -> DataFrame:
    """A row for each library, from one column of counts each."""
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("library"), F.lit(categories[name]).alias("category"), F.col(name).alias("notebook_count"))
            for name in sorted(categories)
        ]
    )
    rows = counts.select(*keys, "collection_type", "parsed", F.inline(entries))
    pct = F.coalesce(ratio(F.col("notebook_count"), F.col("parsed"), 3, 100), F.lit(0.0))
    return rows.withColumn("adoption_pct", pct).drop("parsed")


def aggregate_days(
    observations: DataFrame, run_dates: DataFrame | None = None, mode: str = "daily"
) -> tuple[DataFrame, DataFrame]:
    """Snapshot and adoption of every date in the input, which is of one mode per date."""
    return daily_snapshot(observations, run_dates, mode), library_adoption(observations, run_dates=run_dates, mode=mode)


def category_rollup(latest_adoption: DataFrame) -> DataFrame:
    grouped = latest_adoption.groupBy("category").agg(F.sum("notebook_count").alias("notebook_count"))
    return grouped.where(F.col("notebook_count") > 0)


