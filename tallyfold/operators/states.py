"""Partial aggregates of observations that can be stored and merged.

A state is one row for any set of observations, say a batch of a date: counts
and whole sums, the exact histogram of every score and cell count (value to
count; a score has at most 10,001 values), the counts of stated versions, and sketches
of the repositories and strata.  States of disjoint sets merge by adding up, so
the figures of a week or a year, exact medians included, come from stored states alone,
and a batch that arrives late is aggregated alone.  Distinct counts of merged
sketches are estimates: with ``LOG_BUCKETS`` their standard error is 0.9 %.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.fixed_values import CATEGORY_OF, SCORE_COLUMNS
from tallyfold.functions.rounding import ratio, scaled
from tallyfold.operators.aggregate import MEANS, SHARES, declares_version, filled, of_parsed, parsed, value_rows

LOG_BUCKETS = 14
KEYS = ("run_date", "collection_type")


@dataclass(frozen=True)
class Measures:
    """What is aggregated: score columns, means of whole numbers, medians of whole numbers and shares of
    booleans by result name, and libraries with their category."""

    scores: tuple[str, ...] = SCORE_COLUMNS
    means: dict[str, str] = field(default_factory=lambda: dict(MEANS))
    medians: dict[str, str] = field(default_factory=lambda: {"median_total_cells": "total_cells"})
    shares: dict[str, str] = field(default_factory=lambda: dict(SHARES))
    libraries: dict[str, str] = field(default_factory=lambda: dict(CATEGORY_OF))

    @property
    def histograms(self) -> dict[str, Column]:
        """Columns whose values are counted, in whole units."""
        cells = {c: F.col(c).cast("bigint") for c in self.medians.values()}
        return {**{s: scaled(F.col(s), 4) for s in self.scores}, **cells}


CENSUS = Measures()


def day_states(observations: DataFrame, keys: tuple[str, ...] = KEYS, measures: Measures = CENSUS) -> DataFrame:
    """One state for each value of ``keys``.  Values are counted by hash before they are put into a map."""
    stated = parsed() & F.col("nbformat").isNotNull()
    counts = {
        "collected_n": F.count(F.lit(1)),
        "parsed_n": F.count_if(parsed()),
        "declared_n": F.count_if(declares_version()),
        "nbformat_n": F.count_if(stated),
        "nbformat_sum": F.coalesce(F.sum(F.when(stated, F.col("nbformat").cast("bigint"))), F.lit(0)),
        "nbformat_4_n": F.count_if(stated & (F.col("nbformat") == 4)),
        **{f"{c}_n": F.count_if(parsed() & F.col(c)) for c in measures.shares.values()},
        **{f"{c}_values_n": F.count(of_parsed(F.col(c))) for c in measures.means.values()},
        **{f"{c}_sum": F.coalesce(F.sum(of_parsed(F.col(c).cast("bigint"))), F.lit(0)) for c in measures.means.values()},
        **{f"lib_{name}_n": F.count_if(parsed() & F.col(f"lib_{name}")) for name in sorted(measures.libraries)},
        "repos_sketch": F.hll_sketch_agg("repo_full_name", F.lit(LOG_BUCKETS)),
        "strata_sketch": F.hll_sketch_agg("stratum", F.lit(LOG_BUCKETS)),
    }
    counted = observations.groupBy(*keys).agg(*[c.alias(name) for name, c in counts.items()])
    version = F.struct(F.lit("version").alias("name"), F.lit(None).cast("bigint").alias("value"), F.when(declares_version(), F.col("python_major_minor")).alias("text"))
    values = [F.struct(F.lit(name).alias("name"), of_parsed(value).alias("value"), F.lit(None).cast("string").alias("text")) for name, value in measures.histograms.items()]
    long = observations.select(*keys, F.inline(F.array(*values, version))).where("value IS NOT NULL OR text IS NOT NULL")
    return joined(counted, _maps(long.groupBy(*keys, "name", "value", "text").agg(F.count("*").alias("n")), keys, measures), keys)


def _maps(counted: DataFrame, keys: tuple[str, ...], measures: Measures) -> DataFrame:
    """Counted values (keys, name, value, text, n) as one map a column, which is as long as its domain."""
    maps = [_map_of(F.col("name") == name, "value").alias(f"hist_{name}") for name in measures.histograms]
    return counted.groupBy(*keys).agg(*maps, _map_of(F.col("name") == "version", "text").alias("versions"))


def _map_of(condition: Column, key: str) -> Column:
    return F.map_from_entries(F.collect_list(F.when(condition, F.struct(F.col(key), F.col("n")))))


def joined(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Left join of two aggregates, null keys included."""
    named = right.withColumnsRenamed({k: f"right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(named[f"right_{k}"])
    return left.join(named, same, "left").drop(*[f"right_{k}" for k in keys])


def _values(states: DataFrame, keys: tuple[str, ...], measures: Measures) -> DataFrame:
    """All histogram entries: keys, name, value, n."""
    entries = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"hist_{name}").alias("entries")) for name in measures.histograms])
    return states.select(*keys, F.inline(entries)).select(*keys, "name", F.explode("entries").alias("value", "n"))


def summary(states: DataFrame, keys: tuple[str, ...] = KEYS, measures: Measures = CENSUS) -> DataFrame:
    """Merged states as figures, one row for each value of ``keys``: those of a snapshot, and ``repos_estimate`` and
    ``strata_estimate``.  Medians are exact; they are taken of histogram entries with their counts."""
    sums = [c for c in states.columns if c.endswith(("_n", "_sum"))]
    sketches = ("repos", "strata")
    merged = states.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.hll_sketch_estimate(F.hll_union_agg(f"{s}_sketch")).alias(f"{s}_estimate") for s in sketches],
    )
    n, value = F.col("n"), F.col("value")
    middle = _values(states, keys, measures).groupBy(*keys, "name").agg(
        F.sum(value * n).alias("total"), F.sum(n).alias("n"), F.percentile(value, F.lit(0.5), n).alias("median")
    )
    mean = F.round(F.col("total").cast("double") / F.col("n").cast("double"), 0) / F.lit(1e4)
    named = {f"{s}_mean": (s, mean) for s in measures.scores} | {f"{s}_median": (s, F.round("median", 0) / F.lit(1e4)) for s in measures.scores}
    named |= {name: (c, F.col("median")) for name, c in measures.medians.items()}
    wide = middle.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == c, figure)).alias(name) for name, (c, figure) in named.items()])
    rows = joined(merged, wide, keys)
    scores = [c for s in measures.scores for c in (f"{s}_mean", f"{s}_median")]
    return rows.select(
        *keys,
        F.col("collected_n").alias("notebooks_collected"),
        F.col("parsed_n").alias("notebooks_parsed"),
        F.coalesce(ratio(F.col("parsed_n"), F.col("collected_n"), 4), F.lit(0.0)).alias("parse_success_rate"),
        *scores,
        *[ratio(F.col(f"{c}_sum"), F.col(f"{c}_values_n"), 3).alias(name) for name, c in measures.means.items()],
        *measures.medians,
        *[ratio(F.col(f"{c}_n"), F.col("parsed_n"), 4).alias(name) for name, c in measures.shares.items()],
        ratio(F.col("declared_n"), F.col("parsed_n"), 4).alias("pct_with_python_version"),
        ratio(F.col("nbformat_sum"), F.col("nbformat_n"), 3).alias("mean_nbformat"),
        ratio(F.col("nbformat_4_n"), F.col("nbformat_n"), 4).alias("pct_nbformat_4"),
        *[f"{s}_estimate" for s in sketches],
    )


def snapshot(states: DataFrame, exact: DataFrame, run_dates: DataFrame | None = None, mode: str = "daily", measures: Measures = CENSUS) -> DataFrame:
    """The snapshot of each run date, as ``aggregate.daily_snapshot`` gives it, from states of one mode and the
    exact distinct counts of the dates."""
    rows = summary(states, ("run_date",), measures).drop("repos_estimate", "strata_estimate").join(exact, "run_date")
    first = ["run_date", "collection_type"]
    rows = rows.withColumn("collection_type", F.lit(mode))
    return filled(rows.select(*first, *[c for c in rows.columns if c not in first]), run_dates, mode)


def adoption(states: DataFrame, keys: tuple[str, ...] = ("run_date",), run_dates: DataFrame | None = None, mode: str = "daily", measures: Measures = CENSUS) -> DataFrame:
    """Dense library adoption of merged states, as ``aggregate.library_adoption`` gives it."""
    known = sorted(measures.libraries)
    sums = [F.sum("parsed_n").alias("parsed"), *[F.sum(f"lib_{name}_n").alias(name) for name in known]]
    counts = states.groupBy(*keys).agg(F.lit(mode).alias("collection_type"), *sums)
    if run_dates is not None:
        counts = run_dates.join(counts, "run_date", "left").fillna({**dict.fromkeys([*known, "parsed"], 0), "collection_type": mode})
    return value_rows(counts, measures.libraries, keys)


def version_shares(states: DataFrame, keys: tuple[str, ...] = ("run_date",)) -> DataFrame:
    """Percentage of each stated version, as ``aggregate.version_share`` gives it."""
    long = states.select(*keys, F.explode("versions").alias("value", "n")).groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    whole = long.groupBy(*keys).agg(F.sum("n").alias("whole"))
    return joined(long, whole, keys).select(*keys, "value", "n", ratio(F.col("n"), F.col("whole"), 2, 100).alias("pct"))


def merged(states: DataFrame, keys: tuple[str, ...] = KEYS, measures: Measures = CENSUS) -> DataFrame:
    """The states of each value of ``keys`` as one state."""
    sums = [F.sum(c).alias(c) for c in states.columns if c.endswith(("_n", "_sum"))]
    sketches = [F.hll_union_agg(f"{s}_sketch").alias(f"{s}_sketch") for s in ("repos", "strata")]
    counted = states.groupBy(*keys).agg(*sums, *sketches)
    none = F.lit(None)
    stated = states.select(*keys, F.explode("versions").alias("text", "n")).select(*keys, F.lit("version").alias("name"), none.cast("bigint").alias("value"), "text", "n")
    long = _values(states, keys, measures).withColumn("text", none.cast("string")).select(*keys, "name", "value", "text", "n").unionByName(stated)
    return joined(counted, _maps(long.groupBy(*keys, "name", "value", "text").agg(F.sum("n").alias("n")), keys, measures), keys)
