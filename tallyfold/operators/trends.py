"""History queries over the snapshot and adoption tables.

These tables hold one row per date and (date, library).  Latest-date and
fallback choices are scalar subqueries, so nothing is fetched to the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.fixed_values import (
    KEY_LIBRARIES, SCORE_COLUMNS, STRUCTURE_COLUMNS, TREND_DIRECTIONS, TREND_INDICATORS, TREND_LIBRARIES, TREND_POINTS, TREND_SENTENCE,
)


def mode() -> Column:
    return F.coalesce(F.col("collection_type"), F.lit("daily"))


def prefer_mode(rows: DataFrame, wanted: str, fallback: str | None = None) -> DataFrame:
    """Rows of the wanted mode, or of the fallback (all, if None) when there are none."""
    if "collection_type" not in rows.columns:
        rows = rows.withColumn("collection_type", F.lit("daily"))
    present = rows.agg(F.count_if(mode() == wanted) > 0).scalar()
    other = F.lit(True) if fallback is None else mode() == fallback
    return rows.where((mode() == wanted) | (~present & other))


def latest_rows(rows: DataFrame, date: str = "run_date") -> DataFrame:
    return rows.where(F.col(date) == rows.agg(F.max(date)).scalar())


def latest_delta(snapshots: DataFrame, value: str, date: str = "run_date") -> DataFrame:
    """Latest value, the one before it, and their difference (0 for a single run)."""
    pair = snapshots.select(date, value).orderBy(F.desc(date)).limit(2)
    ends = pair.agg(
        F.max(date).alias(date), F.max_by(value, date).alias("latest"), F.min_by(value, date).alias("previous")
    )
    return ends.withColumn("delta", F.col("latest") - F.col("previous"))


def adoption_series(adoption: DataFrame, libraries: tuple[str, ...] = TREND_LIBRARIES) -> DataFrame:
    """Shares by date of chosen libraries; they are independent and do not add up."""
    return adoption.where(F.col("library").isin(*libraries)).select("run_date", "library", "adoption_pct")


def volume_series(snapshots: DataFrame) -> DataFrame:
    """Sample volume by date; the title says whether all rows are cohorts."""
    all_cohort = snapshots.agg(F.bool_and(mode() == "cohort")).scalar()
    title = F.when(all_cohort, "Sample volume by creation-year cohort").otherwise("Daily sample volume")
    return snapshots.select("run_date", "notebooks_collected", "notebooks_parsed", title.alias("title"))


def _long(rows: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    cast = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(keys, columns, name, value)


def metric_series(snapshots: DataFrame, metrics: tuple[str, ...] = SCORE_COLUMNS) -> DataFrame:
    """Score means by date in long form; scores without a column are skipped."""
    present = [m for m in metrics if f"{m}_mean" in snapshots.columns]
    renamed = snapshots.select("run_date", *[F.col(f"{m}_mean").alias(m) for m in present])
    return _long(renamed, ["run_date"], present, "metric", "mean")


def structure_series(snapshots: DataFrame) -> DataFrame:
    """Mean cells and documentation density in percent by date."""
    out = [F.col("run_date"), F.col("mean_total_cells")]
    if "documentation_density_mean" in snapshots.columns:
        out.append((F.col("documentation_density_mean") * 100).alias("doc_density_pct"))
    return snapshots.select(*out)


def version_share_long(wide: DataFrame) -> DataFrame:
    """Version columns of the latest date as rows in numeric version order."""
    columns = [c for c in wide.columns if c.startswith("pyver_") and c.endswith("_pct")]
    rows = _long(latest_rows(wide), ["run_date"], columns, "name", "pct")
    version = F.replace(F.regexp_replace("name", "^pyver_|_pct$", ""), F.lit("_"), F.lit("."))
    stated = rows.where(F.col("pct").isNotNull() & (F.col("pct") != 0))
    return stated.select("run_date", version.alias("version"), "pct").orderBy(version_order("version"), "version")


def version_order(version: str) -> Column:
    """Sort key that puts 3.9 before 3.10; parts that are not numbers drop out."""
    return F.filter(F.transform(F.split(version, r"\."), lambda part: part.try_cast("bigint")), lambda n: n.isNotNull())


def cohort_years(adoption: DataFrame) -> DataFrame:
    return adoption.where(mode() == "cohort").withColumn("year", F.year(F.to_date("run_date")))


def pivot_year_library(adoption: DataFrame, libraries: tuple[str, ...] = KEY_LIBRARIES) -> DataFrame:
    """Year by library adoption, 1 place.  A key that occurs twice is an error."""
    chosen = adoption.where(F.col("library").isin(*libraries))
    once = F.when(F.count(F.lit(1)) <= 1, F.round(F.max("adoption_pct"), 1)).otherwise(
        F.raise_error(F.lit("two adoption rows share a year and a library")).cast("double")
    )
    cells = chosen.groupBy("year", "library").agg(once.alias("pct"))
    return cells.groupBy("year").pivot("library", list(libraries)).agg(F.max("pct"))


def indicators_by_year(snapshots: DataFrame, indicators: tuple[str, ...] = TREND_INDICATORS) -> DataFrame:
    """Chosen snapshot columns by year in long form, 3 places, nulls dropped."""
    present = [c for c in indicators if c in snapshots.columns]
    rows = _long(snapshots, ["year"], present, "indicator", "value").where(F.col("value").isNotNull())
    return rows.withColumn("value", F.round("value", 3))


def trend_summary(series: DataFrame) -> DataFrame:
    """First, last and peak share per library, and the direction between them.

    ``series`` has ``library``, ``year`` and ``pct``; two points are required.
    """
    points = series.where(F.col("pct").isNotNull())
    ends = points.groupBy("library").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("year").alias("first_year"),
        F.min_by("pct", "year").alias("first_pct"),
        F.max("year").alias("last_year"),
        F.max_by("pct", "year").alias("last_pct"),
        F.max("pct").alias("peak_pct"),
        F.max_by("year", F.struct(F.col("pct"), -F.col("year"))).alias("peak_year"),
    )
    up, down, flat = TREND_DIRECTIONS
    rose, fell = F.col("last_pct") > F.col("first_pct") + TREND_POINTS, F.col("last_pct") < F.col("first_pct") - TREND_POINTS
    direction = F.when(rose, up).when(fell, down).otherwise(flat)
    told = ends.where(F.col("n") >= 2).withColumn("direction", direction)

    def whole(c: str) -> Column:
        return F.bround(c, 0).cast("bigint").cast("string")

    said = {"first": whole("first_pct"), "last": whole("last_pct"), "peak": whole("peak_pct")}
    pieces = re.split(r"\{(\w+)\}", TREND_SENTENCE)  # text and names in turn
    sentence = F.concat(*(said.get(piece, F.col(piece)) if i % 2 else F.lit(piece) for i, piece in enumerate(pieces) if piece))
    return told.withColumn("summary", sentence).drop("n")


def latest_quality(snapshots: DataFrame) -> DataFrame:
    """Score means and structure columns of the latest date, long, 3 places."""
    means = [c for c in snapshots.columns if c.endswith("_mean")]
    structure = [c for c in STRUCTURE_COLUMNS if c in snapshots.columns]
    rows = _long(latest_rows(snapshots), ["run_date"], [*means, *structure], "name", "value")
    kind = F.when(F.col("name").endswith("_mean"), "quality_indices_mean").otherwise("structure")
    name = F.regexp_replace("name", "_mean$", "")
    return rows.select("run_date", kind.alias("section"), name.alias("name"), F.round("value", 3).alias("value"))


def series_span(rows: DataFrame) -> DataFrame:
    """Number of dates and the year span per mode."""
    return rows.groupBy(mode().alias("collection_type")).agg(
        F.countDistinct("run_date").alias("dates"),
        F.year(F.min("run_date")).alias("first_year"),
        F.year(F.max("run_date")).alias("last_year"),
    )
