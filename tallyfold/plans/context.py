"""The trend context: current census, cohort history and trend sentences.

The context is a long table of facts, (section, subject, period, value, text),
from which :func:`trend_document` makes one JSON document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.fixed_values import KEY_LIBRARIES
from tallyfold.operators import ranking, trends
from tallyfold.sources import readers, sinks

DAILY_COUNTS = ("notebooks_collected", "notebooks_parsed", "n_daily_snapshots")
DAILY_MAPS = ("quality_indices_mean", "structure", "python_version_share_pct")


def _facts(rows: DataFrame, section, subject, period=None, value=None, text=None) -> DataFrame:
    as_col = lambda v, kind: (F.lit(None) if v is None else v).cast(kind)
    return rows.select(
        (F.lit(section) if isinstance(section, str) else section).alias("section"),
        (F.lit(subject) if isinstance(subject, str) else subject).alias("subject"),
        as_col(period, "int").alias("period"),
        as_col(value, "double").alias("value"),
        as_col(text, "string").alias("text"),
    )


def trend_facts(snapshots: DataFrame, adoption: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """All facts of the context.  ``versions`` holds long version shares."""
    daily = snapshots.where(trends.mode() == "daily")
    daily_adoption = adoption.where(trends.mode() == "daily")
    cohort = snapshots.where(trends.mode() == "cohort").withColumn("year", F.year("run_date"))
    cohort_adoption = trends.cohort_years(adoption).where(F.col("library").isin(*KEY_LIBRARIES))
    latest = trends.latest_rows(daily)
    newest = daily_adoption.where(F.col("run_date") == daily.agg(F.max("run_date")).scalar())
    top = ranking.top_libraries(newest, 20)
    yearly = cohort_adoption.select("library", "year", F.round("adoption_pct", 1).alias("pct"))
    quality = trends.latest_quality(daily)
    first = cohort.agg(F.min_by("notebooks_collected", "run_date").alias("n"))
    parts = [
        _facts(latest, "daily_census", "latest_date", text=F.date_format("run_date", "yyyy-MM-dd")),
        _facts(latest, "daily_census", "notebooks_collected", value=F.col("notebooks_collected")),
        _facts(latest, "daily_census", "notebooks_parsed", value=F.col("notebooks_parsed")),
        _facts(daily.agg(F.countDistinct("run_date").alias("n")), "daily_census", "n_daily_snapshots", value=F.col("n")),
        _facts(top, "top_libraries", F.col("library"), value=F.col("adoption_pct"), text=F.col("category")),
        _facts(top, "top_library_counts", F.col("library"), value=F.col("notebook_count")),
        _facts(quality, F.col("section"), F.col("name"), value=F.col("value")),
        _facts(trends.series_span(cohort), "cohorts", "span", text=F.concat_ws("-", "first_year", "last_year")),
        _facts(trends.series_span(cohort), "cohorts", "n_cohorts", value=F.col("dates")),
        _facts(first.where(F.col("n").isNotNull()), "cohorts", "notebooks_per_cohort", value=F.col("n")),
        _facts(yearly, "library_adoption_pct_by_creation_year", F.col("library"), F.col("year"), F.col("pct")),
        _facts(trends.trend_summary(yearly), "library_trend_summaries", F.col("library"), text=F.col("summary")),
        _facts(trends.indicators_by_year(cohort), "structure_and_quality_by_creation_year", F.col("indicator"), F.col("year"), F.col("value")),
    ]
    if versions is not None:
        stated = versions.where(F.col("run_date") == daily.agg(F.max("run_date")).scalar()).where(F.round("pct", 3) != 0)
        parts.append(_facts(stated, "python_version_share_pct", F.col("value"), value=F.round("pct", 3)))
    facts = parts[0]
    for part in parts[1:]:
        facts = facts.unionByName(part)
    return facts


def trend_document(facts: DataFrame) -> DataFrame:
    """The facts as one JSON document: ``daily_census`` with counts, ranked
    libraries, quality, structure and version shares; ``cohorts`` with span,
    series by year and sentences.  A part without history is left out.

    The fact table is bounded by years x indicators, not by the census size.
    """
    period, value, text = F.col("period"), F.col("value"), F.col("text")
    series = F.array_sort(F.collect_list(F.when(period.isNotNull(), F.struct("period", "value"))))
    subjects = facts.groupBy("section", "subject").agg(F.max("value").alias("value"), F.max("text").alias("text"), series.alias("series"))

    def of(section: str) -> Column:
        return F.col("section") == section

    def single(section: str, subject: str, column: str, kind: str) -> Column:
        return F.max(F.when(of(section) & (F.col("subject") == subject), F.col(column))).cast(kind).alias(subject)

    def members(section: str, column: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.when(of(section), F.struct("subject", column))))
        if column == "series":
            pairs = F.transform(pairs, lambda p: F.struct(p.subject, F.map_from_entries(p.series)))
        return F.map_from_entries(pairs).alias(section)

    listed = F.collect_list(
        F.when(of("top_libraries"), F.struct((-value).alias("order"), F.col("subject").alias("library"), text.alias("category"), value.alias("pct")))
    )
    whole = subjects.agg(
        single("daily_census", "latest_date", "text", "string"),
        *[single("daily_census", n, "value", "bigint") for n in DAILY_COUNTS],
        F.array_sort(listed).alias("ranked"),
        members("top_library_counts", "value"),
        *[members(n, "value") for n in DAILY_MAPS],
        F.struct(
            single("cohorts", "span", "text", "string"),
            *[single("cohorts", n, "value", "bigint") for n in ("n_cohorts", "notebooks_per_cohort")],
            members("library_adoption_pct_by_creation_year", "series"),
            members("library_trend_summaries", "text"),
            members("structure_and_quality_by_creation_year", "series"),
        ).alias("cohorts"),
    )
    top = F.transform(
        "ranked",
        lambda r: F.struct(
            r.library.alias("library"),
            r.category.alias("category"),
            r.pct.alias("adoption_pct"),
            F.try_element_at("top_library_counts", r.library).cast("bigint").alias("notebook_count"),
        ),
    )
    daily = F.struct("latest_date", *DAILY_COUNTS, top.alias("top_libraries"), *DAILY_MAPS)
    parts = F.struct(
        F.when(F.col("latest_date").isNotNull(), daily).alias("daily_census"),
        F.when(F.col("cohorts.span").isNotNull(), F.col("cohorts")).alias("cohorts"),
    )
    return whole.select(F.to_json(parts).alias("context"))


def store_context(spark: SparkSession, root: str) -> DataFrame:
    """Build the trend document of a stored census and write it beside it."""
    snapshots, adoption = (readers.stored(spark, f"{root}/{t}").drop("date") for t in ("daily_snapshots", "library_adoption"))
    document = trend_document(trend_facts(snapshots, adoption, readers.stored(spark, f"{root}/version_shares")))
    sinks.write_document(document, f"{root}/trend_context")
    return document
