"""The daily run, the cohort backfill and the recomputation of stored dates.

Every job writes its observations first and aggregates what was written: the
JSON is parsed once, the written table cuts the lineage, and a lost executor
costs only its own tasks.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.fixed_values import FIRST_COHORT_YEAR
from tallyfold.operators import aggregate, sampling, states
from tallyfold.operators.observe import observe
from tallyfold.session import scratch_folder
from tallyfold.sources import landed, readers, sinks
from tallyfold.sources.runs import Run

MODES = ("daily", "cohort")


def land(drawn: DataFrame, contents: DataFrame | str) -> DataFrame:
    """Drawn files with their text; ``raw`` is null where it could not be read.

    ``contents`` is a table, or the root folder of landed files: then the drawn files, and no others, are
    opened by name, in batches of equal bytes.
    Contents stored by :func:`sinks.write_contents` are read only in the folders
    that the drawn repositories fall in.  The join with the contents is left to
    the planner's size check of ``drawn``, which is stored.
    """
    if isinstance(contents, str):
        batches = scratch_folder(drawn.sparkSession, "landed-batches")
        landed.store_batches(drawn.dropDuplicates(["full_name", "path"]), batches)
        contents = landed.documents(drawn.sparkSession, batches, contents)
    elif "bucket" in contents.columns:
        wanted = drawn.select(readers.content_bucket(F.col("full_name")).alias("bucket")).distinct().collect()
        contents = contents.where(F.col("bucket").isin([r.bucket for r in wanted]))  # CONTENT_BUCKETS numbers at most
    keys = drawn.select("full_name", "path").distinct()
    found = contents.select("full_name", "path", "raw").join(keys, ["full_name", "path"])
    return drawn.join(found, ["full_name", "path"], "left")


def provenance(read: DataFrame, run_date: Column, collection_type: str) -> DataFrame:
    """Landed files in the column names of the observation table."""
    return read.where(F.col("raw").isNotNull()).select(
        run_date.alias("run_date"),
        F.lit(collection_type).alias("collection_type"),
        F.col("full_name").alias("repo_full_name"),
        "path",
        F.col("default_branch").alias("ref"),
        F.coalesce("size", F.length("raw")).alias("size_bytes"),
        "raw",
        F.col("stars").alias("repo_stars"),
        F.col("size_kb").alias("repo_size_kb"),
        F.col("created_at").alias("repo_created_at"),
        F.col("pushed_at").alias("repo_pushed_at"),
        "strategy",
        "stratum",
    )


def stored_rows(run: Run, table: str, rows: DataFrame, mode: str, dates: list[date]) -> DataFrame:
    """Write a run's rows of a table and return what is stored of them, so that
    whatever reads them next starts from files.  No rows is a valid result."""
    run.write(table, rows.withColumn("collection_type", F.lit(mode)), collection_type=mode, replaced=dates)
    return run.read(table, mode=mode, dates=dates)


def date_rows(spark: SparkSession, dates: list[date]) -> DataFrame:
    return spark.createDataFrame([(d,) for d in dates], "run_date date")


AGGREGATES = ("daily_snapshots", "library_adoption", "version_shares")


def store_aggregates(run: Run, rows: DataFrame, dates: list[date], mode: str, measures: states.Measures = states.CENSUS) -> tuple[DataFrame, DataFrame]:
    """States, snapshot, version shares and adoption of the given dates from their stored
    observations of one mode; returns snapshot and adoption as stored.  Dates
    without rows get an empty snapshot and zero adoption."""
    stored_rows(run, "day_states", states.day_states(rows, measures=measures), mode, dates)
    return store_figures(run, rows, dates, mode, measures)


def store_figures(run: Run, rows: DataFrame, dates: list[date], mode: str, measures: states.Measures = states.CENSUS) -> tuple[DataFrame, DataFrame]:
    """Snapshot, version shares and adoption of dates from their states.  Of their observations only repositories
    and strata are read, whose exact counts do not merge."""
    days, held = date_rows(run.spark, dates), run.read("day_states", mode=mode, dates=dates)
    tables = (
        states.snapshot(held, aggregate.contributors(rows), days, mode, measures),
        states.adoption(held, run_dates=days, mode=mode, measures=measures),
        states.version_shares(held),
    )
    stored = [stored_rows(run, name, table, mode, dates) for name, table in zip(AGGREGATES, tables)]
    return stored[0], stored[1]


def mirror(spark: SparkSession, root: str) -> None:
    """The whole snapshot and adoption history as CSV, from what was committed: a row per date, and per date and
    library.  A copy for other programs: a run that dies here leaves the old one, and the next run writes it anew."""
    for name in AGGREGATES[:2]:
        sinks.write_csv(readers.stored(spark, f"{root}/{name}").drop("date"), f"{root}/csv/{name}")


def store_run(pool: DataFrame, files: DataFrame, contents: DataFrame | str, root: str, mode: str, dates: list[date], draw) -> DataFrame:
    """From the pool of a run (with ``run_date``) to its report; every step is
    stored, so the population and the listing are read once.  Nothing is visible before the last step, which
    replaces the run's dates in all tables at once."""
    run = Run(pool.sparkSession, root)
    pool = stored_rows(run, "pool", pool, mode, dates)
    listed = stored_rows(run, "listed", sampling.pooled_files(pool.drop("date"), files), mode, dates)
    drawn = stored_rows(run, "drawn", draw(listed), mode, dates)
    read = stored_rows(run, "landed", land(drawn, contents), mode, dates)
    found = observe(provenance(read, F.col("run_date"), mode))
    observed = stored_rows(run, "observations", found, mode, dates)
    snapshot, adoption = store_aggregates(run, observed, dates, mode)
    counts = sampling.accounting(date_rows(run.spark, dates), pool, listed, read)
    run.commit()
    mirror(run.spark, root)
    return run_report(snapshot, adoption, counts)


def run_day(
    spark: SparkSession,
    repos: DataFrame,
    files: DataFrame,
    contents: DataFrame | str,
    root: str,
    run_date: date,
    seed_offset: int = 0,
    quota: sampling.Quota = sampling.DAILY_QUOTA,
    limits: sampling.Limits = sampling.DEFAULT_LIMITS,
) -> DataFrame:
    """One daily census; returns its report row."""
    seed = sampling.date_seed(F.lit(run_date), seed_offset)
    pool = sampling.day_pool(repos, run_date, seed_offset, quota).withColumn("run_date", F.lit(run_date))
    report = store_run(pool, files, contents, root, "daily", [run_date], lambda listed: sampling.draw_files(listed, seed, limits))
    report = with_strata(report, sampling.plan_rows(date_rows(spark, [run_date]), seed_offset))
    sinks.write_json(report, f"{root}/last_run_report")
    return report


def run_backfill(
    spark: SparkSession,
    repos: DataFrame,
    files: DataFrame,
    contents: DataFrame | str,
    root: str,
    start_year: int = FIRST_COHORT_YEAR,
    end_year: int | None = None,
    seed_offset: int = 0,
    quota: sampling.Quota = sampling.COHORT_QUOTA,
    limits: sampling.Limits = sampling.DEFAULT_LIMITS,
) -> DataFrame:
    """All creation-year cohorts of a range in one job; one report row per
    year, newest first."""
    last = spark.range(1).select(F.year(F.current_date())).first()[0] if end_year is None else end_year
    dates = [date(year, 1, 1) for year in range(start_year, last + 1)]
    first_day = F.make_date("cohort_year", F.lit(1), F.lit(1))
    pool = sampling.cohort_pool(repos, start_year, last, seed_offset, quota).withColumn("run_date", first_day)
    seed, by = sampling.cohort_seed(seed_offset), ("cohort_year",)
    report = store_run(pool, files, contents, root, "cohort", dates, lambda listed: sampling.draw_files(listed, seed, limits, by))
    years = date_rows(spark, dates).select(F.year("run_date").alias("cohort_year"))
    return with_strata(report, sampling.cohort_plan_rows(years, seed_offset)).orderBy(F.desc("run_date"))


def reaggregate(spark: SparkSession, root: str, run_date: date) -> None:
    """Recompute one stored date in every mode it has; a date without
    observations is an error."""
    found = False
    for mode in MODES:
        rows = readers.observations(spark, f"{root}/observations", run_date, collection_type=mode)
        if rows is not None and not rows.isEmpty():
            run = Run(spark, root)
            store_aggregates(run, rows, [run_date], mode)
            run.commit()
            found = True
    if not found:
        raise ValueError(f"no observations stored for {run_date.isoformat()}")
    mirror(spark, root)


def run_report(snapshot: DataFrame, adoption: DataFrame, counts: DataFrame) -> DataFrame:
    """The report of a run, a row per date: counts and the top ten libraries.

    Ranks are cut at ten per date before the lists are made.
    """
    rank = F.row_number().over(Window.partitionBy("run_date").orderBy(F.desc("adoption_pct"), "library"))
    best = adoption.withColumn("rank", rank).where("rank <= 10").groupBy("run_date")
    entry = F.struct(F.col("adoption_pct"), "library", "category", "notebook_count")
    top = best.agg(F.sort_array(F.collect_list(entry), asc=False).alias("top_libraries"))
    return snapshot.select("run_date", "notebooks_collected", "notebooks_parsed").join(
        counts.select(
            "run_date",
            F.col("repos_considered").alias("repos_sampled"),
            F.create_map(F.lit("notebooks_read"), F.col("notebooks_collected")).alias("client_stats"),
            "errors",
            "documents_left_out",
        ),
        "run_date",
    ).join(top, "run_date", "left")


def with_strata(report: DataFrame, plan: DataFrame) -> DataFrame:
    """The report with the strata each date was drawn from."""
    return report.join(sampling.plan_strata(plan), "run_date", "left")
