"""Land documents as they arrive and keep the touched dates' tables current.

A document is parsed once, in the batch it comes with.  The batch's observations
and states (partial aggregates) are added to those of its dates, and the dates' figures are
made from states, whose number grows with the batches and not with the documents.
Only a date that gets a document again is written anew, from its stored
observations.  All tables change at once, and a batch that is run twice
replaces its own documents, which keeps a restarted query exact.  Rows whose
collection type is not ``cohort`` are daily ones.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyfold.operators import states
from tallyfold.operators.observe import observe
from tallyfold.plans import census
from tallyfold.session import scratch_folder
from tallyfold.sources.runs import Run

LANDED = (
    "run_date date, collection_type string, repo_full_name string, path string, ref string, size_bytes bigint, "
    "raw string, repo_stars bigint, repo_size_kb bigint, repo_created_at string, repo_pushed_at string, "
    "strategy string, stratum string"
)

ONE_DOCUMENT = ("run_date", "collection_type", "repo_full_name", "path")
MOST_PARTS = 32  # runs that a date is made of before it is written as one


def mode_of(collection_type: Column) -> Column:
    return F.when(collection_type == "cohort", F.lit("cohort")).otherwise(F.lit("daily"))


def of_dates(rows: DataFrame, dates: set[tuple[str, date]]) -> DataFrame:
    """The rows of some (collection type, date)."""
    said = [f"{mode}/{day.isoformat()}" for mode, day in sorted(dates)]
    return rows.where(F.concat_ws("/", "collection_type", F.col("run_date").cast("string")).isin(said))


def dates_in(rows: DataFrame) -> set[tuple[str, date]]:
    return {(r.collection_type, r.run_date) for r in rows.select("collection_type", "run_date").distinct().collect()}


def absorb(run: Run, fresh: DataFrame, measures: states.Measures = states.CENSUS) -> None:
    """Add the stored observations of a batch, one row a document, to a census: observations, states and figures.

    A document that is there already is replaced, and its date written and aggregated again from stored
    observations; all other dates gain the batch's rows and one state.
    """
    touched = dates_in(fresh)
    old = run.read("observations", dates={day for _, day in touched})
    repeated = set() if old is None else dates_in(old.join(fresh.select(*ONE_DOCUMENT), list(ONE_DOCUMENT), "left_semi"))
    if touched - repeated:
        added = of_dates(fresh, touched - repeated)
        run.write("observations", added, append=True)
        run.write("day_states", states.day_states(added, measures=measures), append=True)
    if repeated:
        again = of_dates(fresh, repeated)
        kept = of_dates(old, repeated).drop("date").join(again.select(*ONE_DOCUMENT), list(ONE_DOCUMENT), "left_anti")
        run.write("observations", kept.unionByName(again, allowMissingColumns=True))
        whole = of_dates(run.read("observations", dates={day for _, day in repeated}), repeated)
        run.write("day_states", states.day_states(whole, measures=measures))
    for mode in census.MODES:
        dates = sorted(day for kind, day in touched if kind == mode)
        if dates:
            census.store_figures(run, run.read("observations", mode=mode, dates=dates), dates, mode, measures)


def compact(spark: SparkSession, root: str, most: int = MOST_PARTS, measures: states.Measures = states.CENSUS) -> int:
    """Write the dates that are made of more than ``most`` runs as one, their states as one state; returns how many."""
    run = Run(spark, root)
    crowded = {(mode, date.fromisoformat(day)) for (mode, day), parts in run.parts("observations").items() if parts > most}
    if crowded:
        days = {day for _, day in crowded}
        run.write("observations", of_dates(run.read("observations", dates=days), crowded).drop("date"))
        held = of_dates(run.read("day_states", dates=days), crowded).drop("date")
        run.write("day_states", states.merged(held, measures=measures))
        run.commit()
    return len(crowded)


def take_batch(root: str):
    """The ``foreachBatch`` function for a census stored under ``root``."""

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("collection_type", mode_of(F.col("collection_type")))
        one = F.row_number().over(Window.partitionBy(*ONE_DOCUMENT).orderBy(F.md5("raw")))
        found = observe(rows.withColumn("copy", one).where("copy = 1").drop("copy"))
        folder = scratch_folder(spark, f"batch-{batch_id}")
        found.write.parquet(folder)  # parsed here and nowhere else
        fresh = spark.read.schema(found.schema).parquet(folder)
        if fresh.isEmpty():
            return
        run = Run(spark, root)
        absorb(run, fresh)
        run.commit()
        compact(spark, root)
        census.mirror(spark, root)

    return take


def land_stream(spark: SparkSession, incoming: str, root: str, checkpoint: str) -> StreamingQuery:
    """Take all files that are waiting under ``incoming``, then stop."""
    source = spark.readStream.schema(LANDED).parquet(incoming)
    writer = source.writeStream.foreachBatch(take_batch(root)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
