"""Partial aggregates: merged in any parts they give the figures of the whole; batches are parsed once."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from test_parse import DOCUMENTS

from tallyfold.checks import bindings as B
from tallyfold.checks.spans import EVENTS
from tallyfold.operators import aggregate, states
from tallyfold.operators.observe import observe
from tallyfold.sources import readers
from tallyfold.sources.runs import Run
from tallyfold.streaming import landing

DAY = date(2026, 7, 7)
BY_DAY = ("run_date",)


@pytest.fixture(scope="module")
def observed(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("observed"))
    observe(B.landed_documents(spark, sf_dir)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rows_of(frame):
    names = sorted(frame.columns)
    return sorted(tuple(str(r[n]) for n in names) for r in frame.collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_states_give_the_figures_of_the_whole(spark, observed, parts):
    part = F.pmod(F.xxhash64("path"), F.lit(parts)).alias("part")
    held = states.day_states(observed.select("*", part), (*states.KEYS, "part"))
    assert held.count() > 20 and held.where("part > 0").isEmpty() == (parts == 1)
    snapshot = states.snapshot(held, aggregate.contributors(observed))
    whole = aggregate.daily_snapshot(observed)
    assert snapshot.columns == whole.columns and rows_of(snapshot) == rows_of(whole)
    assert rows_of(states.adoption(held)) == rows_of(aggregate.library_adoption(observed))
    assert rows_of(states.version_shares(held)) == rows_of(aggregate.version_share(observed))


def test_merged_states_are_states(spark, observed):
    part = F.pmod(F.xxhash64("path"), F.lit(4)).alias("part")
    held = states.day_states(observed.select("*", part), (*states.KEYS, "part"))
    once = states.merged(held)
    assert set(once.columns) == set(held.columns) - {"part"} and once.count() == once.select(*states.KEYS).distinct().count()
    for keys in (states.KEYS, ("collection_type",)):
        assert rows_of(states.summary(once, keys)) == rows_of(states.summary(held, keys))
        assert rows_of(states.summary(states.merged(once, keys), keys)) == rows_of(states.summary(held, keys))
    assert rows_of(states.version_shares(once)) == rows_of(states.version_shares(held))


def test_estimates_of_spans_are_near_the_exact_counts(spark):
    days = spark.range(40_000).select((F.lit(DAY) + (F.col("id") % 30).cast("int")).alias("run_date"), F.lit("daily").alias("collection_type"), F.concat(F.lit("r"), F.col("id") * 7 % 9973).alias("repo_full_name"), F.lit(None).cast("string").alias("stratum"))
    rows = days.selectExpr("*", "true AS parse_ok", "0.5D AS score", "cast(NULL AS int) AS nbformat", "cast(NULL AS string) AS python_major_minor", *[f"false AS lib_{e}" for e in B.EVENT_CATEGORIES])
    whole = states.summary(states.day_states(rows, measures=EVENTS), ("collection_type",), EVENTS).first()
    assert abs(whole.repos_estimate - 9973) <= 3 * 0.0082 * 9973 and whole.strata_estimate == 0
    assert (whole.score_median, whole.pct_nbformat_4, whole.pct_with_python_version) == (0.5, None, 0.0)


def test_states_of_odd_rows(spark, observed):
    none = observed.where("false")
    assert states.day_states(none).count() == 0
    held = states.day_states(observed.withColumn("run_date", F.lit(None).cast("date")).withColumn("parse_ok", F.lit(False)))
    row = states.summary(held).first()
    assert row.run_date is None and row.notebooks_parsed == 0 < row.notebooks_collected and row.parse_success_rate == 0.0
    assert row.median_total_cells is None and row.complexity_score_mean is None and states.version_shares(held).count() == 0
    empty = states.snapshot(states.day_states(none), aggregate.contributors(none), spark.createDataFrame([(DAY,)], "run_date date")).first()
    assert (empty.notebooks_collected, empty.parse_success_rate, empty.collection_type) == (0, 0.0, "daily")


# --- batches ------------------------------------------------------------------

FIELDS = [n.split()[0] for n in landing.LANDED.split(", ")]


def batch(spark, *items, mode="daily", repo="o/r"):
    values = [dict.fromkeys(FIELDS) | {"run_date": d, "collection_type": mode, "repo_full_name": repo, "path": p, "raw": DOCUMENTS[name], "stratum": "s"} for d, p, name in items]
    return spark.createDataFrame([tuple(v[n] for n in FIELDS) for v in values], landing.LANDED)


def stored(spark, root, table):
    return readers.stored(spark, f"{root}/{table}")


def same_as_in_one(spark, root):
    """Every stored figure is that of the stored observations."""
    rows = stored(spark, root, "observations")
    for mode in ("daily", "cohort"):
        mine = rows.where(F.col("collection_type") == mode)
        snapshot = stored(spark, root, "daily_snapshots").where(F.col("collection_type") == mode).drop("date")
        assert rows_of(snapshot) == rows_of(aggregate.daily_snapshot(mine))
        adoption = stored(spark, root, "library_adoption").where(F.col("collection_type") == mode).drop("date")
        assert rows_of(adoption) == rows_of(aggregate.library_adoption(mine))


def test_each_document_is_parsed_once(spark, tmp_path, monkeypatch):
    root, parsed = str(tmp_path / "census"), spark.sparkContext.accumulator(0)

    def counting(rows):
        def seen(raw):
            parsed.add(1)
            return raw

        return observe(rows.withColumn("raw", F.udf(seen)("raw")))

    monkeypatch.setattr(landing, "observe", counting)
    take, next_day = landing.take_batch(root), DAY + timedelta(days=1)
    take(batch(spark, (DAY, "a", "good"), (DAY, "b", "messy")), 0)
    take(batch(spark, (DAY, "c", "legacy"), (next_day, "a", "good")).unionByName(batch(spark, (DAY, "a", "good"), mode="cohort")), 1)
    take(batch(spark, (DAY, "d", "good")), 2)
    assert parsed.value == 6
    assert sorted(r["count"] for r in stored(spark, root, "day_states").groupBy("collection_type", "run_date").count().collect()) == [1, 1, 3]
    same_as_in_one(spark, root)
    take(batch(spark, (DAY, "d", "good")), 2)  # the query was restarted
    take(batch(spark, (DAY, "b", "good"), (DAY, "b", "good"), (next_day, "e", "messy")), 3)  # b comes anew, and twice
    counts = {(r.collection_type, r.run_date): r.notebooks_collected for r in stored(spark, root, "daily_snapshots").collect()}
    assert counts == {("daily", DAY): 4, ("daily", next_day): 2, ("cohort", DAY): 1}
    assert {r.path: r.parse_ok for r in stored(spark, root, "observations").where(f"date = '{DAY}' AND collection_type = 'daily'").collect()}["b"]
    same_as_in_one(spark, root)


def test_dates_of_many_batches_are_written_as_one(spark, tmp_path):
    root = str(tmp_path / "census")
    for part in range(4):
        run = Run(spark, root)
        fresh = observe(batch(spark, (DAY, f"p{part}", "good"), *([(DAY + timedelta(days=1), "x", "messy")] if part == 0 else [])))
        landing.absorb(run, fresh.cache())
        run.commit()
    before = [rows_of(stored(spark, root, t)) for t in ("observations", "daily_snapshots", "library_adoption")]
    assert landing.compact(spark, root, most=4) == 0 and landing.compact(spark, root, most=3) == 1
    assert set(Run(spark, root).parts("observations").values()) == {1} == set(Run(spark, root).parts("day_states").values())
    assert [rows_of(stored(spark, root, t)) for t in ("observations", "daily_snapshots", "library_adoption")] == before
    assert stored(spark, root, "day_states").count() == 2
    same_as_in_one(spark, root)
