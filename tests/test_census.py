"""Whole jobs on a landed folder: day, backfill, recomputation and stream."""

from __future__ import annotations

import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from test_parse import DOCUMENTS

from tallyfold.fixed_values import TREND_LIBRARIES
from tallyfold.operators import aggregate, ranking, trends
from tallyfold.operators.sampling import Limits, Quota
from tallyfold.plans import census
from tallyfold.plans.context import store_context, trend_facts
from tallyfold.sources import readers
from tallyfold.streaming import landing

DAY = date(2026, 7, 7)
REPOS = "full_name string, default_branch string, stars bigint, size_kb bigint, created_at string, pushed_at string, topics array<string>"
NAMES = list(DOCUMENTS)
DAILY, COHORT = Quota(7), Quota(5)


@pytest.fixture(scope="module")
def landed(spark):
    repos = [(f"o/r{i}", "main", 3 + i * 7, 100 + i, f"{2014 + i % 3}-03-01", "2026-07-06", ["research"]) for i in range(40)]
    files = [(f"o/r{i}", "blob", f"{name}.ipynb", 50) for i in range(40) for name in NAMES[i % 5 :: 5]]
    missing = {("o/r3", "good.ipynb")}
    contents = [(r, p, DOCUMENTS[p.removesuffix(".ipynb")]) for r, _, p, _ in files if (r, p) not in missing]
    return (
        spark.createDataFrame(repos, REPOS),
        spark.createDataFrame(files, "full_name string, type string, path string, size bigint"),
        spark.createDataFrame(contents, "full_name string, path string, raw string"),
    )


@pytest.fixture(scope="module")
def root(spark, landed, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("census"))
    for ahead in range(2):
        census.run_day(spark, *landed, root, DAY + timedelta(days=ahead), quota=DAILY)
    census.run_backfill(spark, *landed, root, 2013, 2016, quota=COHORT)
    return root


def table(spark, root, name):
    return readers.stored(spark, f"{root}/{name}")


def test_day_is_stored_whole(spark, root):
    rows = table(spark, root, "observations").where(F.col("date") == DAY)
    snapshot = table(spark, root, "daily_snapshots").where(F.col("date") == DAY).first()
    assert len(rows.columns) == 112  # 111 and the partition column
    assert rows.count() == snapshot.notebooks_collected > 0
    assert rows.where("parse_ok").count() == snapshot.notebooks_parsed
    assert snapshot.collection_type == "daily" and 0 < snapshot.parse_success_rate < 1
    adoption = table(spark, root, "library_adoption").where(F.col("date") == DAY)
    assert adoption.count() == 42 and adoption.agg(F.max("adoption_pct")).first()[0] <= 100


def test_report(spark, root):
    (line,) = [json.loads(r.value) for r in spark.read.text(f"{root}/last_run_report").collect()]
    assert line["run_date"] == "2026-07-08" and len(line["strata"]) == 7 and len(line["top_libraries"]) == 10
    shares = [t["adoption_pct"] for t in line["top_libraries"]]
    assert shares == sorted(shares, reverse=True)
    landed = table(spark, root, "landed").where("date = '2026-07-08'")
    assert line["errors"] == landed.where("raw IS NULL").count()
    assert line["notebooks_collected"] == landed.where("raw IS NOT NULL").count()


def test_charts_of_the_stored_history(spark, root):
    adoption = trends.prefer_mode(table(spark, root, "library_adoption"), "daily")
    bars = ranking.latest_ranking(adoption).collect()
    assert len(bars) == 15 and [r.adoption_pct for r in bars] == sorted(r.adoption_pct for r in bars)
    assert trends.adoption_series(adoption).count() == 2 * len(TREND_LIBRARIES)
    rollup = {r.category: r.notebook_count for r in aggregate.category_rollup(trends.latest_rows(adoption)).collect()}
    assert rollup["array"] > 0 and min(rollup.values()) > 0
    cohorts = trends.prefer_mode(table(spark, root, "library_adoption"), "cohort", "daily")
    assert {r.collection_type for r in cohorts.select("collection_type").distinct().collect()} == {"cohort"}
    assert trends.prefer_mode(adoption, "cohort", "daily").count() == adoption.count()
    assert trends.prefer_mode(adoption.drop("collection_type"), "cohort").count() == adoption.count()


def test_running_a_day_again_changes_nothing(spark, landed, root):
    before = sorted(map(str, table(spark, root, "daily_snapshots").drop("x").collect()))
    census.run_day(spark, *landed, root, DAY, quota=DAILY)
    assert sorted(map(str, table(spark, root, "daily_snapshots").collect())) == before


def test_backfill_keys_years_and_keeps_empty_ones(spark, root):
    rows = {r.run_date.isoformat(): r for r in table(spark, root, "daily_snapshots").where("collection_type = 'cohort'").collect()}
    assert set(rows) == {"2013-01-01", "2014-01-01", "2015-01-01", "2016-01-01"}
    empty = table(spark, root, "daily_snapshots").where("date = '2013-01-01'").first()
    assert (empty.notebooks_collected, empty.parse_success_rate, empty.notebook_size_index_mean) == (0, 0.0, None)
    adoption = table(spark, root, "library_adoption").where("date = '2013-01-01'")
    assert adoption.count() == 42 and adoption.agg(F.sum("notebook_count")).first()[0] == 0


def test_a_day_without_documents_is_still_stored(spark, landed, tmp_path):
    repos, files, contents = landed
    report = census.run_day(spark, repos.where("false"), files, contents, str(tmp_path), DAY).first()
    assert (report.notebooks_collected, report.errors, report.repos_sampled) == (0, 0, 0)
    assert table(spark, str(tmp_path), "library_adoption").count() == 42
    snapshot = table(spark, str(tmp_path), "daily_snapshots").first()
    assert (snapshot.notebooks_parsed, snapshot.parse_success_rate, snapshot.collection_type) == (0, 0.0, "daily")


def test_a_run_that_finds_less_replaces_its_date(spark, landed, tmp_path):
    repos, files, contents = landed
    root = str(tmp_path)
    first = census.run_day(spark, repos, files, contents, root, DAY, quota=DAILY).first()
    assert first.notebooks_collected > 0 and table(spark, root, "version_shares").count() > 0
    again = census.run_day(spark, repos.where("false"), files, contents, root, DAY, quota=DAILY).first()
    assert (again.notebooks_collected, again.repos_sampled, again.errors, again.documents_left_out) == (0, 0, 0, 0)
    assert all(table(spark, root, t).isEmpty() for t in ("pool", "landed", "observations", "version_shares"))
    census.run_backfill(spark, *landed, root, 2014, 2015, quota=COHORT)
    census.run_backfill(spark, repos.where("created_at >= '2015'"), files, contents, root, 2014, 2015, quota=COHORT)
    counts = {r.run_date.year: r.notebooks_collected for r in table(spark, root, "daily_snapshots").where("collection_type = 'cohort'").collect()}
    assert counts[2014] == 0 < counts[2015]


def test_first_of_january_holds_both_modes(spark, landed, tmp_path):
    root, day = str(tmp_path), date(2016, 1, 1)
    census.run_day(spark, *landed, root, day, quota=DAILY)
    census.run_backfill(spark, *landed, root, 2016, 2016, quota=COHORT)
    for name in ("observations", "daily_snapshots", "library_adoption"):
        assert {r[0] for r in table(spark, root, name).select("collection_type").distinct().collect()} == {"daily", "cohort"}
    before = sorted(map(str, table(spark, root, "daily_snapshots").collect()))
    census.reaggregate(spark, root, day)
    assert sorted(map(str, table(spark, root, "daily_snapshots").collect())) == before


def test_limits_reach_the_report(spark, landed, tmp_path):
    cut = census.run_day(spark, *landed, str(tmp_path / "a"), DAY, quota=Quota(7, 1000), limits=Limits(documents=10)).first()
    whole = census.run_day(spark, *landed, str(tmp_path / "b"), DAY, quota=Quota(7, 1000), limits=Limits(None, None, None)).first()
    assert whole.documents_left_out == 0 and cut.documents_left_out > 0
    read = cut.notebooks_collected + cut.errors + cut.documents_left_out
    assert read == whole.notebooks_collected + whole.errors and cut.notebooks_collected + cut.errors == 10


def test_backfill_reports_newest_first(spark, landed, tmp_path):
    rows = census.run_backfill(spark, *landed, str(tmp_path), 2013, 2016, quota=COHORT).collect()
    assert [r.run_date.year for r in rows] == [2016, 2015, 2014, 2013]
    assert all(len(r.strata) == 5 for r in rows) and all(len(r.top_libraries) == 10 for r in rows) and [r.notebooks_collected > 0 for r in rows] == [True, True, True, False]


def test_recomputing_a_date_gives_the_same_rows(spark, root):
    def day():
        return table(spark, root, "daily_snapshots").where(F.col("date") == DAY).first()

    before = day()
    census.reaggregate(spark, root, DAY)
    assert day() == before
    with pytest.raises(ValueError, match="no observations"):
        census.reaggregate(spark, root, date(2001, 1, 1))


def test_context_of_the_stored_history(spark, root):
    shares = table(spark, root, "version_shares")
    facts = trend_facts(table(spark, root, "daily_snapshots").drop("date"), table(spark, root, "library_adoption").drop("date"), shares)
    found = {(r.section, r.subject, r.period): r for r in facts.collect()}
    assert found["daily_census", "latest_date", None].text == "2026-07-08"
    assert found["cohorts", "span", None].text == "2013-2016"
    assert ("library_trend_summaries", "numpy", None) in found
    assert any(section == "python_version_share_pct" for section, _, _ in found)
    store_context(spark, root)
    (line,) = spark.read.text(f"{root}/trend_context").collect()
    context = json.loads(line.value)
    daily = context["daily_census"]
    assert daily["latest_date"] == "2026-07-08" and daily["n_daily_snapshots"] == 2 and len(daily["top_libraries"]) == 20
    assert daily["python_version_share_pct"] and context["cohorts"]["library_adoption_pct_by_creation_year"]["numpy"]["2014"] is not None
    mirror = spark.read.option("header", "true").csv(f"{root}/csv/daily_snapshots")
    assert mirror.count() == table(spark, root, "daily_snapshots").count()


def test_trend_sentence(spark):
    series = spark.createDataFrame(
        [("up", 2014, 1.0), ("up", 2015, 9.5), ("up", 2016, 9.5), ("one", 2014, 5.0), ("flat", 2014, 0.5), ("flat", 2015, 2.5)],
        "library string, year int, pct double",
    )
    got = {r.library: r.summary for r in trends.trend_summary(series).collect()}
    assert got == {
        "up": f"up rose from 1% in 2014 to {9.5:.0f}% in 2016 (peak {9.5:.0f}% in 2015).",
        "flat": f"flat stayed roughly flat from {0.5:.0f}% in 2014 to {2.5:.0f}% in 2015 (peak {2.5:.0f}% in 2015).",
    }


def test_pivot_refuses_two_rows_for_one_cell(spark):
    rows = spark.createDataFrame([(2014, "numpy", 1.0), (2014, "numpy", 2.0)], "year int, library string, adoption_pct double")
    with pytest.raises(Exception, match="share a year"):
        trends.pivot_year_library(rows).collect()


def test_single_run_has_no_delta(spark):
    one = spark.createDataFrame([(DAY, 0.5)], "run_date date, x double")
    r = trends.latest_delta(one, "x").first()
    assert (r.latest, r.previous, r.delta) == (0.5, 0.5, 0.0)


def test_versions_are_in_numeric_order(spark):
    wide = spark.createDataFrame([(DAY, 1.0, 2.0, 0.0, None)], "run_date date, pyver_3_10_pct double, pyver_3_9_pct double, pyver_2_7_pct double, pyver_3_8_pct double")
    assert [r.version for r in trends.version_share_long(wide).collect()] == ["3.9", "3.10"]


def test_stream_rebuilds_each_touched_date_in_full(spark, tmp_path):
    incoming, root, marks = (str(tmp_path / n) for n in ("in", "census", "marks"))
    names = [n.split()[0] for n in landing.LANDED.split(", ")]

    def land(*items):
        values = [
            dict.fromkeys(names) | {"run_date": d, "collection_type": "daily", "repo_full_name": "o/r", "path": p, "raw": DOCUMENTS[p], "stratum": "s"}
            for d, p in items
        ]
        spark.createDataFrame([tuple(v[n] for n in names) for v in values], landing.LANDED).write.mode("append").parquet(incoming)
        landing.land_stream(spark, incoming, root, marks).awaitTermination()

    land((DAY, "good"), (DAY, "messy"))
    land((DAY, "legacy"), (DAY + timedelta(days=1), "good"))
    counts = {r.run_date: r.notebooks_collected for r in table(spark, root, "daily_snapshots").collect()}
    assert counts == {DAY: 3, DAY + timedelta(days=1): 1}
    land((DAY, "good"))  # delivered again
    assert table(spark, root, "daily_snapshots").where(F.col("date") == DAY).first().notebooks_collected == 3
    assert table(spark, root, "observations").count() == 4
