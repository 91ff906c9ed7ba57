"""Sampling invariants: determinism, coverage, quotas, caps and hot groups."""

from __future__ import annotations

import hashlib
from datetime import date, timedelta

import pytest
from plan_text import physical_plan
from pyspark.sql import functions as F

from tallyfold import fixed_values as V
from tallyfold.operators import sampling as S

DAY = date(2026, 7, 7)


@pytest.fixture(scope="module")
def repos(spark):
    rows = [
        (
            f"owner/r{i}", "main", i * i % 3000, i * 53 % 60000, f"{2013 + i % 14}-05-01T00:00:00Z",
            (DAY - timedelta(days=i % 6)).isoformat() + "T12:00:00Z", [V.TOPICS[i % 14], V.TOPICS[(i * 5) % 14]],
        )
        for i in range(2500)
    ]
    schema = "full_name string, default_branch string, stars bigint, size_kb bigint, created_at string, pushed_at string, topics array<string>"
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def files(spark):
    rows = [(f"owner/r{i}", "blob", f"nb/{j}.ipynb", 100 + j) for i in range(2500) for j in range(i % 9)]
    rows += [("owner/r1", "blob", f"hot/{j}.ipynb", 10) for j in range(6000)]
    rows += [
        ("owner/r2", "tree", "folder.ipynb", 1),
        ("owner/r2", "blob", "a/.ipynb_checkpoints/x.ipynb", 1),
        ("owner/r2", "blob", "big.ipynb", V.MAX_FILE_BYTES + 1),
        ("owner/r2", "blob", "edge.ipynb", V.MAX_FILE_BYTES),
        ("owner/r2", "blob", "note.md", 1),
        ("owner/r2", "blob", "unsized.ipynb", None),
    ]
    return spark.createDataFrame(rows, "full_name string, type string, path string, size bigint").cache()


def strata(plan):
    return {r.stratum for r in plan.collect()}


def days(spark, *dates):
    return spark.createDataFrame([(d,) for d in dates], "run_date date")


def test_seed_is_the_digest_prefix(spark):
    row = days(spark, DAY).select(S.date_seed(F.col("run_date")).alias("a"), S.date_seed(F.col("run_date"), 3).alias("b")).first()
    assert row.a == int(hashlib.sha256(b"2026-07-07:0").hexdigest()[:8], 16) == 303270062
    assert row.b == int(hashlib.sha256(b"2026-07-07:3").hexdigest()[:8], 16)


def test_rotation_follows_the_ordinal(spark):
    some = [DAY + timedelta(days=i) for i in range(30)]
    got = days(spark, *some).select("run_date", S.ordinal(F.col("run_date")).alias("n"), S.rotation_index(F.col("run_date"), 14).alias("i"))
    assert all(r.n == r.run_date.toordinal() and r.i == r.run_date.toordinal() % 14 for r in got.collect())


def test_plan_has_seven_strata_and_is_the_same_each_time(spark):
    first, second = (S.plan_rows(days(spark, DAY)).collect() for _ in range(2))
    assert first == second and len(first) == 7
    assert {r.name for r in first} >= {"recent_push", "created_window", "topic", "size_bucket"}
    other = S.plan_rows(days(spark, DAY), seed_offset=1).collect()
    assert [r.served_by for r in other] != [r.served_by for r in first]


def test_two_days_cover_all_star_buckets(spark):
    for start in range(4):
        plan = S.plan_rows(days(spark, DAY + timedelta(days=start), DAY + timedelta(days=start + 1)))
        assert {f"stars:{label}" for label, _, _ in V.STAR_BUCKETS} <= strata(plan)


def test_topics_rotate(spark):
    plan = S.plan_rows(days(spark, *[DAY + timedelta(days=i) for i in range(14)]))
    assert len([s for s in strata(plan) if s.startswith("topic:")]) == len(V.TOPICS)


def test_cohort_plan(spark):
    years = spark.createDataFrame([(2013,), (2020,)], "cohort_year int")
    rows = S.cohort_plan_rows(years).collect()
    assert len(rows) == 10 and {r.run_date.isoformat() for r in rows} == {"2013-01-01", "2020-01-01"}
    topics = {r.stratum for r in rows if r.run_date.year == 2020 and r.name.startswith("cohort_topic")}
    assert topics == {f"topic:{V.TOPICS[4040 % 14]}", f"topic:{V.TOPICS[4041 % 14]}"}


def test_size_5000_lies_in_two_ranges(spark):
    row = spark.createDataFrame([(5000, 1)], "size_kb bigint, stars bigint").withColumn("full_name", F.lit("r"))
    every_range = [c for ahead in range(4) for c in S.size_strata(F.lit(DAY + timedelta(days=ahead)))]
    assert strata(S.assign(row, every_range)) == {"repo_size:size:500..5000", "repo_size:size:5000..50000"}


@pytest.mark.parametrize(("n", "size", "per"), [(7, 120, 17), (5, 120, 24), (1, 120, 120), (50, 120, 10), (7, 10000, 1428)])
def test_quota(n, size, per):
    assert S.Quota(n, size).per_stratum == per


def test_quota_beyond_the_cap_is_an_error():
    with pytest.raises(ValueError, match="result cap"):
        S.Quota(7, sample_size=10000, result_cap=1000)


@pytest.mark.parametrize("cap", [None, 1000, 30])
def test_strata_give_their_quota_or_all_they_have(spark, repos, cap):
    seed, quota = S.date_seed(F.lit(DAY)), S.Quota(7, result_cap=cap)
    assigned = S.assign(repos, S.daily_strata(F.lit(DAY)))
    sizes = {r.strategy: r["count"] for r in assigned.groupBy("strategy").count().collect()}
    by = {}
    for r in S.stratum_window(assigned, seed, quota).collect():
        by.setdefault(r.strategy, []).append(r["rank"])
    assert by.keys() == sizes.keys()
    for name, ranks in by.items():
        assert len(ranks) == min(sizes[name], quota.per_stratum) and max(ranks) <= (cap or quota.per_stratum)
        assert sorted(ranks) == list(range(min(ranks), min(ranks) + len(ranks)))


def test_limits_can_be_lifted(repos, files):
    none = S.Limits(None, None, None)
    pool, drawn = S.sample_day(repos, files, DAY, quota=S.Quota(7, 100000), limits=none)
    assert drawn.count() == S.pooled_files(pool, files).count()
    _, some = S.sample_day(repos, files, DAY, quota=S.Quota(7, 100000), limits=S.Limits(None, 2, 30))
    assert some.count() == 30 and max(r["count"] for r in some.groupBy("full_name").count().collect()) <= 2


def test_file_filter(files):
    kept = {r.path for r in S.eligible_files(files).where("full_name = 'owner/r2'").collect()}
    assert kept == {"nb/0.ipynb", "nb/1.ipynb", "edge.ipynb", "unsized.ipynb"}


def test_day_sample_is_repeatable_and_capped(spark, repos, files):
    quota = S.Quota(7, result_cap=80)
    pool, drawn = S.sample_day(repos, files, DAY, quota=quota)
    names = [r.full_name for r in pool.collect()]
    assert len(names) == len(set(names)) <= 7 * 17
    rows = drawn.collect()
    again = S.sample_day(repos.repartition(7), files.repartition(5), DAY, quota=quota)[1].collect()
    key = lambda r: (r.full_name, r.path, r.stratum)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert len(rows) > 50
    per_repo = {}
    for r in rows:
        per_repo[r.full_name] = per_repo.get(r.full_name, 0) + 1
    assert max(per_repo.values()) <= V.MAX_FILES_PER_REPO and len(rows) <= V.TARGET_DOCUMENTS


def test_cohorts_hold_only_their_year(repos, files):
    _, drawn = S.sample_cohorts(repos, files, 2015, 2018, quota=S.Quota(5, result_cap=50))
    rows = drawn.collect()
    assert {r.cohort_year for r in rows} == {2015, 2016, 2017, 2018}
    assert all(r.created_at.startswith(str(r.cohort_year)) for r in rows)
    for year in range(2015, 2019):
        assert len([r for r in rows if r.cohort_year == year]) <= V.TARGET_DOCUMENTS


def test_hot_repository_is_cut_before_the_shuffle(repos, files):
    key = S.seeded_order(F.lit(1), F.col("path"))
    plan = physical_plan(S.cap_per_group(files, ["full_name"], [key]))
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_salted_ranks_equal_a_full_sort(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", (i * 7919) % 1009, i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, v int, id int").repartition(9)
    got = S.top_ranked(frame, ["g"], [F.desc("v"), F.col("id")], 40, "rank").collect()
    want = set()
    for g in {r[0] for r in rows}:
        best = sorted((-v, i) for h, v, i in rows if h == g)[:40]
        want |= {(g, i, n + 1) for n, (_, i) in enumerate(best)}
    assert {(r.g, r.id, r["rank"]) for r in got} == want


@pytest.mark.parametrize("sample", [840, 7 * 2000])
def test_draws_of_any_size_are_the_same_rows(repos, files, monkeypatch, sample):
    """120 rows a stratum, and more than half the population: by ranks of whole strata and by buckets of hashes."""
    quota, limits = S.Quota(7, sample), S.Limits(documents=sample // 3, files_per_repo=3)
    got = []
    for large in (10**9, 0):
        monkeypatch.setattr(S, "LARGE", large)
        assigned = S.assign(repos, S.daily_strata(F.lit(DAY)))
        window = S.stratum_window(assigned, S.date_seed(F.lit(DAY)), quota)
        _, drawn = S.sample_day(repos, files, DAY, quota=quota, limits=limits)
        _, cohorts = S.sample_cohorts(repos, files, 2015, 2018, quota=S.Quota(5, sample), limits=limits)
        rows = [{(r.full_name, r.strategy, r.stratum, r["rank"]) for r in window.collect()}]
        rows.append({(r.full_name, r.path, r.stratum, r.pick) for r in drawn.collect()})
        rows.append({(r.cohort_year, r.full_name, r.path, r.draw) for r in cohorts.collect()})
        got.append(rows)
        plan = physical_plan(window)
        assert ("begins" in plan) == (large == 0)
    assert got[0] == got[1] and all(got[0])
    assert max(n for *_, n in got[0][0]) <= quota.per_stratum


def test_buckets_split_a_group_and_keep_its_order(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", f"{(i * 7919) % 4096:04x}", i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, h string, id int").repartition(7)
    for k in (1, 40, 900, 5000):
        got = S.first_hashed(frame, ["g"], [F.col("h"), F.col("id")], k, "rank").collect()
        want = {(g, i, n + 1) for g in {r[0] for r in rows} for n, (_, i) in enumerate(sorted((h, i) for x, h, i in rows if x == g)[:k])}
        assert {(r.g, r.id, r["rank"]) for r in got} == want
    whole = S.first_hashed(frame, [], [F.col("h"), F.col("id")], 100, "rank")
    assert [r.id for r in sorted(whole.collect(), key=lambda r: r["rank"])] == [i for _, i in sorted((h, i) for _, h, i in rows)[:100]]
    assert S.first_hashed(frame.where("false"), ["g"], [F.col("h")], 5, "rank").count() == 0
