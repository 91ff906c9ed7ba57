"""Sources, sinks and views on a temporary folder."""

from __future__ import annotations

import json
from datetime import date

import pytest
from plan_text import physical_plan
from pyspark.sql import functions as F

from tallyfold.session import scratch_folder
from tallyfold.sources import readers, sinks, views

D1, D2, D3 = date(2026, 1, 1), date(2026, 1, 2), date(2026, 1, 3)


def rows(spark, *values, schema="run_date date, x int"):
    return spark.createDataFrame(list(values), schema)


def test_writing_a_date_again_replaces_only_it(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.write_dates(rows(spark, (D1, 1), (D2, 2), (D3, 3)), root)
    for _ in range(2):
        sinks.write_dates(rows(spark, (D2, 20), (D2, 21)), root)
    got = sorted((r.run_date, r.x) for r in readers.stored(spark, root).collect())
    assert got == [(D1, 1), (D2, 20), (D2, 21), (D3, 3)]


def test_run_date_is_added_when_absent(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.write_dates(spark.range(3), root, D2)
    assert {r.run_date for r in readers.stored(spark, root).collect()} == {D2}


def test_one_date_reads_one_folder(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.write_dates(rows(spark, (D1, 1), (D2, 2)), root)
    day = readers.observations(spark, root, D2)
    assert [r.x for r in day.collect()] == [2]
    plan = physical_plan(day)
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: []" in plan
    assert all(f"date={D2}" in f for f in day.inputFiles())
    assert readers.observations(spark, root, D3) is None
    wider = readers.with_date(day.drop("date").withColumn("note", F.lit("")).schema)
    assert readers.observations(spark, root, D3, wider).isEmpty()
    assert readers.observations(spark, root, D2, wider).first().note is None


def test_columns_of_all_files_are_read(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.write_dates(rows(spark, (D1, 1)), root)
    sinks.write_dates(rows(spark, (D2, 2, "n"), schema="run_date date, x int, note string"), root)
    assert sorted((r.x, r.note) for r in readers.stored(spark, root).collect()) == [(1, None), (2, "n")]


def test_missing_tables(spark, tmp_path):
    assert readers.stored(spark, str(tmp_path / "none")) is None
    empty = readers.stored(spark, str(tmp_path / "none"), "run_date date, x int")
    assert empty.columns == ["run_date", "x"] and empty.isEmpty()


def test_upsert_replaces_keys_and_unions_columns(spark):
    old = rows(spark, (D1, 1), (D2, 2), (D2, 3))
    new = rows(spark, (D2, 9, "n"), (D3, 10, "m"), schema="run_date date, x int, note string")
    got = sorted((r.run_date, r.x, r.note) for r in sinks.upsert(old, new).collect())
    assert got == [(D1, 1, None), (D2, 9, "n"), (D3, 10, "m")]


def test_csv_mirror_is_in_date_order(spark, tmp_path):
    path = str(tmp_path / "csv")
    sinks.write_csv(rows(spark, (D3, 3), (D1, 1)), path)
    back = spark.read.option("header", "true").csv(path)
    assert sorted((r.run_date, r.x) for r in back.collect()) == [("2026-01-01", "1"), ("2026-01-03", "3")]


def test_views_and_sql(spark, tmp_path):
    root = str(tmp_path)
    sinks.write_dates(rows(spark, (D1, 1), (D2, 2)), f"{root}/observations")
    assert views.register_views(spark, root) == ["observations"]
    r = views.query(spark, "SELECT sum(x) AS s, count(DISTINCT filename) AS files FROM observations").first()
    assert (r.s, r.files) == (3, 2)


def test_landed_files(spark, tmp_path):
    folder = tmp_path / "own" / "repo" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.ipynb").write_bytes(b'{"x":"\xff"}')
    (folder / "big.ipynb").write_bytes(b" " * 50)
    (folder / "note.txt").write_text("no")
    got = readers.raw_documents(spark, str(tmp_path), max_bytes=20).collect()
    assert [(r.full_name, r.path, r.size_bytes, r.raw) for r in got] == [("own/repo", "deep/a.ipynb", 9, '{"x":"�"}')]


def test_json_sources(spark, tmp_path):
    def put(name, *objects):
        path = tmp_path / name
        path.write_text("\n".join(json.dumps(o) for o in objects))
        return str(path)

    got = readers.repos(spark, put("repos", {"full_name": "a/b"}, {"full_name": "c/d", "stargazers_count": 5, "topics": ["t"]}))
    found = {r.full_name: r for r in got.collect()}
    assert (found["a/b"].default_branch, found["a/b"].stars, found["a/b"].created_at, found["a/b"].topics) == ("main", 0, "", [])
    assert (found["c/d"].stars, found["c/d"].topics) == (5, ["t"])
    tree = [{"type": "blob", "path": "x.ipynb", "size": 3}, {"type": "tree", "path": "d"}]
    got = readers.repo_files(spark, put("trees", {"full_name": "a/b", "tree": tree}, {"full_name": "c/d"}))
    assert sorted((r.path, r.size) for r in got.collect()) == [("d", 0), ("x.ipynb", 3)]
    packages = readers.packages(spark, put("pk", {"info": {"name": "numpy", "version": "2"}, "releases": {"1": "", "2": ""}}))
    registry = spark.createDataFrame([("numpy", "numpy"), ("none", "none")], "library string, pypi string")
    got = {r.library: (r.version, r.release_count) for r in readers.enrich(registry, packages).collect()}
    assert got == {"numpy": ("2", 2), "none": (None, None)}


def test_scratch_folder_is_under_the_named_root(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    a, b = scratch_folder(spark, "x"), scratch_folder(spark, "x")
    assert a != b and a.startswith(root) and b.startswith(root)


def test_modes_of_one_date_are_kept_apart(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.write_dates(rows(spark, (D1, 1)), root)
    sinks.write_dates(rows(spark, (D1, 2)), root, collection_type="cohort")
    sinks.write_dates(rows(spark, (D1, 3, None), schema="run_date date, x int, collection_type string"), root)
    got = sorted((r.collection_type, r.x) for r in readers.stored(spark, root).collect())
    assert got == [("cohort", 2), ("daily", 3)]


def test_dates_of_a_run_without_rows_are_emptied(spark, tmp_path):
    root = str(tmp_path / "t")
    for mode in ("daily", "cohort"):
        sinks.write_dates(rows(spark, (D1, 1), (D2, 2), (D3, 3)), root, collection_type=mode)
    sinks.write_dates(rows(spark, (D2, 20)), root, replaced=[D1, D2, date(2030, 1, 1)])
    got = sorted((r.collection_type, r.run_date, r.x) for r in readers.stored(spark, root).collect())
    assert got == [("cohort", D1, 1), ("cohort", D2, 2), ("cohort", D3, 3), ("daily", D2, 20), ("daily", D3, 3)]


def test_contents_are_read_in_the_drawn_buckets_only(spark, tmp_path):
    from tallyfold.plans.census import land

    names = [f"o/r{i}" for i in range(40)]
    documents = spark.createDataFrame([(n, "a", 1, f"text {n}") for n in names], "full_name string, path string, size_bytes bigint, raw string")
    sinks.write_contents(documents, str(tmp_path))
    drawn = spark.createDataFrame([("o/r3", "a"), ("o/r3", "gone"), (None, "a")], "full_name string, path string")
    landed = land(drawn, readers.contents(spark, str(tmp_path)))
    assert {(r.full_name, r.path, r.raw) for r in landed.collect()} == {("o/r3", "a", "text o/r3"), ("o/r3", "gone", None), (None, "a", None)}
    assert "PartitionFilters: [isnotnull(bucket" in physical_plan(landed) or "PartitionFilters: [bucket" in physical_plan(landed)


@pytest.mark.parametrize("size", [1, 5000])
def test_a_hot_date_is_written_whole(spark, tmp_path, size):
    root = str(tmp_path / "hot")
    days = spark.range(size).select(F.lit(D1).alias("run_date"), F.col("id").alias("x"))
    sinks.write_dates(days.unionByName(spark.range(5).select(F.lit(D2).alias("run_date"), F.col("id").alias("x"))), root)
    assert readers.observations(spark, root, D1).count() == size
