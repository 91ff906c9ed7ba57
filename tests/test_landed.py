"""Landed files by name: batches of a listing, and what cannot be read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_census import DAILY, DAY, landed as census_inputs  # noqa: F401

from tallyfold.plans import census
from tallyfold.sources import landed, readers

LISTING = "full_name string, path string, size bigint"


def listing(spark, *rows):
    return spark.createDataFrame(list(rows), LISTING)


def batches(spark, folder):
    rows = spark.read.schema(f"{LISTING}, batch string").parquet(f"{folder}/names")
    out = {}
    for r in rows.collect():
        out.setdefault(r.batch, []).append((r.full_name, r.path, r["size"]))
    return list(out.values())


def test_batches_hold_equal_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landed, "_SORTED", 40)  # several groups
    files = [(f"o/r{i % 7}", f"{i}.ipynb", 10_000 if i == 5 else i % 13) for i in range(200)] + [("o/r0", "0.ipynb", 0), ("o/x", "null", None)]
    landed.store_batches(listing(spark, *files), str(tmp_path), batch_bytes=60, batch_files=9)
    found = batches(spark, str(tmp_path))
    assert sorted(f for b in found for f in b) == sorted((r, p, n or 0) for r, p, n in files)
    assert all(len(b) <= 9 and sum(n for *_, n in sorted(b)[:-1]) <= 60 + 10_000 * any(n == 10_000 for *_, n in b) for b in found)
    plan = [r.asDict() for r in spark.read.json(f"{tmp_path}/batches").collect()]
    assert len(plan) == len(found) and sum(b["files"] for b in plan) == len(files) and sum(b["bytes"] for b in plan) == sum(n or 0 for *_, n in files)


def test_files_are_read_by_name_alone(spark, tmp_path):
    root, plan = str(tmp_path / "tree"), str(tmp_path / "plan")
    rows = [("o/a", "deep/x.ipynb", b'{"x":"\xff"}'), ("o/a", "é.ipynb", "ñ漢".encode()), ("o/b", "empty", b""), ("o/b", "null", None), ("o/b", "unlisted", b"no")]
    assert landed.write_files(spark.createDataFrame(rows, "full_name string, path string, content binary").repartition(3), root) == 5
    (tmp_path / "tree" / "o" / "folder").mkdir()
    (tmp_path / "secret").write_text("outside")
    odd = [("o/gone", "x"), ("o", "folder"), ("o/a", "../../../secret"), ("..", "secret"), (None, "x"), ("o/a", None), ("o/a", ""), ("o/a", "é.ipynb")]
    landed.store_batches(listing(spark, *((r, p, 3) for r, p, _ in rows[:4]), *((r, p, 1) for r, p in odd)), plan, batch_files=2)
    frame = landed.documents(spark, plan, root)
    got = {(r.full_name, r.path): (r.size_bytes, r.raw) for r in frame.where("error IS NULL").collect()}
    assert got == {("o/a", "deep/x.ipynb"): (9, '{"x":"�"}'), ("o/a", "é.ipynb"): (5, "ñ漢"), ("o/b", "empty"): (0, ""), ("o/b", "null"): (0, "")}
    lost = frame.where("error IS NOT NULL").collect()
    assert {(r.full_name, r.path) for r in lost} == set(odd[:7]) and all(r.raw is None and r.size_bytes is None for r in lost)
    assert frame.count() == 12  # what is listed twice is read twice


def test_planning_touches_no_landed_folder(spark, tmp_path):
    """There is no tree at all: the plan is made, and every file is counted as unreadable."""
    plan = str(tmp_path / "plan")
    landed.store_batches(listing(spark, *((f"o/r{i}", "x.ipynb", 1) for i in range(30))), plan, batch_files=5)
    frame = landed.documents(spark, plan, str(tmp_path / "nowhere"))
    assert frame.rdd.getNumPartitions() == len(batches(spark, plan)) >= 6
    assert [tuple(r) for r in frame.groupBy("error").count().collect()] == [("FileNotFoundError", 30)]


def test_no_names_no_rows(spark, tmp_path):
    landed.store_batches(listing(spark), str(tmp_path))
    assert landed.documents(spark, str(tmp_path), "/nowhere").count() == 0


def test_a_run_reads_its_drawn_files_from_the_tree(spark, census_inputs, tmp_path):  # noqa: F811
    repos, files, contents = census_inputs
    tree = str(tmp_path / "tree")
    landed.write_files(contents.withColumnRenamed("raw", "content"), tree)
    by_name = census.run_day(spark, repos, files, tree, str(tmp_path / "a"), DAY, quota=DAILY).first()
    by_join = census.run_day(spark, repos, files, contents, str(tmp_path / "b"), DAY, quota=DAILY).first()
    assert by_name == by_join and by_name.notebooks_collected > 0
    a, b = (readers.stored(spark, f"{tmp_path}/{x}/observations").orderBy("repo_full_name", "path").collect() for x in "ab")
    assert a == b


@pytest.mark.parametrize("size", [0, 1])
def test_contents_are_handed_on_in_parts(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(landed, "_YIELD", size)
    rows = spark.range(20).select(F.lit("o/r").alias("full_name"), F.col("id").cast("string").alias("path"), F.col("id").cast("string").alias("content"))
    landed.write_files(rows, str(tmp_path / "t"))
    reader = landed.LandedReader(str(tmp_path / "p"), str(tmp_path / "t"))
    landed.store_batches(rows.select("full_name", "path", F.lit(1).alias("size")), str(tmp_path / "p"))
    (one,) = reader.partitions()
    parts = list(reader.read(one))
    assert len(parts) == 20 and sorted(int(c) for p in parts for c in p["content"].to_pylist()) == list(range(20))
