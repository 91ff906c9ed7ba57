"""The cell-table operators against brute force, with one very large document."""

from __future__ import annotations

import json
import random
import re
from itertools import pairwise

import pytest
from plan_text import physical_plan

from tallyfold.operators import cell_table as C
from tallyfold.operators.parse import parse_documents


def brute(counts):
    clean = list(range(1, len(counts) + 1))
    return (
        len(counts),
        max(counts, default=0),
        sum(b <= a for a, b in pairwise(counts)),
        bool(counts) and sorted(counts) != clean,
        bool(counts) and counts == clean,
    )


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(7)
    docs = {"clean": list(range(1, 40)), "shuffled": rng.sample(range(1, 40), 39), "none": [None] * 3, "one": [1], "twice": [1, 1]}
    docs |= {f"d{i}": [rng.choice([None, 0, *range(1, 9)]) for _ in range(rng.randint(1, 30))] for i in range(40)}
    docs["hot"] = [rng.randint(1, 500) for _ in range(700)]
    return docs


@pytest.mark.parametrize("block", [1, 3, 64, 4096])
def test_anomalies_do_not_depend_on_the_block(spark, documents, block):
    rows = [(k, i, n) for k, counts in documents.items() for i, n in enumerate(counts) if n]
    runs = spark.createDataFrame(rows, "key string, pos int, count bigint")
    got = {r.key: r.execution_order_anomalies for r in C.order_anomalies(runs, "key", "pos", block).collect()}
    assert got == {k: brute([n for n in c if n])[2] for k, c in documents.items() if any(c)}


def test_cell_table_equals_whole_documents(spark, documents):
    kinds = ["code", "code", "code", "markdown", "raw", "odd"]
    raws, cells = [], []
    for key, counts in documents.items():
        doc = [
            {"cell_type": kinds[(i + len(key)) % 6], "source": "x\n" * (i % 4) + "y" * (i % 3), "execution_count": n}
            for i, n in enumerate(counts)
        ] + [5]
        raws.append((key, json.dumps({"cells": doc})))
        cells += [(key, i, json.dumps(c)) for i, c in enumerate(doc)]
    table = spark.createDataFrame(cells, "key string, pos int, cell string")
    features = C.cell_table_features(C.typed_cells(table, "key", "pos"), "key", "pos")
    whole = parse_documents(spark.createDataFrame(raws, "key string, raw string"))
    names = sorted(set(features.columns) & set(whole.columns))
    assert len(names) == 19
    assert {tuple(r) for r in features.select(names).collect()} == {tuple(r) for r in whole.select(names).collect()}


def test_one_number_on_very_many_cells(spark):
    """A hundred thousand cells with one number are no group of a window."""
    hot = spark.range(100_000).selectExpr("'hot' AS key", "cast(id AS int) AS pos", "1L AS count")
    odd = spark.createDataFrame([(None, 0, 1), (None, 1, 2), ("x", 0, 2), ("x", 1, 2)], "key string, pos int, count bigint")
    rows = hot.unionByName(odd).selectExpr("key", "pos", "'code' AS kind", "count AS execution_count")
    profile = C.execution_profile(rows, "key", "pos")
    got = {r.key: (r.executed_code_cells, r.max_execution_count, r.execution_order_anomalies, r.has_execution_gaps, r.fully_executed_in_order) for r in profile.collect()}
    assert got == {"hot": (100_000, 1, 99_999, True, False), None: (2, 2, 0, False, True), "x": (2, 2, 1, True, False)}
    windows = re.findall(r"windowspecdefinition\(([^)]*)", physical_plan(profile))
    assert windows and all("block" in w and "run" not in w.split("ASC")[0] for w in windows)
