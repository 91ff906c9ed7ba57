"""Imports and detection on literal sources."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyfold.fixed_values import LIBRARIES, MODULE_TO_LIBRARY, REGISTRY
from tallyfold.functions import text as T
from tallyfold.operators import detect
from tallyfold.operators.imports import ast_imports, tree_reader
from tallyfold.operators.parse import with_imports

SOURCES = {
    "alias": ("import os, sys as s", {"os", "sys"}),
    "dotted": ("from a.b import c\nimport sklearn.linear_model as lm", {"a", "sklearn"}),
    "relative": ("from . import utils\nfrom .x import y", set()),
    "magic": ("!pip install torch\nimport torch\n%matplotlib inline", {"torch"}),
    "python2": ("print 1\nimport re, json", {"re"}),
    "docstring": ('"""\nimport fake\n"""\nx = 1', {"fake"}),
    "nested": ("try:\n    import ujson as json\nexcept ImportError:\n    import json", {"ujson", "json"}),
    # the second line alone reads as an import line, and both readings count
    "spread": ("from a.b \\\n  import c", {"a", "c"}),
    "text": ("x = 'no names here'", set()),
    "inside": ("if 1: import late", {"late"}),
    "broken": ("import (", set()),
    "accent": ("import été", {"été"}),
    "return": ("a = 1\rimport one\r", {"one"}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(k, [v[0]]) for k, v in SOURCES.items()], "id string, sources array<string>")
    return {r.id: set(r.imports) for r in with_imports(rows.withColumnRenamed("sources", "import_sources")).collect()}


@pytest.mark.parametrize("name", sorted(SOURCES))
def test_imports_of_a_cell(found, name):
    assert found[name] == SOURCES[name][1]


def test_one_bad_cell_does_not_hide_the_others(spark):
    rows = spark.createDataFrame([(["def (:", "import numpy, scipy", "import pandas\n"],)], "import_sources array<string>")
    assert with_imports(rows).first().imports == ["numpy", "pandas", "scipy"]


PIECES = [
    "import a", "import a.b as c  # import z", "  import q", "import a, b", "import os . path", "from x import y", "from x.y import (p,",
    "  q)", "from . import r", "from x import y; import w", "if 1: import late", "x = 1", "%run import k", "!import j", '"""', "import (",
    "from x \\", "import été", "import ﬁle", "import b\rimport c", "try:", "    from deep import d", "from foo", "import bar",
    "import tail#x", "\x0cimport f", "raise E from None", "importlib.reload(a)", "import", "from  a.b  import  c as import_d",
]


def test_plain_cells_lose_nothing_without_a_tree(spark):
    """All pairs and many longer runs of lines: where no tree is asked for, the
    tree has no name that the line patterns lack."""
    rng, names_in = random.Random(3), tree_reader()
    texts = ["\n".join(p) for p in itertools.product(PIECES, repeat=2)]
    texts += ["\n".join(rng.choices(PIECES, k=rng.randint(1, 5))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    seen = rows.select("s", T.needs_tree(F.col("s")).alias("tree"), T.regex_imports(F.col("s")).alias("lines"), T.strip_magics(F.col("s")).alias("clean"))
    plain = 0
    for r in seen.collect():
        if not r.tree:
            plain += 1
            assert set(names_in(r.clean) or []) <= set(r.lines), r.s
    assert plain > 500


def test_tree_helper_gives_null_for_invalid_source(spark):
    names_in = tree_reader()
    assert names_in("def (:") is None and names_in("x\x00") is None and names_in("") == []
    rows = spark.createDataFrame([(["import a", "def (:"],)], "s array<string>")
    assert rows.select(ast_imports(F.col("s")).alias("n")).first().n == [["a"], None]


def test_magic_lines_are_blanked(spark):
    rows = spark.createDataFrame([("a\n  %time b\n!ls\nc % d",)], "s string")
    assert rows.select(T.strip_magics(F.col("s"))).first()[0] == "a\n\n\nc % d"


def test_modules_map_to_libraries(spark):
    rows = spark.createDataFrame([(["sklearn", "lightning", "pytorch_lightning", "nowhere", "pylab"],)], "imports array<string>")
    r = detect.with_detection(rows).first()
    assert r.libraries == ["matplotlib", "pytorch_lightning", "scikit_learn"]
    assert r.categories == ["deep_learning", "ml", "plotting"]


def test_registry_is_consistent(spark):
    assert len(LIBRARIES) == len(set(LIBRARIES)) == 42
    assert len(MODULE_TO_LIBRARY) == sum(len(r[1]) for r in REGISTRY) == 47
    assert len({r[2] for r in REGISTRY}) == 9
    assert detect.registry_frame(spark).count() == 47


def test_missing_category_becomes_other(spark):
    registry = spark.createDataFrame([("lib", ["m"], None, None)], detect.REGISTRY_SCHEMA)
    assert detect.module_rows(registry).first().category == "other"


def test_join_detection_matches_the_lookup(spark):
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(MODULE_TO_LIBRARY)] * 3 + [(999, "nowhere")], "id int, module string")
    hits = {r.id: r.libraries for r in detect.detect_by_join(rows, detect.registry_frame(spark), "id").collect()}
    assert hits == {i: [lib] for i, lib in enumerate(MODULE_TO_LIBRARY.values())}


def test_a_module_of_all_documents_is_split(spark):
    from plan_text import physical_plan

    rows = spark.range(4000).select("id", F.explode(F.array(F.lit("numpy"), F.concat(F.lit("m"), "id"))).alias("module"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = detect.detect_by_join(rows, detect.registry_frame(spark), "id")
        plan = physical_plan(found)
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(got) == 4000 and all(r.libraries == ["numpy"] for r in got)
    assert "hashpartitioning(module" in plan and "salt" in plan.split("hashpartitioning(module")[1][:60]


def test_only_registry_rows_of_hot_modules_are_copied(spark):
    draw = [m for i in range(3000) for m in ("numpy", f"m{i % 700}", "pandas" if i % 3 else "rare")] + [None] * 500
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(draw)], "id int, module string").repartition(4)
    hot = detect.hot_modules(rows)
    assert hot == ["numpy", "pandas", "rare"] and detect.hot_modules(rows, 0.3) == ["numpy"] and detect.hot_modules(rows.where("false")) == []
    entries = detect.registry_frame(spark).select("module", "library", "category").distinct()
    copied = {r.module: r["count"] for r in detect.salted_entries(entries, hot).groupBy("module").count().collect()}
    assert copied == {m: detect.SALTS if m in hot else 1 for m in MODULE_TO_LIBRARY}
    registry = detect.registry_frame(spark)
    plain, salted = (sorted(map(str, detect.detect_by_join(rows, registry, "id", h).collect())) for h in ([], hot))
    assert plain == salted == sorted(map(str, detect.detect_by_join(rows, registry, "id").collect())) and len(plain) == 5000


def test_a_small_registry_is_known_by_its_size(spark):
    small = spark.sql("SELECT 'm' AS module, 'l' AS library, 'c' AS category")
    assert detect.is_small(small) and not detect.is_small(spark.range(10_000_000))
