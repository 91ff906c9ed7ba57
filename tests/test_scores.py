"""Scores against the written formulas, with exact decimal arithmetic."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyfold.functions.rounding import mean_of, median_of, ratio
from tallyfold.functions.scores import SCORES, with_scores

SCHEMA = """total_cells int, code_cells int, markdown_cells int, total_lines bigint, code_lines bigint, markdown_lines bigint,
kernel_name string, python_major_minor string, executed_code_cells int, execution_order_anomalies int, has_execution_gaps boolean,
fully_executed_in_order boolean, import_count int, image_outputs int, widget_output_count int, has_widget_state boolean,
total_outputs int, categories array<string>"""
NAMES = [part.split()[0] for part in SCHEMA.replace("\n", " ").split(",")]
CATEGORIES = ["array", "scientific", "data_io", "ml", "deep_learning", "llm", "plotting", "interactive"]


def row(**given_values):
    base = dict.fromkeys(NAMES, 0) | {"kernel_name": None, "python_major_minor": None, "categories": []}
    base |= dict.fromkeys(["has_execution_gaps", "fully_executed_in_order", "has_widget_state"], False)
    return base | given_values


def s(v, k):
    return Decimal(repr(round(1 - math.exp(-v / k), 4))) if v > 0 else Decimal(0)


def clip(v):
    return float(max(Decimal(0), min(Decimal(1), v)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def dec(x):
    return Decimal(repr(x)).quantize(Decimal("1e-12"), ROUND_HALF_UP)


def expected(f):
    D = Decimal
    code, md = f["code_cells"], f["markdown_cells"]
    has = {c: D(int(c in f["categories"])) for c in CATEGORIES}
    if f["executed_code_cells"] == 0:
        ran = 0.0
    elif f["fully_executed_in_order"]:
        ran = 1.0
    else:
        ran = max(0.0, 1 - f["execution_order_anomalies"] / max(1, f["executed_code_cells"])) * (0.6 if f["has_execution_gaps"] else 1.0)
    balance = math.exp(-abs(math.log(md / code + 1e-9))) if code and md else 0.0
    share = md / (md + code) if md + code else 0.0
    docs = f["markdown_lines"] / f["total_lines"] if f["total_lines"] else 0.0
    return {
        "notebook_size_index": clip(D(".5") * s(f["total_cells"], 40) + D(".5") * s(f["total_lines"], 400)),
        "narrative_index": clip(D(".6") * dec(share) + D(".4") * s(f["markdown_lines"], 60)),
        "reproducibility_score": clip(
            D(".2") * bool(f["kernel_name"]) + D(".2") * bool(f["python_major_minor"]) + D(".45") * dec(ran) + D(".15") * (f["import_count"] > 0)
        ),
        "visualization_density": clip(D(".5") * has["plotting"] + D(".5") * s(f["image_outputs"], 4)),
        "interactive_widget_score": clip(D(".4") * has["interactive"] + D(".3") * f["has_widget_state"] + D(".3") * s(f["widget_output_count"], 2)),
        "scientific_computing_score": clip(D(".5") * has["array"] + D(".35") * has["scientific"] + D(".15") * has["data_io"]),
        "ml_usage_score": clip(D(".4") * has["ml"] + D(".4") * has["deep_learning"] + D(".2") * has["llm"]),
        "complexity_score": clip(
            D(".35") * s(f["code_lines"], 300) + D(".25") * s(f["import_count"], 8) + D(".2") * s(f["total_outputs"], 15)
            + D(".2") * s(len(f["categories"]), 3)
        ),
        "educational_score": clip(D(".6") * dec(balance) + D(".4") * s(f["markdown_lines"], 50)),
        "documentation_density": clip(dec(docs)),
    }


count = st.integers(0, 400)
features = st.fixed_dictionaries(
    {n: count for n in NAMES if n not in ("kernel_name", "python_major_minor", "categories")}
    | {n: st.booleans() for n in ("has_execution_gaps", "fully_executed_in_order", "has_widget_state")}
    | {
        "kernel_name": st.sampled_from([None, "python3"]),
        "python_major_minor": st.sampled_from([None, "3.11"]),
        "categories": st.lists(st.sampled_from(CATEGORIES), unique=True),
    }
)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(features, min_size=20, max_size=60))
def test_scores_follow_the_formulas(spark, rows):
    frame = spark.createDataFrame([tuple([i] + [r[n] for n in NAMES]) for i, r in enumerate(rows)], "i int, " + SCHEMA)
    for got in with_scores(frame).collect():
        want = expected(rows[got.i])
        for name in SCORES:
            assert got[name] == pytest.approx(want[name], abs=1e-9), name
            assert 0 <= got[name] <= 1


def test_empty_document_scores_zero(spark):
    frame = spark.createDataFrame([tuple(row()[n] for n in NAMES)], SCHEMA)
    assert set(with_scores(frame).first()[-len(SCORES):]) == {0.0}


def test_clean_beats_messy(spark):
    clean = row(executed_code_cells=3, fully_executed_in_order=True, kernel_name="k", import_count=2)
    messy = row(executed_code_cells=3, execution_order_anomalies=1, has_execution_gaps=True, import_count=2)
    frame = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in (clean, messy)], SCHEMA)
    a, b = with_scores(frame, "reproducibility_score").collect()
    assert a.reproducibility_score > b.reproducibility_score


def test_means_and_medians_are_half_up_and_order_free(spark):
    frame = spark.createDataFrame([(0.0001,), (0.0002,), (None,)], "x double")
    r = frame.agg(mean_of(F.col("x"), 4, 4).alias("m"), median_of(F.col("x"), 4, 4).alias("d")).first()
    assert (r.m, r.d) == (0.0002, 0.0002)
    nothing = frame.where("x > 1").agg(mean_of(F.col("x"), 4, 4).alias("m"), median_of(F.col("x"), 4, 4).alias("d")).first()
    assert (nothing.m, nothing.d) == (None, None)


def test_ratio_of_nothing_is_null(spark):
    r = spark.range(1).select(ratio(F.lit(0), F.lit(0), 4).alias("none"), ratio(F.lit(1), F.lit(3), 3, 100).alias("third")).first()
    assert (r.none, r.third) == (None, 33.333)
