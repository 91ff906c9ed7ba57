"""A query computes the cell members that it reads, and no others."""

from __future__ import annotations

import pytest

from tallyfold.checks import QUERIES

OUTPUT_SHAPE, OUTPUT_LENGTH = "StructField(output_type", r"[^\x{10000}"


def optimized(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    ("name", "shape", "length"),
    [("score_ml", False, False), ("score_interactive", True, False), ("largest_payload", True, True)],
)
def test_outputs_are_read_where_they_count(spark, sf_dir, name, shape, length):
    plan = optimized(spark, sf_dir, name)
    assert (OUTPUT_SHAPE in plan, OUTPUT_LENGTH in plan) == (shape, length)
