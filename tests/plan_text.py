"""The physical plan of a frame as text, for tests that look at plans."""

from __future__ import annotations


def physical_plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()
