"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import pytest
from oracle import compare

import __spark_entry__ as registered

QUERIES, SQL = registered.queries(), registered.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, tables, name):
    difference = compare(QUERIES[name](spark, sf_dir), tables, SQL[name])
    assert difference in (None, "no rows") if name in MAY_BE_EMPTY else difference is None, difference


# On the smallest table no repository is of the drawn year or topic.
MAY_BE_EMPTY = {"stratum_created_year", "stratum_topic"}


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry_gives_one_row_per_day(spark):
    rows = registered.entry(spark)
    assert rows.count() == rows.select("run_date").distinct().count() > 0
    assert len(rows.columns) > 30


def test_trend_document_is_one_json_object(spark, sf_dir):
    import json

    (row,) = QUERIES["trend_context"](spark, sf_dir).collect()
    context = json.loads(row.context)
    assert set(context) == {"daily_census", "cohorts"} and context["cohorts"]["n_cohorts"]
    top = context["daily_census"]["top_libraries"]
    assert set(top[0]) == {"library", "category", "adoption_pct", "notebook_count"}
    assert [t["adoption_pct"] for t in top] == sorted((t["adoption_pct"] for t in top), reverse=True)
