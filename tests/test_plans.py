"""Plans: what is read, what is shuffled, and what must never appear."""

from __future__ import annotations

import re

import pytest
from plan_text import physical_plan

import __spark_entry__ as registered

QUERIES = registered.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_or_nested_loop_joins(spark, sf_dir, name):
    plan = physical_plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BatchEvalPython" not in plan
    assert plan.count("nbformat,VariantType") <= 1


ROW_LOCAL = ["observation_rows", "document_features", "cell_text", "largest_payload", "wide_flags", "score_vector"]


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_documents_are_read_without_a_data_shuffle(spark, sf_dir, name):
    plan = physical_plan(QUERIES[name](spark, sf_dir))
    # a small file may be spread by round robin; nothing is shuffled by key
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("agg_bool_share", {"quality", "toxic"}),
        ("score_saturating", {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"}),
        ("agg_distinct", {"ts", "user_id"}),
    ],
)
def test_only_needed_columns_are_read(spark, sf_dir, name, columns):
    plan = physical_plan(QUERIES[name](spark, sf_dir))
    (schema,) = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert {c.split(":")[0] for c in schema.split(",")} == columns


def test_one_day_is_a_partition_filter(spark, sf_dir):
    assert re.search(r"PartitionFilters: \[isnotnull\(date", physical_plan(QUERIES["read_one_day"](spark, sf_dir)))


@pytest.mark.parametrize("name", ["stratum_window", "dedup_pool", "cap_per_group", "sample_day", "backfill_cohorts"])
def test_groups_are_limited_before_the_shuffle(spark, sf_dir, name):
    assert "WindowGroupLimit" in physical_plan(QUERIES[name](spark, sf_dir))


def test_run_target_is_a_top_k(spark, sf_dir):
    assert "TakeOrderedAndProject" in physical_plan(QUERIES["cap_total"](spark, sf_dir))


@pytest.mark.parametrize("name", ["aggregate_days", "census_snapshot", "census_adoption", "adoption_dense", "cell_tallies"])
def test_facts_are_hashed_and_combined_not_sorted(spark, sf_dir, name):
    plan = physical_plan(QUERIES[name](spark, sf_dir))
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan


def test_small_pool_is_broadcast_by_its_size(spark, sf_dir):
    plan = physical_plan(QUERIES["sample_day"](spark, sf_dir))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
