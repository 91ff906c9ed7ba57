"""Figures of any span from stored states, and dates that arrive in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.checks import bindings as B
from tallyfold.checks.aggregation import _DAY_SQL, EV
from tallyfold.checks.registry import query
from tallyfold.operators import states
from tallyfold.session import scratch_folder
from tallyfold.sources import readers
from tallyfold.sources.runs import Run
from tallyfold.streaming import landing

ORDERS = states.Measures(scores=("score",), means={"mean_total_cells": "total_cells"}, shares={"pct_urgent": "urgent"}, libraries={lib: category for lib, category in B.PRIORITY_LIBRARIES.values()})
EVENTS = states.Measures(scores=("score",), means={}, medians={}, shares={}, libraries=B.EVENT_CATEGORIES)
ERROR = 3 * 1.04 / 2 ** (states.LOG_BUCKETS / 2)  # three standard errors of an estimate


def order_states(spark, sf: str) -> DataFrame:
    """One stored state for each order date; the customer is the repository, the clerk the stratum."""

    def write(path: str) -> None:
        orders = B.table(spark, sf, "orders").select(
            F.to_date("o_orderdate").alias("run_date"),
            F.lit("daily").alias("collection_type"),
            F.concat(F.lit("customer/"), "o_custkey").alias("repo_full_name"),
            F.concat(F.lit("shop/"), F.col("o_orderkey") % 50).alias("stratum"),
            (F.col("o_orderstatus") != "P").alias("parse_ok"),
            (F.floor(F.col("o_totalprice") / 100) / 10000).alias("score"),
            (F.col("o_custkey") % 40 + 1).alias("total_cells"),
            (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
            F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("3."), F.col("o_orderkey") % 14)).alias("python_major_minor"),
            (3 + F.col("o_orderkey") % 2).alias("nbformat"),
            *[(F.col("o_orderpriority") == p).alias(f"lib_{lib}") for p, (lib, _) in B.PRIORITY_LIBRARIES.items()],
        )
        states.day_states(orders, measures=ORDERS).write.parquet(path)

    return spark.read.parquet(B.stored_once(spark, sf, "order-states", write))


def by_year(spark, sf: str) -> DataFrame:
    return order_states(spark, sf).withColumn("year", F.year("run_date"))


_ORDERS_SQL = """WITH o AS (SELECT year(o_orderdate) AS year, o_orderkey AS k, o_orderstatus <> 'P' AS ok, floor(o_totalprice / 100)::BIGINT AS score,
  o_custkey, o_custkey % 40 + 1 AS cells, o_orderpriority AS priority FROM orders)"""


@query(
    "yearly_figures",
    f"""{_ORDERS_SQL} SELECT year, count(*) AS notebooks_collected, count(*) FILTER (ok) AS notebooks_parsed,
  round(count(*) FILTER (ok) * 10000 / count(*)::DOUBLE) / 10000e0 AS parse_success_rate,
  round(sum(score) FILTER (ok)::DOUBLE / count(*) FILTER (ok)) / 10000e0 AS score_mean, round(median(score) FILTER (ok)) / 10000e0 AS score_median,
  round(sum(cells * 1000) FILTER (ok)::DOUBLE / count(*) FILTER (ok)) / 1000e0 AS mean_total_cells, median(cells) FILTER (ok) AS median_total_cells,
  round(count(*) FILTER (ok AND priority = '1-URGENT') * 10000 / count(*) FILTER (ok)::DOUBLE) / 10000e0 AS pct_urgent,
  round(count(*) FILTER (ok AND k % 3 > 0) * 10000 / count(*) FILTER (ok)::DOUBLE) / 10000e0 AS pct_with_python_version,
  round(sum((3 + k % 2) * 1000) FILTER (ok)::DOUBLE / count(*) FILTER (ok)) / 1000e0 AS mean_nbformat,
  round(count(*) FILTER (ok AND k % 2 = 1) * 10000 / count(*) FILTER (ok)::DOUBLE) / 10000e0 AS pct_nbformat_4 FROM o GROUP BY year""",
)
def yearly_figures(spark, sf):
    """Means and exact medians of years, from the states of their days alone."""
    return states.summary(by_year(spark, sf), ("year",), ORDERS).drop("repos_estimate", "strata_estimate")


@query(
    "yearly_adoption",
    f"""{_ORDERS_SQL}, n AS (SELECT year, count(*) FILTER (ok) AS parsed FROM o GROUP BY year),
  l(priority, library, category) AS (VALUES ('1-URGENT','numpy','array'),('2-HIGH','pandas','array'),('3-MEDIUM','scipy','scientific'),
  ('4-NOT SPECIFIED','keras','deep_learning'),('5-LOW','plotly','plotting')),
  c AS (SELECT year, priority, count(*) FILTER (ok) AS n FROM o GROUP BY ALL)
  SELECT n.year, 'daily' AS collection_type, library, category, coalesce(c.n, 0) AS notebook_count, round(coalesce(c.n, 0) * 100000 / parsed::DOUBLE) / 1000e0 AS adoption_pct
  FROM n CROSS JOIN l LEFT JOIN c ON c.year = n.year AND c.priority = l.priority""",
)
def yearly_adoption(spark, sf):
    return states.adoption(by_year(spark, sf), ("year",), measures=ORDERS)


@query(
    "yearly_version_share",
    f"""{_ORDERS_SQL}, v AS (SELECT year, '3.' || k % 14 AS value, count(*) AS n FROM o WHERE ok AND k % 3 > 0 GROUP BY ALL)
  SELECT *, round(n * 10000 / (sum(n) OVER (PARTITION BY year))::DOUBLE) / 100e0 AS pct FROM v""",
)
def yearly_version_share(spark, sf):
    return states.version_shares(by_year(spark, sf), ("year",))


_DISTINCT = "count(DISTINCT o_custkey) AS repos, count(DISTINCT o_orderkey % 50) AS strata, true AS repos_within, true AS strata_within"


@query(
    "span_distinct",
    f"""SELECT 'week ' || strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS span, {_DISTINCT} FROM orders GROUP BY 1
  UNION ALL SELECT 'year ' || year(o_orderdate), {_DISTINCT} FROM orders GROUP BY 1 UNION ALL SELECT 'all', {_DISTINCT} FROM orders""",
)
def span_distinct(spark, sf):
    """Distinct repositories and strata of weeks, years and the whole, estimated from the sketches of days, beside the
    exact counts; an estimate has to lie within three standard errors and half a count."""
    week = F.concat(F.lit("week "), F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd"))
    spans = F.explode(F.array(week, F.concat(F.lit("year "), F.year("day")), F.lit("all"))).alias("span")
    held = order_states(spark, sf).withColumn("day", F.col("run_date")).select("*", spans)
    estimate = states.summary(held, ("span",), ORDERS).select("span", "repos_estimate", "strata_estimate")
    orders = B.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), "o_custkey", (F.col("o_orderkey") % 50).alias("stratum"))
    exact = orders.select("o_custkey", "stratum", spans).groupBy("span").agg(F.countDistinct("o_custkey").alias("repos"), F.countDistinct("stratum").alias("strata"))
    within = [(F.abs(F.col(f"{c}_estimate") - F.col(c)) <= ERROR * F.col(c) + 0.5).alias(f"{c}_within") for c in ("repos", "strata")]
    return exact.join(estimate, "span").select("span", "repos", "strata", *within)


@query("landed_in_batches", f"{EV}, d AS ({_DAY_SQL.format(where='')}) SELECT *, 3 AS states, notebooks_collected AS rows_aggregated FROM d")
def landed_in_batches(spark, sf):
    """Events in three batches: each row is aggregated once, in its batch, and the dates' figures come from the states."""
    root = scratch_folder(spark, "batches")
    rows = B.event_observations(spark, sf).withColumns({"collection_type": F.lit("daily"), "path": F.col("event_id").cast("string")})
    for part in range(3):
        run = Run(spark, root)
        landing.absorb(run, rows.where(F.col("event_id") % 3 == part), EVENTS)
        run.commit()
    held = readers.stored(spark, f"{root}/day_states").groupBy("run_date").agg(F.count("*").cast("int").alias("states"), F.sum("collected_n").alias("rows_aggregated"))
    adoption = readers.stored(spark, f"{root}/library_adoption")
    counts = adoption.groupBy("run_date").agg(*[F.max(F.when(F.col("library") == e, F.col("notebook_count"))).alias(f"{e}_count") for e in B.EVENT_CATEGORIES])
    figures = ["collection_type", "notebooks_collected", "notebooks_parsed", "parse_success_rate", "repos_contributing", "strata_sampled", "score_mean", "score_median"]
    return readers.stored(spark, f"{root}/daily_snapshots").select("run_date", *figures).join(counts, "run_date").join(held, "run_date")
