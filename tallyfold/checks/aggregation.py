"""Aggregations, rankings and history queries over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfold.checks import bindings as B
from tallyfold.checks.registry import query
from tallyfold.fixed_values import SCORE_COLUMNS, STRUCTURE_COLUMNS, TREND_INDICATORS
from tallyfold.functions.rounding import mean_of, median_of, ratio, saturating
from tallyfold.operators import aggregate as A
from tallyfold.operators import ranking, trends
from tallyfold.sources import readers

_QUALITY = [("quality_indices_mean", s, f"{s}_mean") for s in SCORE_COLUMNS] + [("structure", c, c) for c in STRUCTURE_COLUMNS]
EV = f"WITH {B.EVENTS_SQL}"
HI = f"WITH {B.HISTORY_SQL}"
DAY = "strftime(run_date, '%Y-%m-%d') AS run_date"


def _three(column: str) -> str:
    """Half-up at three places by the decimal digits, of which figures have four at most."""
    return f"round({column}::DECIMAL(18, 4), 3)::DOUBLE"


def share_sql(num: str, den: str, places: int, factor: int = 1) -> str:
    unit = 10**places
    return f"CASE WHEN {den} > 0 THEN round({num} * {factor * unit} / ({den})::DOUBLE) / {unit}e0 END"


# --- aggregations -------------------------------------------------------------

@query(
    "agg_parse_rate",
    f"""SELECT source, count(*) AS notebooks_collected, count(*) FILTER (quality = 1) AS notebooks_parsed,
  {share_sql("count(*) FILTER (quality = 1)", "count(*)", 4)} AS parse_success_rate
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
def agg_parse_rate(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", "source")
    labels = B.table(spark, sf, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id", "left").withColumn("parse_ok", F.coalesce(F.col("quality") == 1, F.lit(False)))
    return rows.groupBy("source").agg(*A.volume())


@query(
    "agg_distinct",
    f"""{EV} SELECT {DAY}, count(DISTINCT repo_full_name) AS repos_contributing,
  count(DISTINCT stratum) AS strata_sampled FROM obs GROUP BY ALL""",
)
def agg_distinct(spark, sf):
    return A.contributors(B.event_observations(spark, sf))


@query(
    "agg_mode_label",
    """SELECT year(o_orderdate) AS year, coalesce(min(CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'cohort' END),
  'daily') AS collection_type FROM orders GROUP BY 1""",
)
def agg_mode_label(spark, sf):
    orders = B.table(spark, sf, "orders")
    rows = orders.select(
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"), "cohort").alias("collection_type"),
    )
    return rows.groupBy("year").agg(A.mode_label().alias("collection_type"))


@query(
    "agg_mean_median",
    """SELECT l_returnflag, l_linestatus, round(sum(u)::DOUBLE / count(*)) / 10000e0 AS size_score_mean,
  round(median(u)) / 10000e0 AS size_score_median, round(sum(d)::DOUBLE / count(*)) / 10000e0 AS discount_mean,
  round(median(d)) / 10000e0 AS discount_median
  FROM (SELECT *, round(round(1 - exp(-l_quantity / 40e0), 4) * 10000)::BIGINT AS u,
          round(l_discount * 10000)::BIGINT AS d FROM lineitem) GROUP BY ALL""",
)
def agg_mean_median(spark, sf):
    rows = B.table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", saturating(F.col("l_quantity"), 40).alias("size_score"), F.col("l_discount").alias("discount")
    )
    pairs = [
        out
        for c in ("size_score", "discount")
        for out in (mean_of(F.col(c), 4, 4).alias(f"{c}_mean"), median_of(F.col(c), 4, 4).alias(f"{c}_median"))
    ]
    return rows.groupBy("l_returnflag", "l_linestatus").agg(*pairs)


@query(
    "agg_structural",
    """WITH c AS (SELECT conv_id, count(*) AS total, count(*) FILTER (role = 'assistant') AS code,
  count(*) FILTER (role = 'user') AS prose,
  sum(CASE WHEN rtrim(text, chr(10)) = '' THEN 0 ELSE length(rtrim(text, chr(10)))
      - length(replace(rtrim(text, chr(10)), chr(10), '')) + 1 END) AS lines FROM conversations GROUP BY 1)
  SELECT total AS group_cells, round((sum(total) * 1000)::DOUBLE / count(*)) / 1000e0 AS mean_total_cells,
  round((sum(code) * 1000)::DOUBLE / count(*)) / 1000e0 AS mean_code_cells,
  round((sum(prose) * 1000)::DOUBLE / count(*)) / 1000e0 AS mean_markdown_cells,
  round((sum(lines) * 1000)::DOUBLE / count(*)) / 1000e0 AS mean_total_lines,
  median(code) AS median_code_cells FROM c GROUP BY total""",
)
def agg_structural(spark, sf):
    from tallyfold.checks.conversations import conversation_cells
    from tallyfold.operators.cell_table import cell_tallies

    docs = cell_tallies(conversation_cells(spark, sf), "conv_id")
    return docs.groupBy(F.col("total_cells").cast("bigint").alias("group_cells")).agg(
        *[mean_of(F.col(c), 0, 3).alias(f"mean_{c}") for c in ("total_cells", "code_cells", "markdown_cells", "total_lines")],
        F.median("code_cells").alias("median_code_cells"),
    )


@query(
    "agg_bool_share",
    f"""SELECT quality, {share_sql("count(*) FILTER (toxic = 1)", "count(*)", 4)} AS pct_toxic FROM labels GROUP BY quality""",
)
def agg_bool_share(spark, sf):
    labels = B.table(spark, sf, "labels")
    return labels.groupBy("quality").agg(A.share_of(F.col("toxic") == 1, F.lit(True)).alias("pct_toxic"))


_SHARES = f"""{EV}, counted AS (SELECT run_date, python_major_minor AS value, count(*) AS n FROM obs
  WHERE parse_ok AND python_major_minor IS NOT NULL AND python_major_minor <> '' GROUP BY ALL),
shares AS (SELECT run_date, value, n, round(n * 10000 / (sum(n) OVER (PARTITION BY run_date))::DOUBLE) / 100e0 AS pct FROM counted)"""
EVENT_VERSIONS = [f"3.{minor}" for minor in range(14)]


@query("agg_value_share", f"{_SHARES} SELECT {DAY}, value, n, pct FROM shares")
def agg_value_share(spark, sf):
    return A.version_share(B.event_observations(spark, sf))


@query(
    "agg_value_share_wide",
    f"{_SHARES} SELECT {DAY}, "
    + ", ".join(f"max(pct) FILTER (value = '{v}') AS pyver_{v.replace('.', '_')}_pct" for v in EVENT_VERSIONS)
    + " FROM shares GROUP BY ALL",
)
def agg_value_share_wide(spark, sf):
    return A.version_columns(A.version_share(B.event_observations(spark, sf)), EVENT_VERSIONS)


@query(
    "agg_declared_share",
    f"""{EV} SELECT {DAY}, {share_sql("count(*) FILTER (parse_ok AND python_major_minor <> '')", "count(*) FILTER (parse_ok)", 4)}
  AS pct_with_python_version FROM obs GROUP BY ALL""",
)
def agg_declared_share(spark, sf):
    share = ratio(F.count_if(A.declares_version()), F.count_if(A.parsed()), 4)
    return B.event_observations(spark, sf).groupBy("run_date").agg(share.alias("pct_with_python_version"))


@query(
    "agg_format_mix",
    f"""{EV} SELECT {DAY},
  round((sum(nbformat) FILTER (parse_ok) * 1000)::DOUBLE / nullif(count(nbformat) FILTER (parse_ok), 0)) / 1000e0 AS mean_nbformat,
  {share_sql("count(*) FILTER (parse_ok AND nbformat = 4)", "count(nbformat) FILTER (parse_ok)", 4)} AS pct_nbformat_4
  FROM obs GROUP BY ALL""",
)
def agg_format_mix(spark, sf):
    return B.event_observations(spark, sf).groupBy("run_date").agg(*A.format_mix())


_ADOPTION = "run_date, collection_type, library, category, notebook_count, adoption_pct"


@query("adoption_dense", f"{EV} SELECT {_ADOPTION.replace('run_date', DAY, 1)} FROM event_adoption")
def adoption_dense(spark, sf):
    return A.library_adoption(B.event_observations(spark, sf), B.EVENT_CATEGORIES)


def daily_adoption(spark, sf):
    """The stored adoption rows of the daily mode."""
    return B.history(spark, sf)[1].where(trends.mode() == "daily")


_DAY_SQL = f"""SELECT {DAY}, 'daily' AS collection_type, count(*) AS notebooks_collected,
  count(*) FILTER (parse_ok) AS notebooks_parsed,
  round(count(*) FILTER (parse_ok) * 10000 / count(*)::DOUBLE) / 10000e0 AS parse_success_rate,
  count(DISTINCT repo_full_name) AS repos_contributing, count(DISTINCT stratum) AS strata_sampled,
  round(sum(CASE WHEN parse_ok THEN round(score * 10000)::BIGINT END)::DOUBLE / count(*) FILTER (parse_ok)) / 10000e0 AS score_mean,
  round(median(CASE WHEN parse_ok THEN round(score * 10000)::BIGINT END)) / 10000e0 AS score_median,
  {", ".join(f"count(*) FILTER (parse_ok AND event_type = '{e}') AS {e}_count" for e in B.EVENT_CATEGORIES)}
  FROM obs {{where}} GROUP BY ALL"""


def _aggregate_days(rows):
    measured = rows.groupBy("run_date").agg(
        A.mode_label().alias("collection_type"),
        *A.volume(),
        *A.score_summary(("score",)),
        *[F.count_if(A.parsed() & F.col(f"lib_{e}")).alias(f"{e}_count") for e in B.EVENT_CATEGORIES],
    )
    return measured.join(A.contributors(rows), "run_date")


@query("aggregate_days", f"{EV} {_DAY_SQL.format(where='')}")
def aggregate_days(spark, sf):
    return _aggregate_days(B.event_observations(spark, sf))


@query("reaggregate_one_day", f"{EV} {_DAY_SQL.format(where='WHERE run_date = (SELECT max(run_date) FROM obs)')}")
def reaggregate_one_day(spark, sf):
    from tallyfold.checks.storage import stored_events

    rows = readers.stored(spark, stored_events(spark, sf))
    return _aggregate_days(trends.latest_rows(rows, "date"))


@query(
    "category_rollup",
    f"""{EV} SELECT category, sum(notebook_count)::BIGINT AS notebook_count FROM event_adoption
  WHERE run_date = (SELECT max(run_date) FROM event_adoption) GROUP BY 1 HAVING sum(notebook_count) > 0""",
)
def category_rollup(spark, sf):
    return A.category_rollup(trends.latest_rows(daily_adoption(spark, sf)))


@query(
    "series_span",
    f"""{HI} SELECT collection_type, count(DISTINCT run_date) AS dates, year(min(run_date)) AS first_year,
  year(max(run_date)) AS last_year FROM snapshots GROUP BY 1""",
)
def series_span(spark, sf):
    return trends.series_span(B.history(spark, sf)[0])


# --- history ------------------------------------------------------------------

@query("split_modes", f"{HI} SELECT {DAY}, library, adoption_pct FROM adoption WHERE collection_type = 'cohort'")
def split_modes(spark, sf):
    adoption = B.history(spark, sf)[1]
    return trends.prefer_mode(adoption, "cohort", "daily").select("run_date", "library", "adoption_pct")


@query(
    "mode_fallback",
    f"{EV} SELECT {DAY}, library, adoption_pct FROM event_adoption",
)
def mode_fallback(spark, sf):
    adoption = daily_adoption(spark, sf)
    return trends.prefer_mode(adoption, "cohort", "daily").select("run_date", "library", "adoption_pct")


@query(
    "latest_day",
    f"""{EV} SELECT {DAY}, event_id, event_type, value FROM obs WHERE run_date = (SELECT max(run_date) FROM obs)""",
)
def latest_day(spark, sf):
    from tallyfold.checks.storage import stored_events

    rows = readers.stored(spark, stored_events(spark, sf))
    return trends.latest_rows(rows, "date").select("run_date", "event_id", "event_type", "value")


@query(
    "latest_delta",
    f"""{HI}, s AS (SELECT run_date, reproducibility_score_mean AS x, lag(reproducibility_score_mean) OVER (ORDER BY run_date) AS p
  FROM snapshots WHERE collection_type = 'daily')
  SELECT {DAY}, x AS latest, coalesce(p, x) AS previous, x - coalesce(p, x) AS delta FROM s
  WHERE run_date = (SELECT max(run_date) FROM s)""",
)
def latest_delta(spark, sf):
    snapshots = B.history(spark, sf)[0]
    return trends.latest_delta(snapshots.where(trends.mode() == "daily"), "reproducibility_score_mean")


@query(
    "adoption_series",
    f"{EV} SELECT {DAY}, library, adoption_pct FROM event_adoption WHERE library IN ('click', 'view', 'purchase')",
)
def adoption_series(spark, sf):
    adoption = daily_adoption(spark, sf)
    return trends.adoption_series(adoption, ("click", "view", "purchase"))


@query(
    "volume_series",
    f"""{HI} SELECT {DAY}, notebooks_collected, notebooks_parsed, 'Daily sample volume' AS title FROM snapshots""",
)
def volume_series(spark, sf):
    return trends.volume_series(B.history(spark, sf)[0])


@query(
    "volume_series_cohort",
    f"""{HI} SELECT {DAY}, notebooks_collected, notebooks_parsed, 'Sample volume by creation-year cohort' AS title
  FROM snapshots WHERE collection_type = 'cohort'""",
)
def volume_series_cohort(spark, sf):
    return trends.volume_series(trends.prefer_mode(B.history(spark, sf)[0], "cohort"))


@query(
    "metric_series",
    f"{HI} " + " UNION ALL ".join(f"SELECT {DAY}, '{s}' AS metric, {s}_mean AS mean FROM snapshots" for s in SCORE_COLUMNS),
)
def metric_series(spark, sf):
    return trends.metric_series(B.history(spark, sf)[0])


@query(
    "structure_series",
    f"{HI} SELECT {DAY}, mean_total_cells, documentation_density_mean * 100 AS doc_density_pct FROM snapshots",
)
def structure_series(spark, sf):
    return trends.structure_series(B.history(spark, sf)[0])


@query(
    "version_share_long",
    f"{_SHARES} SELECT {DAY}, value AS version, pct FROM shares WHERE run_date = (SELECT max(run_date) FROM shares) AND pct <> 0",
)
def version_share_long(spark, sf):
    wide = A.version_columns(A.version_share(B.event_observations(spark, sf)), EVENT_VERSIONS)
    return trends.version_share_long(wide)


_KEYS = ("numpy", "pandas", "scipy", "keras", "plotly")


@query(
    "pivot_year_library",
    f"""{HI} SELECT year(run_date) AS year, {", ".join(f"max(round(adoption_pct, 1)) FILTER (library = '{k}') AS {k}" for k in _KEYS)}
  FROM adoption WHERE collection_type = 'cohort' GROUP BY 1""",
)
def pivot_year_library(spark, sf):
    return trends.pivot_year_library(trends.cohort_years(B.history(spark, sf)[1]), _KEYS)


@query(
    "indicators_by_year",
    f"""{HI}, c AS (SELECT year(run_date) AS year, * FROM snapshots WHERE collection_type = 'cohort')
  {" UNION ALL ".join(f"SELECT year, '{i}' AS indicator, {_three(i)} AS value FROM c WHERE {i} IS NOT NULL" for i in TREND_INDICATORS)}""",
)
def indicators_by_year(spark, sf):
    snapshots = B.history(spark, sf)[0]
    return trends.indicators_by_year(snapshots.where(trends.mode() == "cohort").withColumn("year", F.year("run_date")))


_TREND_SQL = """points AS (SELECT library, year(run_date) AS year, round(adoption_pct, 1) AS pct FROM adoption
    WHERE collection_type = 'cohort'),
ends AS (SELECT library, min(year) AS first_year, arg_min(pct, year) AS first_pct, max(year) AS last_year,
    arg_max(pct, year) AS last_pct, max(pct) AS peak_pct FROM points GROUP BY 1 HAVING count(*) >= 2),
peaks AS (SELECT e.*, (SELECT min(year) FROM points p WHERE p.library = e.library AND p.pct = e.peak_pct) AS peak_year FROM ends e),
told AS (SELECT *, CASE WHEN last_pct > first_pct + 2 THEN 'rose' WHEN last_pct < first_pct - 2 THEN 'fell'
    ELSE 'stayed roughly flat' END AS direction FROM peaks),
summaries AS (SELECT *, library || ' ' || direction || ' from ' || round_even(first_pct, 0)::BIGINT || '% in ' || first_year || ' to '
    || round_even(last_pct, 0)::BIGINT || '% in ' || last_year || ' (peak ' || round_even(peak_pct, 0)::BIGINT || '% in '
    || peak_year || ').' AS summary FROM told)"""


def _yearly(adoption):
    rows = trends.cohort_years(adoption)
    return rows.select("library", "year", F.round("adoption_pct", 1).alias("pct"))


@query("trend_summary", f"{HI}, {_TREND_SQL} SELECT * FROM summaries")
def trend_summary(spark, sf):
    return trends.trend_summary(_yearly(B.history(spark, sf)[1]))


@query(
    "latest_quality",
    f"""{HI}, d AS (SELECT * FROM snapshots WHERE collection_type = 'daily'),
  l AS (SELECT * FROM d WHERE run_date = (SELECT max(run_date) FROM d))
  {" UNION ALL ".join(f"SELECT {DAY}, '{section}' AS section, '{name}' AS name, {_three(column)} AS value FROM l" for section, name, column in _QUALITY)}""",
)
def latest_quality(spark, sf):
    return trends.latest_quality(trends.prefer_mode(B.history(spark, sf)[0], "daily"))


# --- top-k --------------------------------------------------------------------

_TOP = "library, category, adoption_pct, notebook_count"
_LATEST = f"SELECT {_TOP} FROM event_adoption WHERE run_date = (SELECT max(run_date) FROM event_adoption)"


@query("top10_run", f"{EV} {_LATEST} ORDER BY adoption_pct DESC, library LIMIT 10")
def top10_run(spark, sf):
    return ranking.top_libraries(trends.latest_rows(daily_adoption(spark, sf)), 10)


# Parts as technologies of a larger registry: 16 words x 25 brands by line year.
_PART_SQL = """part_days AS (SELECT make_date(year(l_shipdate), 1, 1) AS run_date, p_brand AS library, min(p_type) AS category,
    count(*) AS notebook_count FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
part_adoption AS (SELECT *, round(notebook_count * 100000 / (sum(notebook_count) OVER (PARTITION BY run_date))::DOUBLE) / 1000e0
    AS adoption_pct FROM part_days),
newest AS (SELECT * FROM part_adoption WHERE run_date = (SELECT max(run_date) FROM part_adoption))"""


def newest_part_adoption(spark, sf):
    """Line items of the latest ship year by brand.  Lines are counted per part
    before the join, so a part that holds a third of all lines is one row there."""
    lines = B.table(spark, sf, "lineitem").select(
        F.make_date(F.year("l_shipdate"), F.lit(1), F.lit(1)).alias("run_date"), F.col("l_partkey").alias("p_partkey")
    )
    lines = trends.latest_rows(lines)
    counted = lines.groupBy("run_date", "p_partkey").agg(F.count(F.lit(1)).alias("n"))
    parts = B.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    typed = counted.join(parts, "p_partkey").groupBy("run_date", "p_brand", "p_type").agg(F.sum("n").alias("n"))
    days = typed.groupBy("run_date", F.col("p_brand").alias("library")).agg(
        F.min("p_type").alias("category"), F.sum("n").alias("notebook_count")
    )
    whole = F.sum("notebook_count").over(Window.partitionBy("run_date"))
    return days.withColumn("adoption_pct", ratio(F.col("notebook_count"), whole, 3, 100))


@query("top15_latest", f"WITH {_PART_SQL} SELECT {_TOP} FROM newest ORDER BY adoption_pct DESC, library LIMIT 15")
def top15_latest(spark, sf):
    return ranking.as_bars(ranking.top_libraries(newest_part_adoption(spark, sf), 15))


@query("top20_latest", f"WITH {_PART_SQL} SELECT {_TOP} FROM newest ORDER BY adoption_pct DESC, library LIMIT 20")
def top20_latest(spark, sf):
    return ranking.top_libraries(newest_part_adoption(spark, sf), 20)


@query(
    "top20_context",
    f"""WITH {_PART_SQL} SELECT library, category, adoption_pct, notebook_count,
  row_number() OVER (ORDER BY adoption_pct DESC, library)::INT AS rank FROM newest ORDER BY rank LIMIT 20""",
)
def top20_context(spark, sf):
    top = ranking.top_libraries(newest_part_adoption(spark, sf), 20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("adoption_pct"), "library")))


@query(
    "stat_cards",
    f"""{HI}, d AS (SELECT * FROM snapshots WHERE collection_type = 'daily'),
  a AS (SELECT * FROM adoption WHERE collection_type = 'daily' AND run_date = (SELECT max(run_date) FROM d)
        ORDER BY adoption_pct DESC, library LIMIT 1)
  SELECT strftime(d.run_date, '%Y-%m-%d') AS run_date, (SELECT sum(notebooks_collected) FROM snapshots)::BIGINT AS total_collected,
  notebooks_collected, notebooks_parsed, parse_success_rate, reproducibility_score_mean,
  (SELECT library FROM a) AS top_library, (SELECT adoption_pct FROM a) AS top_pct
  FROM d WHERE d.run_date = (SELECT max(run_date) FROM d)""",
)
def stat_cards(spark, sf):
    snapshots, adoption = B.history(spark, sf)
    return ranking.stat_cards(trends.prefer_mode(snapshots, "daily"), trends.prefer_mode(adoption, "daily"), snapshots)


# --- whole context --------------------------------------------------------------

_FACTS_SQL = f"""{HI}, {_TREND_SQL},
  d AS (SELECT * FROM snapshots WHERE collection_type = 'daily'),
  l AS (SELECT * FROM d WHERE run_date = (SELECT max(run_date) FROM d)),
  c AS (SELECT year(run_date) AS year, * FROM snapshots WHERE collection_type = 'cohort'),
  version_count AS (SELECT run_date, python_major_minor AS value, count(*) AS n FROM obs
    WHERE parse_ok AND python_major_minor IS NOT NULL AND python_major_minor <> '' GROUP BY ALL),
  version AS (SELECT run_date, value, round(n * 10000 / (sum(n) OVER (PARTITION BY run_date))::DOUBLE) / 100e0 AS pct FROM version_count),
  top AS (SELECT * FROM adoption WHERE collection_type = 'daily' AND run_date = (SELECT max(run_date) FROM d)
          ORDER BY adoption_pct DESC, library LIMIT 20)
  SELECT 'daily_census' AS section, 'latest_date' AS subject, NULL::INT AS period, NULL::DOUBLE AS value,
         strftime(run_date, '%Y-%m-%d') AS text FROM l
  UNION ALL SELECT 'daily_census', 'notebooks_collected', NULL, notebooks_collected, NULL FROM l
  UNION ALL SELECT 'daily_census', 'notebooks_parsed', NULL, notebooks_parsed, NULL FROM l
  UNION ALL SELECT 'daily_census', 'n_daily_snapshots', NULL, count(DISTINCT run_date), NULL FROM d
  UNION ALL SELECT 'top_libraries', library, NULL, adoption_pct, category FROM top
  UNION ALL SELECT 'top_library_counts', library, NULL, notebook_count, NULL FROM top
  {" ".join(f"UNION ALL SELECT '{section}', '{name}', NULL, {_three(column)}, NULL FROM l" for section, name, column in _QUALITY)}
  UNION ALL SELECT 'python_version_share_pct', value, NULL, round(pct, 3), NULL FROM version
         WHERE run_date = (SELECT max(run_date) FROM d) AND pct <> 0
  UNION ALL SELECT 'cohorts', 'span', NULL, NULL, min(year) || '-' || max(year) FROM c
  UNION ALL SELECT 'cohorts', 'n_cohorts', NULL, count(DISTINCT run_date), NULL FROM c
  UNION ALL SELECT 'cohorts', 'notebooks_per_cohort', NULL, arg_min(notebooks_collected, run_date), NULL FROM c
  UNION ALL SELECT 'library_adoption_pct_by_creation_year', library, year, pct, NULL FROM points
  UNION ALL SELECT 'library_trend_summaries', library, NULL, NULL, summary FROM summaries
  {" ".join(f"UNION ALL SELECT 'structure_and_quality_by_creation_year', '{i}', year, {_three(i)}, NULL FROM c WHERE {i} IS NOT NULL" for i in TREND_INDICATORS)}"""


@query("trend_facts", _FACTS_SQL, optional=("period",))
def trend_facts(spark, sf):
    from tallyfold.plans.context import trend_facts

    return trend_facts(*B.history(spark, sf), B.versions(spark, sf))


def _one(section: str, subject: str, kind: str = "BIGINT") -> str:
    column = "text" if kind == "VARCHAR" else "value"
    return f"{subject}: (SELECT {column}::{kind} FROM facts WHERE section = '{section}' AND subject = '{subject}')"


def _members(section: str, entry: str = "value", source: str = "facts") -> str:
    rows = f"FROM {source} WHERE section = '{section}'"
    return f"{section}: (SELECT map_from_entries(list({{k: subject, v: {entry}}} ORDER BY subject)) {rows})"


@query(
    "trend_context",
    f"""WITH facts AS MATERIALIZED ({_FACTS_SQL}),
  series AS (SELECT section, subject, map_from_entries(list({{k: period, v: value}} ORDER BY period)) AS points
    FROM facts WHERE period IS NOT NULL GROUP BY ALL),
  ranked AS (SELECT t.subject AS library, t.text AS category, t.value AS adoption_pct, c.value::BIGINT AS notebook_count
    FROM facts t JOIN facts c ON t.section = 'top_libraries' AND c.section = 'top_library_counts' AND t.subject = c.subject)
  SELECT to_json({{daily_census: {{{_one("daily_census", "latest_date", "VARCHAR")},
      {", ".join(_one("daily_census", n) for n in ("notebooks_collected", "notebooks_parsed", "n_daily_snapshots"))},
      top_libraries: (SELECT list({{library: library, category: category, adoption_pct: adoption_pct, notebook_count: notebook_count}}
        ORDER BY adoption_pct DESC, library) FROM ranked),
      {", ".join(_members(n) for n in ("quality_indices_mean", "structure", "python_version_share_pct"))}}},
    cohorts: {{{_one("cohorts", "span", "VARCHAR")}, {_one("cohorts", "n_cohorts")}, {_one("cohorts", "notebooks_per_cohort")},
      {_members("library_adoption_pct_by_creation_year", "points", "series")}, {_members("library_trend_summaries", "text")},
      {_members("structure_and_quality_by_creation_year", "points", "series")}}}}})::VARCHAR AS context""",
)
def trend_context(spark, sf):
    from tallyfold.plans.context import trend_document, trend_facts

    return trend_document(trend_facts(*B.history(spark, sf), B.versions(spark, sf)))


# --- scores on rows of other tables ---------------------------------------------

@query("score_saturating", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_extendedprice <= 0 THEN 0e0 ELSE round(1 - exp(-l_extendedprice / 40000e0), 4) END AS score FROM lineitem")
def score_saturating(spark, sf):
    rows = B.table(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", saturating(F.col("l_extendedprice"), 40000).alias("score"))


@query(
    "score_clip",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(greatest(0::DECIMAL(20,12), least(1::DECIMAL(20,12), (l_quantity / 40 - l_discount)::DECIMAL(20,12))), 4)::DOUBLE AS score
  FROM lineitem""",
)
def score_clip(spark, sf):
    from tallyfold.functions.rounding import as_share, clip01

    rows = B.table(spark, sf, "lineitem")
    value = F.col("l_quantity") / 40 - F.col("l_discount")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", clip01(as_share(value)).alias("score"))
