"""Test tables seen as census inputs.

The test tables hold no notebooks, so landed documents are derived from them by
Spark, row by row: every line of a ``documents`` text becomes a cell, and the
layout, types and damage of the JSON follow from ``source``, ``lang`` and line
length.  The same rules are stated in SQL in ``notebook_sql`` for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.fixed_values import EXTENSION_LABELS, MODULE_TO_LIBRARY, SCORE_COLUMNS, WIDGET_MIME
from tallyfold.operators import aggregate as A
from tallyfold.session import configure, scratch_folder
from tallyfold.sources import readers, sinks

MODULES = tuple(MODULE_TO_LIBRARY)
# Import names per line: the registry modules and three unknown ones.
MODULE_NAMES = MODULES + tuple(f"local_{i}" for i in range(3))
EXTENSION_KEYS = tuple(key for key, _ in EXTENSION_LABELS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _names_array() -> str:
    return "array(" + ",".join(f"'{m}'" for m in MODULE_NAMES) + ")"


def _quoted(text: str) -> str:
    """SQL expression for a string as a JSON string literal."""
    for raw, escaped in ((r"\\", r"\\\\"), ('"', r"\\\""), (r"\n", r"\\n"), (r"\t", r"\\t"), (r"\r", r"\\r")):
        text = f"replace({text}, '{raw}', '{escaped}')"
    return f"""concat('"', {text}, '"')"""


# Line rules: c.s = line text, c.i = 0-based line number, c.h = cell shape,
# k = layout number of the document.
_SHAPE = "CASE WHEN k = 8 THEN 0 WHEN k = 9 THEN 4 ELSE (length(s) + i) % 10 END"


def _module(shift: int) -> str:
    return f"element_at(module_names, (length(c.s) + {shift}) % size(module_names) + 1)"


_CODE = rf"""CASE WHEN c.s = '' THEN ''
  WHEN c.h = 9 THEN concat('import ', {_module(0)})
  WHEN c.h = 2 THEN concat('print 1\nimport ', {_module(0)}, ', ', {_module(1)}, '\n# ', c.s)
  WHEN c.h = 3 THEN concat('\"\"\"\nimport ', {_module(0)}, '\n\"\"\"\nfrom . import util\n# ', c.s)
  ELSE concat('import ', {_module(0)}, ', ', {_module(1)}, ' as z\n%time x\nfrom ', {_module(2)},
              '.core import y\n# ', c.s) END"""
_COUNT = """CASE WHEN k = 8 THEN cast(c.i + 1 AS string) ELSE CASE length(c.s) % 9
  WHEN 0 THEN 'null' WHEN 1 THEN 'true' WHEN 2 THEN '"3"' WHEN 3 THEN '4.7' WHEN 4 THEN '"4.7"'
  ELSE cast(length(c.s) % 50 AS string) END END"""
_OUTPUTS = f"""CASE length(c.s) % 7 WHEN 0 THEN 'null' WHEN 1 THEN '[]'
  WHEN 2 THEN concat('[{{"output_type":"stream","text":', {_quoted("c.s")}, '}}]')
  WHEN 3 THEN concat('[{{"output_type":"display_data","data":{{"image/png":"AAAA","text/plain":',
                     {_quoted("c.s")}, '}}}},7]')
  WHEN 4 THEN concat('[{{"output_type":"execute_result","data":{{"text/html":', {_quoted("c.s")},
                     ',"image/svg+xml":"x"}}}},{{"output_type":"error","ename":"E"}}]')
  WHEN 5 THEN '[{{"output_type":"display_data","data":{{"{WIDGET_MIME}":{{"model_id":"m"}}}}}}]'
  ELSE '"oops"' END"""
_TAGS = """CASE c.h WHEN 0 THEN concat('{"tags":["', lang, '",', length(c.s) % 3, ',true]}')
  WHEN 1 THEN '{"tags":"x"}' ELSE '{}' END"""
_CELL = rf"""CASE WHEN c.h = 8 THEN cast(length(c.s) AS string)
  WHEN c.h < 4 THEN concat('{{"cell_type":"code","metadata":', {_TAGS}, ',"execution_count":', {_COUNT},
       ',"outputs":', {_OUTPUTS}, ',"source":', {_quoted(_CODE)}, '}}')
  WHEN c.h = 9 THEN concat('{{"cell_type":"code","execution_count":', {_COUNT}, ',"input":', {_quoted(_CODE)}, '}}')
  WHEN c.h = 4 THEN concat('{{"cell_type":"markdown","metadata":null,"source":["## h\\n",', {_quoted("c.s")}, ']}}')
  WHEN c.h = 5 THEN concat('{{"cell_type":"markdown","source":[', {_quoted("c.s")}, ',"\\n","\\n"]}}')
  WHEN c.h = 6 THEN concat('{{"cell_type":"markdown","source":', {_quoted("c.s")}, '}}')
  ELSE concat('{{"cell_type":"raw","source":', {_quoted("c.s")}, '}}') END"""
_META = """concat('{"kernelspec":{"name":"', CASE lang WHEN 'es' THEN ' ' ELSE 'python3' END,
  '","display_name":"Kernel ', lang, '"', CASE lang WHEN 'en' THEN ',"language":"python"' ELSE '' END,
  '},"language_info":{"name":"', lang, '-lang"', CASE lang
     WHEN 'en' THEN concat(',"version":"3.', n_chars % 13, '.', n_chars % 5, '"')
     WHEN 'fr' THEN concat(',"version":"v20.', n_chars % 3, '"')
     WHEN 'de' THEN ',"version":"1"' ELSE '' END, '}',
  CASE lang WHEN 'fr' THEN ',"widgets":{"state":{}}' WHEN 'de' THEN ',"widgets":{}' ELSE '' END,
  CASE WHEN k BETWEEN 10 AND 18 AND lang NOT IN ('fr', 'de')
       THEN concat(',"', element_at(extension_keys, k - 9), '":{"on":true}') ELSE '' END, '}')"""
_RAW = """CASE k
  WHEN 0 THEN concat('{"nbformat":4,"cells":[', body)
  WHEN 1 THEN concat('[{"nbformat":4,"cells":[', body, ']}]')
  WHEN 2 THEN ''
  WHEN 3 THEN concat('{"nbformat":3,"metadata":', meta, ',"worksheets":[{"cells":[', body, ']},{}]}')
  WHEN 4 THEN concat('{"nbformat":"4","metadata":', meta, ',"cells":{"a":[', body, ']}}')
  WHEN 5 THEN concat('{"nbformat":3,"nbformat":4,"metadata":', meta, ',"cells":[', body, ']}')
  WHEN 6 THEN concat('{"nbformat":4,"metadata":"x","cells":[', body, ']}')
  WHEN 7 THEN concat('{"nbformat":true,"nbformat_minor":4.7,"metadata":', meta, ',"cells":[', body, ']}')
  ELSE concat('{"nbformat":4,"nbformat_minor":', n_chars % 6, ',"metadata":', meta, ',"cells":[', body, ']}') END"""


def many_files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table stored once more in as many files as there are shuffle
    partitions: the test tables hold one file of one row group each."""

    def write(path: str) -> None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        table(spark, sf_dir, name).repartition(parts).write.parquet(path)

    path = stored_once(spark, sf_dir, name, write)
    return spark.read.schema(table(spark, sf_dir, name).schema).parquet(path)


def landed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as landed JSON documents with their provenance."""
    docs = many_files(spark, sf_dir, "documents").withColumns(
        {
            "k": F.expr("cast(substr(source, 4) AS int)"),
            "module_names": F.expr(_names_array()),
            "extension_keys": F.array(*[F.lit(k) for k in EXTENSION_KEYS]),
        }
    )
    lines = docs.withColumn("lines", F.expr(f"transform(split(text, '\\n', -1), (s, i) -> struct(s, i, {_SHAPE} AS h))"))
    staged = lines.withColumns({"body": F.expr(f"array_join(transform(lines, c -> {_CELL}), ',')"), "meta": F.expr(_META)})
    return staged.select(
        F.expr("date_add(DATE'2024-01-01', cast(n_chars % 30 AS int))").alias("run_date"),
        F.lit("daily").alias("collection_type"),
        F.col("source").alias("repo_full_name"),
        F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".ipynb")).alias("path"),
        F.lit("main").alias("ref"),
        F.col("n_chars").alias("size_bytes"),
        F.expr(_RAW).alias("raw"),
        (F.col("k") * 100).alias("repo_stars"),
        (F.col("k") * 1000).alias("repo_size_kb"),
        F.concat(F.lit(2010) + F.col("k"), F.lit("-01-01")).alias("repo_created_at"),
        F.lit("2024-01-01").alias("repo_pushed_at"),
        F.concat(F.lit("lang_"), F.col("lang")).alias("strategy"),
        F.concat(F.lit("lang:"), F.col("lang")).alias("stratum"),
    )


# --- events as observations ---------------------------------------------------

EVENT_CATEGORIES = {
    "click": "engage",
    "view": "engage",
    "purchase": "commerce",
    "signup": "commerce",
    "error": "fault",
}


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as observations: the day is the run date, the user the
    repository, the event type the technology seen; errors are failed parses."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.to_date("ts").alias("run_date"),
        F.lit(None).cast("string").alias("collection_type"),
        F.concat(F.lit("user/"), F.col("user_id")).alias("repo_full_name"),
        F.concat(F.lit("hour:"), F.hour("ts")).alias("stratum"),
        F.col("event_type"),
        (F.col("event_type") != "error").alias("parse_ok"),
        F.col("value"),
        F.round(F.col("value") / 500, 4).alias("score"),
        k.alias("k"),
    )
    rows = rows.withColumns(
        {
            "nbformat": F.when(F.col("k") < 90, 3 + F.col("k") % 2),
            "python_major_minor": F.when(F.col("k") < 80, F.concat(F.lit("3."), F.col("k") % 14)),
        }
    )
    return rows.withColumns({f"lib_{e}": F.col("event_type") == e for e in EVENT_CATEGORIES})


EVENTS_SQL = """obs AS (
  SELECT event_id, CAST(ts AS DATE) AS run_date, 'user/' || user_id AS repo_full_name,
    'hour:' || hour(ts) AS stratum, event_type, event_type <> 'error' AS parse_ok, value,
    round(value / 500, 4) AS score, k,
    CASE WHEN k < 90 THEN 3 + k % 2 END AS nbformat,
    CASE WHEN k < 80 THEN '3.' || (k % 14) END AS python_major_minor
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)),
event_library(library, category) AS (VALUES ('click','engage'),('view','engage'),('purchase','commerce'),
  ('signup','commerce'),('error','fault')),
event_days AS (SELECT run_date, count(*) AS collected, count(*) FILTER (parse_ok) AS parsed FROM obs GROUP BY 1),
event_adoption AS (
  SELECT d.run_date, 'daily' AS collection_type, l.library, l.category, coalesce(n, 0)::BIGINT AS notebook_count,
    CASE WHEN parsed > 0 THEN round(coalesce(n, 0) * 100000 / parsed::DOUBLE) / 1000e0 ELSE 0e0 END AS adoption_pct
  FROM event_days d CROSS JOIN event_library l
  LEFT JOIN (SELECT run_date, event_type AS library, count(*) FILTER (parse_ok) AS n FROM obs GROUP BY ALL) c
    ON c.run_date = d.run_date AND c.library = l.library)"""


# --- history: daily rows from events, cohort rows from orders -------------------

PRIORITY_LIBRARIES = {
    "1-URGENT": ("numpy", "array"),
    "2-HIGH": ("pandas", "array"),
    "3-MEDIUM": ("scipy", "scientific"),
    "4-NOT SPECIFIED": ("keras", "deep_learning"),
    "5-LOW": ("plotly", "plotting"),
}


def cohort_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as cohort observations: the order year is the creation year,
    the priority the technology seen, the price the score."""
    orders = table(spark, sf_dir, "orders").select(
        F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("run_date"),
        F.lit("cohort").alias("collection_type"),
        (F.col("o_orderstatus") != "P").alias("parse_ok"),
        (F.floor(F.col("o_totalprice") / 100) / 10000).alias("score"),
        (F.col("o_custkey") % 40 + 1).alias("total_cells"),
        F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("3."), F.col("o_custkey") % 14)).alias("python_major_minor"),
        F.when(F.col("o_custkey") % 9 > 0, 3 + F.col("o_custkey") % 2).alias("nbformat"),
        F.col("o_orderpriority").alias("priority"),
    )
    return orders.withColumns({f"lib_{lib}": F.col("priority") == p for p, (lib, _) in PRIORITY_LIBRARIES.items()})


COHORT_SQL = """cohort_obs AS (
  SELECT make_date(year(o_orderdate), 1, 1) AS run_date, o_orderstatus <> 'P' AS parse_ok,
    floor(o_totalprice / 100) / 10000 AS score, o_custkey % 40 + 1 AS total_cells, l.library, l.category,
    CASE WHEN o_custkey % 5 > 0 THEN '3.' || o_custkey % 14 END AS python_major_minor, CASE WHEN o_custkey % 9 > 0 THEN 3 + o_custkey % 2 END AS nbformat
  FROM orders JOIN (VALUES ('1-URGENT','numpy','array'),('2-HIGH','pandas','array'),('3-MEDIUM','scipy','scientific'),
    ('4-NOT SPECIFIED','keras','deep_learning'),('5-LOW','plotly','plotting')) l(priority, library, category)
    ON l.priority = o_orderpriority),
cohort_days AS (SELECT run_date, count(*) FILTER (parse_ok) AS parsed FROM cohort_obs GROUP BY 1),
cohort_adoption AS (
  SELECT d.run_date, 'cohort' AS collection_type, l.library, l.category, coalesce(n, 0)::BIGINT AS notebook_count,
    CASE WHEN parsed > 0 THEN round(coalesce(n, 0) * 100000 / parsed::DOUBLE) / 1000e0 ELSE 0e0 END AS adoption_pct
  FROM cohort_days d CROSS JOIN (SELECT DISTINCT library, category FROM cohort_obs) l
  LEFT JOIN (SELECT run_date, library, count(*) FILTER (parse_ok) AS n FROM cohort_obs GROUP BY ALL) c
    ON c.run_date = d.run_date AND c.library = l.library)"""


# Whole-number and boolean columns of a history row, by its number of cells.
_CELL_COLUMNS = {"code_cells": 7, "markdown_cells": 5, "import_count": 4, "total_outputs": 6}
_CELL_FLAGS = {"has_any_output": 2, "fully_executed_in_order": 3, "has_widget_state": 11}


def _history_rows(rows: DataFrame) -> DataFrame:
    """Snapshots with all score, structure, share, version and format columns; the i-th score is i times the row's, modulo 1.0001."""
    cells, units = F.col("total_cells"), F.round(F.col("score") * 10000).cast("bigint")
    derived = {s: (units * (i + 1)) % 10001 / 10000 for i, s in enumerate(SCORE_COLUMNS)}
    derived |= {"total_lines": cells * 3} | {c: cells % m for c, m in _CELL_COLUMNS.items()} | {c: cells % m == 0 for c, m in _CELL_FLAGS.items()}
    return A.measured_days(rows.withColumns(derived))


def history_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Snapshot and adoption history: daily rows and cohort rows together."""
    daily = event_observations(spark, sf_dir).withColumn("total_cells", F.col("k"))
    cohorts = cohort_observations(spark, sf_dir)
    snapshots = _history_rows(daily).unionByName(_history_rows(cohorts))
    adoption = A.library_adoption(daily, EVENT_CATEGORIES).unionByName(
        A.library_adoption(cohorts, dict(PRIORITY_LIBRARIES.values()))
    )
    return snapshots, adoption


_STORED: dict[tuple[str, str, str], str] = {}


def stored_once(spark: SparkSession, sf_dir: str, label: str, write) -> str:
    """A shared folder that is written once per application and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _STORED:
        path = scratch_folder(spark, label)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored version shares of the daily history."""
    path = stored_once(spark, sf_dir, "versions", lambda p: sinks.write_dates(A.version_share(event_observations(spark, sf_dir)), p))
    return readers.stored(spark, path).drop("date")


def history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The history as history queries meet it: two stored tables of one row per
    date and per date and library, so the facts are aggregated once."""
    configure(spark)

    def write(root: str) -> None:
        snapshots, adoption = history_tables(spark, sf_dir)
        sinks.write_dates(snapshots, f"{root}/daily_snapshots")
        sinks.write_dates(adoption, f"{root}/library_adoption")

    root = stored_once(spark, sf_dir, "history", write)
    snapshots, adoption = (readers.stored(spark, f"{root}/{t}") for t in ("daily_snapshots", "library_adoption"))
    return snapshots.drop("date"), adoption.drop("date")


def _mean_sql(value: str, units: int, name: str, factor: int) -> str:
    return f"round(sum({factor} * ({value})) FILTER (parse_ok)::DOUBLE / nullif(count({value}) FILTER (parse_ok), 0)) / {units}e0 AS {name}"


def _share_sql(condition: str, among: str, name: str) -> str:
    return f"round(count(*) FILTER ({among} AND {condition}) * 10000 / nullif(count(*) FILTER ({among}), 0)::DOUBLE) / 10000e0 AS {name}"


def _history_sql(source: str, mode: str) -> str:
    scores = {s: f"round(score * 10000)::BIGINT * {i + 1} % 10001" for i, s in enumerate(SCORE_COLUMNS)}
    whole = {"total_cells": "total_cells", "total_lines": "total_cells * 3"} | {c: f"total_cells % {m}" for c, m in _CELL_COLUMNS.items()}
    columns = [_mean_sql(x, 10000, f"{s}_mean", 1) for s, x in scores.items()]
    columns += [f"round(median({x}) FILTER (parse_ok)) / 10000e0 AS {s}_median" for s, x in scores.items()]
    columns += [_mean_sql(whole[c], 1000, name, 1000) for name, c in A.MEANS.items()]
    columns += ["median(total_cells) FILTER (parse_ok) AS median_total_cells"]
    columns += [_share_sql(f"total_cells % {_CELL_FLAGS[c]} = 0", "parse_ok", name) for name, c in A.SHARES.items()]
    columns += [_share_sql("python_major_minor <> ''", "parse_ok", "pct_with_python_version")]
    columns += [_mean_sql("nbformat", 1000, "mean_nbformat", 1000), _share_sql("nbformat = 4", "parse_ok AND nbformat IS NOT NULL", "pct_nbformat_4")]
    return f"""SELECT run_date, '{mode}' AS collection_type, count(*) AS notebooks_collected,
    count(*) FILTER (parse_ok) AS notebooks_parsed,
    round(count(*) FILTER (parse_ok) * 10000 / count(*)::DOUBLE) / 10000e0 AS parse_success_rate,
    {", ".join(columns)}
  FROM {source} GROUP BY 1"""


HISTORY_SQL = f"""{EVENTS_SQL}, {COHORT_SQL},
snapshots AS ({_history_sql("(SELECT *, k AS total_cells FROM obs)", "daily")}
  UNION ALL BY NAME {_history_sql("cohort_obs", "cohort")}),
adoption AS (SELECT * FROM event_adoption UNION ALL BY NAME SELECT * FROM cohort_adoption)"""
