"""Document parsing, imports, detection, scores and the census over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.checks import bindings as B
from tallyfold.checks import notebook_sql as N
from tallyfold.checks.aggregation import share_sql
from tallyfold.checks.registry import query
from tallyfold.fixed_values import SCORE_COLUMNS
from tallyfold.functions import scores as S
from tallyfold.functions import text as T
from tallyfold.functions import variant as V
from tallyfold.operators import aggregate as A
from tallyfold.operators import detect
from tallyfold.operators import parse as P
from tallyfold.operators.imports import ast_imports
from tallyfold.operators.observe import observe

ALL = N.ALL_SQL


def _features(columns: str) -> str:
    return f"{ALL} SELECT {N.PATH_SQL}, {columns} FROM scored"


def read(spark, sf):
    return P.read_json(B.landed_documents(spark, sf))


def described(spark, sf, *columns):
    return P.with_metadata(read(spark, sf)).select("path", *columns)


def with_text(spark, sf):
    return P.with_typed_cells(read(spark, sf).drop("raw"))


def celled(spark, sf):
    return P.with_cells(P.with_metadata(read(spark, sf)).drop("raw"))


def tallied(spark, sf, *columns):
    return P.with_tallies(celled(spark, sf)).select("path", *columns)


def cell_rows(cells, *fields):
    """One row per cell.  The outer form keeps Spark from inferring a filter on
    ``cells`` below the parse, which would read every document twice."""
    rows = cells.select("path", F.posexplode_outer("cells").alias("pos", "cell"))
    return rows.where(F.col("pos").isNotNull()).select("path", "pos", *[F.col(f"cell.{f}").alias(f) for f in fields])


# --- parsing ----------------------------------------------------------------------

@query("parse_status", _features("parse_ok, parse_error"))
def parse_status(spark, sf):
    return read(spark, sf).select("path", "parse_ok", "parse_error")


@query(
    "parse_status_props",
    """SELECT event_id, event_type <> 'error' AND event_type <> 'view' AS parse_ok,
  CASE event_type WHEN 'error' THEN 'json: invalid document' WHEN 'view' THEN 'top-level value is not an object' END AS parse_error FROM events""",
)
def parse_status_props(spark, sf):
    damaged = (
        F.when(F.col("event_type") == "error", F.expr("substr(props, 1, length(props) - 1)"))
        .when(F.col("event_type") == "view", F.concat(F.lit("["), F.col("props"), F.lit("]")))
        .otherwise(F.col("props"))
    )
    rows = B.table(spark, sf, "events").select("event_id", damaged.alias("raw"))
    return P.read_json(rows).select("event_id", "parse_ok", "parse_error")


_VALUES_SQL = """CASE event_type WHEN 'click' THEN {click} WHEN 'view' THEN {view} WHEN 'purchase' THEN {purchase}
  WHEN 'signup' THEN {signup} ELSE {error} END"""


def _json_values(spark, sf):
    """One JSON value per event: number, decimal, quoted number, blank, boolean."""
    value = (
        F.when(F.col("event_type") == "click", F.get_json_object("props", "$.k"))
        .when(F.col("event_type") == "view", F.col("value").cast("decimal(12,2)").cast("string"))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('" '), F.get_json_object("props", "$.k"), F.lit(' "')))
        .when(F.col("event_type") == "signup", F.lit('"  "'))
        .otherwise(F.lit("true"))
    )
    return B.table(spark, sf, "events").select("event_id", F.parse_json(value).alias("v"))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(
    "lenient_int",
    f"SELECT event_id, {_VALUES_SQL.format(click=_K, view='trunc(value)::BIGINT', purchase=_K, signup='NULL', error='NULL')} AS n FROM events",
    optional=("n",),
)
def lenient_int(spark, sf):
    return _json_values(spark, sf).select("event_id", V.lenient_int(F.col("v")).alias("n"))


@query(
    "lenient_str",
    "SELECT event_id, CASE WHEN event_type = 'purchase' THEN ' ' || json_extract_string(props, '$.k') || ' ' END AS s FROM events",
)
def lenient_str(spark, sf):
    return _json_values(spark, sf).select("event_id", V.lenient_str(F.col("v")).alias("s"))


_FORMAT = ("nbformat", "nbformat_minor")


@query("nb_format", _features("nbformat, nbformat_minor"), optional=_FORMAT)
def nb_format(spark, sf):
    return described(spark, sf, "nbformat", "nbformat_minor")


@query("nb_kernel", _features("kernel_name, kernel_display_name, language, language_version"))
def nb_kernel(spark, sf):
    return described(spark, sf, "kernel_name", "kernel_display_name", "language", "language_version")


@query("version_extract", _features("python_version, python_major_minor"))
def version_extract(spark, sf):
    return described(spark, sf, "python_version", "python_major_minor")


@query("nb_widget_state", _features("has_widget_state"))
def nb_widget_state(spark, sf):
    return described(spark, sf, "has_widget_state")


@query("custom_meta", _features("has_custom_metadata"))
def custom_meta(spark, sf):
    return described(spark, sf, "has_custom_metadata")


@query("extension_hints", _features("extension_hints"))
def extension_hints(spark, sf):
    return described(spark, sf, "extension_hints")


def _cells(columns: str, where: str = "true") -> str:
    return f"{ALL} SELECT {N.PATH_SQL}, i AS pos, {columns} FROM measured WHERE {where}"


@query("resolve_cells", _cells("kind <> 'scalar' AS is_object, nullif(kind, 'scalar') AS kind"))
def resolve_cells(spark, sf):
    return cell_rows(with_text(spark, sf), "is_object", "kind")


@query("cell_text", _cells("text"))
def cell_text(spark, sf):
    return cell_rows(with_text(spark, sf), "text")


@query("cell_line_counts", _cells("lines, length(text) AS chars"))
def cell_line_counts(spark, sf):
    return cell_rows(celled(spark, sf), "lines", "chars")


@query("distinct_tags", _features("distinct_cell_tags, cell_tag_count, has_any_output"))
def distinct_tags(spark, sf):
    return tallied(spark, sf, "distinct_cell_tags", "cell_tag_count", "has_any_output")


@query("output_tallies", _features("cells_with_output, total_outputs, stream_outputs, error_outputs"))
def output_tallies(spark, sf):
    return tallied(spark, sf, "cells_with_output", "total_outputs", "stream_outputs", "error_outputs")


@query("mime_tallies", _features("image_outputs, html_outputs, widget_output_count"))
def mime_tallies(spark, sf):
    return tallied(spark, sf, "image_outputs", "html_outputs", "widget_output_count")


@query("largest_payload", _features("largest_output_bytes"))
def largest_payload(spark, sf):
    return tallied(spark, sf, "largest_output_bytes")


@query(
    "payload_length_pages",
    r"""SELECT page_id, length('{"output_type": "display_data", "data": {"text/html": }}') + 2 + length(html)
  + length(html) - length(translate(html, chr(34) || chr(92) || chr(9) || chr(10) || chr(13), ''))
  + 5 * length(regexp_replace(html, '[\x00-\x7E]', '', 'g')) + 6 * length(regexp_replace(html, '[^\x{10000}-\x{10FFFF}]', '', 'g'))
  AS output_length FROM pages""",
)
def payload_length_pages(spark, sf):
    output = F.to_json(
        F.struct(F.lit("display_data").alias("output_type"), F.struct(F.col("html").alias("text/html")).alias("data"))
    )
    rows = B.table(spark, sf, "pages").select("page_id", F.to_json(F.parse_json(output)).alias("json"))
    return rows.select("page_id", T.dumped_length(F.col("json")).alias("output_length"))


_LISTS = ("distinct_cell_tags", "extension_hints", "imports")


@query("flatten_lists", _features(", ".join(_LISTS)))
def flatten_lists(spark, sf):
    return P.flat_row(P.parse_documents(B.landed_documents(spark, sf))).select("path", *_LISTS)


@query("document_features", _features(", ".join(P.FEATURE_COLUMNS)), optional=_FORMAT)
def document_features(spark, sf):
    return P.parse_documents(B.landed_documents(spark, sf)).select("path", *P.FEATURE_COLUMNS)


# --- imports ----------------------------------------------------------------------

def _code(spark, sf):
    rows = cell_rows(with_text(spark, sf), "kind", "text")
    return rows.where(F.col("kind") == "code").select("path", "pos", "text")


def _code_cells(columns: str) -> str:
    return _cells(columns, "kind = 'code'")


@query("strip_magics", _code_cells("replace(text, chr(10) || '%time x' || chr(10), chr(10) || chr(10)) AS source"))
def strip_magics(spark, sf):
    return _code(spark, sf).select("path", "pos", T.strip_magics(F.col("text")).alias("source"))


@query(
    "imports_ast",
    _code_cells(
        """s = '' OR h <> 2 AS valid, CASE WHEN s = '' OR h IN (2, 3) THEN '' ELSE
  (SELECT string_agg(DISTINCT m, ';' ORDER BY m) FROM (SELECT unnest(modules) AS m)) END AS names"""
    ),
)
def imports_ast(spark, sf):
    source = F.array(T.strip_magics(F.col("text")))
    rows = _code(spark, sf).withColumn("names", F.element_at(ast_imports(source), 1))
    return rows.select("path", "pos", F.col("names").isNotNull().alias("valid"), T.joined(F.coalesce("names", F.array().cast("array<string>"))).alias("names"))


@query(
    "imports_regex",
    _code_cells(
        """CASE WHEN s = '' THEN '' WHEN h < 2 THEN (SELECT string_agg(DISTINCT m, ';' ORDER BY m)
  FROM (SELECT unnest([modules[1], modules[3]]) AS m)) ELSE modules[1] END AS names"""
    ),
)
def imports_regex(spark, sf):
    return _code(spark, sf).select("path", "pos", T.joined(T.regex_imports(F.col("text"))).alias("names"))


@query("imports_union", _features("imports, import_count"))
def imports_union(spark, sf):
    return P.parse_documents(B.landed_documents(spark, sf)).select("path", "imports", "import_count")


@query(
    "top_level",
    """SELECT page_id, split_part(regexp_replace(regexp_replace(url, '^https?://', ''), '/.*$', ''), '.', 1) AS top_level FROM pages""",
)
def top_level(spark, sf):
    host = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "/.*$", "")
    return B.table(spark, sf, "pages").select("page_id", T.top_level(host).alias("top_level"))


# --- detection --------------------------------------------------------------------

def detected(spark, sf):
    return detect.with_detection(P.parse_documents(B.landed_documents(spark, sf)))


@query("detect_libraries", _features("detected_libraries AS libraries"))
def detect_libraries(spark, sf):
    return detected(spark, sf).select("path", "libraries")


@query("detect_categories", _features("detected_categories AS categories"))
def detect_categories(spark, sf):
    return detected(spark, sf).select("path", "categories")


@query("detect_summary", _features("detected_libraries, detected_categories, detected_library_count"))
def detect_summary(spark, sf):
    return detected(spark, sf).select(
        "path", *[c.alias(name) for name, c in detect.summary_columns().items()]
    )


@query("wide_flags", _features(N.FLAGS_SQL))
def wide_flags(spark, sf):
    return detected(spark, sf).select("path", *[c.alias(name) for name, c in detect.wide_flags(F.col("libraries")).items()])


_WORDS = "regexp_extract_all(lower({0}), '\\p{{L}}+')"


_TOKENS_SQL = f"""WITH entries AS (SELECT DISTINCT word AS module, min(item_id) OVER (PARTITION BY word) AS first_item
    FROM (SELECT item_id, unnest({_WORDS.format('text')}) AS word FROM benchmark)),
  registry AS (SELECT module, 'item-' || first_item AS library, 'len-' || length(module) AS category FROM entries),
  seen AS (SELECT DISTINCT doc_id, unnest({_WORDS.format('text')}) AS module FROM documents)
  SELECT doc_id, string_agg(DISTINCT library, ';' ORDER BY library) AS libraries,
    string_agg(DISTINCT category, ';' ORDER BY category) AS categories FROM seen JOIN registry USING (module) GROUP BY 1"""


def _document_words(spark, sf):
    """Words of whole documents, and a registry made of the benchmark words."""

    def words(name, key):
        found = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
        rows = B.many_files(spark, sf, name).select(key, "text")
        return rows.select(key, detect.module_list(found).alias("module"))

    first = words("benchmark", "item_id").groupBy("module").agg(F.min("item_id").alias("item"))
    registry = first.select(
        "module",
        F.concat(F.lit("item-"), F.col("item")).alias("library"),
        F.concat(F.lit("len-"), F.length("module")).alias("category"),
    )
    return words("documents", "doc_id"), registry


@query("detect_tokens", _TOKENS_SQL)
def detect_tokens(spark, sf):
    return detect.detect_by_join(*_document_words(spark, sf), "doc_id")


@query("detect_tokens_hot", _TOKENS_SQL)
def detect_tokens_hot(spark, sf):
    """The same with the modules of a thousandth of all rows or more dealt over salts, as for a large registry."""
    modules, registry = _document_words(spark, sf)
    return detect.detect_by_join(modules, registry, "doc_id", detect.hot_modules(modules, 1 / 1000))


# --- scores on documents ------------------------------------------------------------

def _score(name, columns):
    @query(name, _features(", ".join(columns)))
    def build(spark, sf):
        return S.with_scores(detected(spark, sf), *columns).select("path", *columns)

    return build


score_visual = _score("score_visual", ("visualization_density",))
score_interactive = _score("score_interactive", ("interactive_widget_score",))
score_scientific = _score("score_scientific", ("scientific_computing_score",))
score_ml = _score("score_ml", ("ml_usage_score",))
score_vector = _score("score_vector", SCORE_COLUMNS)


# --- observations and the census -----------------------------------------------------

_DATE = "strftime(DATE '2024-01-01' + (n_chars % 30)::INT, '%Y-%m-%d') AS run_date"
_PROVENANCE = f"""{_DATE}, 'daily' AS collection_type, source AS repo_full_name, {N.PATH_SQL}, 'main' AS ref, n_chars AS size_bytes,
  k * 100 AS repo_stars, k * 1000 AS repo_size_kb, (2010 + k) || '-01-01' AS repo_created_at, '2024-01-01' AS repo_pushed_at,
  'lang_' || lang AS strategy, 'lang:' || lang AS stratum"""


@query(
    "observation_rows",
    f"""{ALL} SELECT {_PROVENANCE}, {", ".join(P.FEATURE_COLUMNS)}, {", ".join(SCORE_COLUMNS)}, {N.FLAGS_SQL},
  detected_libraries, detected_categories, detected_library_count FROM scored""",
    optional=_FORMAT,
)
def observation_rows(spark, sf):
    return observe(B.landed_documents(spark, sf))


_DAY = "DATE '2024-01-01' + (n_chars % 30)::INT"


def _mean_sql(column: str, held: int, places: int, name: str) -> str:
    units = f"round({column} * {10**held})::BIGINT"
    return f"""round((sum({units}) FILTER (parse_ok) * {10 ** (places - held)})::DOUBLE
      / nullif(count({column}) FILTER (parse_ok), 0)) / {10**places}e0 AS {name}"""


_MEANS = {
    "mean_total_cells": "total_cells", "mean_code_cells": "code_cells", "mean_markdown_cells": "markdown_cells",
    "mean_total_lines": "total_lines", "mean_imports": "import_count", "mean_outputs": "total_outputs",
}
_SNAPSHOT_SQL = f"""{ALL} SELECT {_DATE}, 'daily' AS collection_type, count(*) AS notebooks_collected,
  count(*) FILTER (parse_ok) AS notebooks_parsed, {share_sql("count(*) FILTER (parse_ok)", "count(*)", 4)} AS parse_success_rate,
  {", ".join(_mean_sql(c, 4, 4, f"{c}_mean") for c in SCORE_COLUMNS)},
  {", ".join(f"round(median(round({c} * 10000)::BIGINT) FILTER (parse_ok)) / 10000e0 AS {c}_median" for c in SCORE_COLUMNS)},
  {", ".join(_mean_sql(c, 0, 3, name) for name, c in _MEANS.items())},
  median(total_cells) FILTER (parse_ok) AS median_total_cells,
  {share_sql("count(*) FILTER (parse_ok AND has_any_output)", "count(*) FILTER (parse_ok)", 4)} AS pct_with_output,
  {share_sql("count(*) FILTER (parse_ok AND fully_executed_in_order)", "count(*) FILTER (parse_ok)", 4)} AS pct_executed_in_order,
  {share_sql("count(*) FILTER (parse_ok AND has_widget_state)", "count(*) FILTER (parse_ok)", 4)} AS pct_with_widgets,
  {share_sql("count(*) FILTER (parse_ok AND python_major_minor <> '')", "count(*) FILTER (parse_ok)", 4)} AS pct_with_python_version,
  {_mean_sql("nbformat", 0, 3, "mean_nbformat")},
  {share_sql("count(*) FILTER (parse_ok AND nbformat = 4)", "count(nbformat) FILTER (parse_ok)", 4)} AS pct_nbformat_4,
  count(DISTINCT source) AS repos_contributing, count(DISTINCT lang) AS strata_sampled
  FROM scored GROUP BY run_date"""


@query("census_snapshot", _SNAPSHOT_SQL)
def census_snapshot(spark, sf):
    return A.daily_snapshot(observe(B.landed_documents(spark, sf)))


@query(
    "census_adoption",
    f"""{ALL}, days AS (SELECT {_DATE}, count(*) FILTER (parse_ok) AS parsed FROM scored GROUP BY run_date),
  counts AS (SELECT {_DATE}, library, count(*) AS n FROM scored JOIN (SELECT DISTINCT doc_id, library FROM found) USING (doc_id)
    WHERE parse_ok GROUP BY run_date, library),
  known AS (SELECT DISTINCT library, category FROM registry)
  SELECT d.run_date, 'daily' AS collection_type, r.library, r.category, coalesce(n, 0)::BIGINT AS notebook_count,
    coalesce({share_sql("coalesce(n, 0)", "parsed", 3, 100)}, 0e0) AS adoption_pct
  FROM days d CROSS JOIN known r LEFT JOIN counts c ON c.run_date = d.run_date AND c.library = r.library""",
)
def census_adoption(spark, sf):
    return A.library_adoption(observe(B.landed_documents(spark, sf)))


@query(
    "census_version_share",
    f"""{ALL}, counted AS (SELECT {_DATE}, python_major_minor AS value, count(*) AS n FROM scored
  WHERE parse_ok AND python_major_minor <> '' GROUP BY run_date, value)
  SELECT run_date, value, n, round(n * 10000 / (sum(n) OVER (PARTITION BY run_date))::DOUBLE) / 100e0 AS pct FROM counted""",
)
def census_version_share(spark, sf):
    return A.version_share(observe(B.landed_documents(spark, sf)))


