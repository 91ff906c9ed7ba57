"""The document binding stated in SQL: what the derived JSON documents hold.

Nothing here reads JSON.  Cells, types and outputs follow from the line rules
of ``bindings.landed_documents``; features and scores are summed from those.
"""

from __future__ import annotations

from tallyfold.checks.bindings import MODULE_NAMES
from tallyfold.fixed_values import EXTENSION_LABELS, LIBRARIES, REGISTRY, WIDGET_MIME

_NAMES = "[" + ", ".join(f"'{m}'" for m in MODULE_NAMES) + "]"
_KEYS = "[" + ", ".join(f"'{k}'" for k, _ in EXTENSION_LABELS) + "]"
_LABELS = "[" + ", ".join(f"'{label}'" for _, label in EXTENSION_LABELS) + "]"
_NL = "chr(10)"


def _module(shift: int) -> str:
    return f"names[(L + {shift}) % 50 + 1]"


def lines_sql(text: str) -> str:
    body = f"rtrim({text}, {_NL})"
    return f"CASE WHEN {body} = '' THEN 0 ELSE length({body}) - length(replace({body}, {_NL}, '')) + 1 END"


# Length of a line as an escaped JSON string with ASCII escapes.
_JSON_LENGTH = r"""(2 + L + length(s) - length(translate(s, chr(34) || chr(92) || chr(9), ''))
  + 5 * length(regexp_replace(s, '[\x00-\x7E]', '', 'g')) + 6 * length(regexp_replace(s, '[^\x{10000}-\x{10FFFF}]', '', 'g')))"""
_STREAM = len('{"output_type": "stream", "text": }')
_IMAGE = len('{"output_type": "display_data", "data": {"image/png": "AAAA", "text/plain": }}')
_HTML = len('{"output_type": "execute_result", "data": {"text/html": , "image/svg+xml": "x"}}')
_WIDGET = len('{"output_type": "display_data", "data": {"": {"model_id": "m"}}}') + len(WIDGET_MIME)

CELLS_SQL = f"""docs AS (SELECT *, CAST(substr(source, 4) AS INT) AS k,
    CAST(substr(source, 4) AS INT) NOT IN (0, 1, 2) AS parse_ok FROM documents),
split AS (SELECT doc_id, lang, k, unnest(string_split(text, {_NL})) AS s,
    generate_subscripts(string_split(text, {_NL}), 1) - 1 AS i FROM docs WHERE k NOT IN (0, 1, 2, 4)),
shaped AS (SELECT *, length(s) AS L, CASE WHEN k = 8 THEN 0 WHEN k = 9 THEN 4 ELSE (length(s) + i) % 10 END AS h,
    {_NAMES} AS names FROM split),
kinds AS (SELECT *, CASE WHEN h < 4 OR h = 9 THEN 'code' WHEN h IN (4, 5, 6) THEN 'markdown' WHEN h = 7 THEN 'raw'
    ELSE 'scalar' END AS kind, CASE WHEN h < 4 THEN L % 7 END AS g,
    CASE WHEN h < 4 OR h = 9 THEN CASE WHEN k = 8 THEN i + 1 WHEN L % 9 IN (0, 1, 4) THEN NULL WHEN L % 9 = 2 THEN 3
      WHEN L % 9 = 3 THEN 4 ELSE L % 50 END END AS ec FROM shaped),
cells AS (SELECT *, CASE kind WHEN 'raw' THEN s WHEN 'scalar' THEN '' WHEN 'markdown' THEN
      CASE h WHEN 4 THEN '## h' || {_NL} || s WHEN 5 THEN s || {_NL} || {_NL} ELSE s END
    ELSE CASE WHEN s = '' THEN '' WHEN h = 9 THEN 'import ' || {_module(0)}
      WHEN h = 2 THEN 'print 1' || {_NL} || 'import ' || {_module(0)} || ', ' || {_module(1)} || {_NL} || '# ' || s
      WHEN h = 3 THEN '\"\"\"' || {_NL} || 'import ' || {_module(0)} || {_NL} || '\"\"\"' || {_NL} || 'from . import util' || {_NL} || '# ' || s
      ELSE 'import ' || {_module(0)} || ', ' || {_module(1)} || ' as z' || {_NL} || '%time x' || {_NL} || 'from ' || {_module(2)}
        || '.core import y' || {_NL} || '# ' || s END END AS text,
    CASE WHEN h = 0 THEN [lang, CAST(L % 3 AS VARCHAR), 'True'] ELSE [] END AS tags,
    CASE WHEN kind <> 'code' OR s = '' THEN [] WHEN h < 2 THEN [{_module(0)}, {_module(1)}, {_module(2)}]
      ELSE [{_module(0)}] END AS modules,
    CASE g WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 0 END AS n_outputs,
    CASE g WHEN 2 THEN {_STREAM} + {_JSON_LENGTH} WHEN 3 THEN {_IMAGE} + {_JSON_LENGTH} WHEN 4 THEN {_HTML} + {_JSON_LENGTH}
      WHEN 5 THEN {_WIDGET} ELSE 0 END AS output_length
  FROM kinds),
measured AS (SELECT *, {lines_sql("text")} AS lines FROM cells)"""

META_SQL = f"""meta AS (SELECT *, parse_ok AND k <> 6 AS has_meta,
    CASE WHEN parse_ok THEN CASE WHEN k = 3 THEN 3 WHEN k = 7 THEN NULL ELSE 4 END END AS nbformat,
    CASE WHEN NOT parse_ok OR k IN (3, 4, 5, 6) THEN NULL WHEN k = 7 THEN 4 ELSE n_chars % 6 END AS nbformat_minor
  FROM docs),
described AS (SELECT *,
    CASE WHEN NOT parse_ok THEN CASE WHEN k = 1 THEN 'top-level value is not an object' ELSE 'json: invalid document' END END AS parse_error,
    CASE WHEN has_meta AND lang <> 'es' THEN 'python3' END AS kernel_name,
    CASE WHEN has_meta THEN 'Kernel ' || lang END AS kernel_display_name,
    CASE WHEN has_meta THEN CASE WHEN lang = 'en' THEN 'python' ELSE lang || '-lang' END END AS language,
    CASE WHEN has_meta THEN CASE lang WHEN 'en' THEN '3.' || (n_chars % 13) || '.' || (n_chars % 5)
      WHEN 'fr' THEN 'v20.' || (n_chars % 3) WHEN 'de' THEN '1' END END AS language_version,
    CASE WHEN has_meta THEN CASE lang WHEN 'en' THEN '3.' || (n_chars % 13) || '.' || (n_chars % 5)
      WHEN 'fr' THEN '20.' || (n_chars % 3) END END AS python_version,
    CASE WHEN has_meta THEN CASE lang WHEN 'en' THEN '3.' || (n_chars % 13) WHEN 'fr' THEN '20.' || (n_chars % 3) END END AS python_major_minor,
    has_meta AND (lang = 'fr' OR (lang <> 'de' AND k - 9 BETWEEN 1 AND 9 AND {_KEYS}[k - 9] = 'widgets')) AS has_widget_state,
    has_meta AND (lang IN ('fr', 'de') OR k BETWEEN 10 AND 18) AS has_custom_metadata,
    CASE WHEN NOT has_meta THEN '' WHEN lang IN ('fr', 'de') THEN 'jupyter-widgets' WHEN k BETWEEN 10 AND 18
      THEN {_LABELS}[k - 9] ELSE '' END AS extension_hints
  FROM meta)"""

TALLY_SQL = """tallies AS (SELECT doc_id,
    count(*) FILTER (kind <> 'scalar') AS total_cells, count(*) FILTER (kind = 'code') AS code_cells,
    count(*) FILTER (kind = 'markdown') AS markdown_cells, count(*) FILTER (kind = 'raw') AS raw_cells,
    count(*) FILTER (kind = 'scalar') AS other_cells, count(*) FILTER (kind = 'code' AND text = '') AS empty_code_cells,
    sum(lines)::BIGINT AS total_lines, coalesce(sum(lines) FILTER (kind = 'code'), 0)::BIGINT AS code_lines,
    coalesce(sum(lines) FILTER (kind = 'markdown'), 0)::BIGINT AS markdown_lines, sum(length(text))::BIGINT AS total_source_chars,
    count(*) FILTER (n_outputs > 0) AS cells_with_output, sum(n_outputs)::BIGINT AS total_outputs,
    count(*) FILTER (g IN (3, 4)) AS image_outputs, count(*) FILTER (g = 4) AS html_outputs,
    count(*) FILTER (g = 2) AS stream_outputs, count(*) FILTER (g = 4) AS error_outputs,
    count(*) FILTER (g = 5) AS widget_output_count, max(output_length)::BIGINT AS largest_output_bytes
  FROM measured GROUP BY doc_id),
tagged AS (SELECT doc_id, string_agg(t, ';' ORDER BY t) AS distinct_cell_tags, count(*) AS cell_tag_count
  FROM (SELECT DISTINCT doc_id, unnest(tags) AS t FROM measured) GROUP BY 1),
runs AS (SELECT doc_id, i, ec, lag(ec) OVER (PARTITION BY doc_id ORDER BY i) AS before,
    row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place, row_number() OVER (PARTITION BY doc_id ORDER BY ec, i) AS rank
  FROM measured WHERE ec > 0),
profile AS (SELECT doc_id, count(*) AS executed_code_cells, max(ec) AS max_execution_count,
    count(*) FILTER (ec <= before) AS execution_order_anomalies, bool_or(ec <> rank) AS has_execution_gaps,
    bool_and(ec = place) AS fully_executed_in_order FROM runs GROUP BY 1),
imported AS (SELECT DISTINCT doc_id, unnest(modules) AS module FROM measured),
import_lists AS (SELECT doc_id, string_agg(module, ';' ORDER BY module) AS imports, count(*) AS import_count FROM imported GROUP BY 1)"""

_REGISTRY = ", ".join(f"('{lib}', '{m}', '{cat}')" for lib, modules, cat, _ in REGISTRY for m in modules)
DETECT_SQL = f"""registry(library, module, category) AS (VALUES {_REGISTRY}),
found AS (SELECT DISTINCT doc_id, library, category FROM imported JOIN registry USING (module)),
found_lists AS (SELECT doc_id, string_agg(DISTINCT library, ';' ORDER BY library) AS detected_libraries,
    string_agg(DISTINCT category, ';' ORDER BY category) AS detected_categories, count(DISTINCT library) AS detected_library_count,
    count(DISTINCT category) AS n_categories, list(DISTINCT category) AS categories, list(DISTINCT library) AS libraries
  FROM found GROUP BY 1)"""

FEATURES_SQL = """features AS (SELECT d.doc_id, d.lang, d.k, d.n_chars, d.source, d.parse_ok, d.parse_error, d.nbformat, d.nbformat_minor, d.kernel_name,
    d.kernel_display_name, d.language, d.language_version, d.python_version, d.python_major_minor,
    coalesce(total_cells, 0) AS total_cells, coalesce(code_cells, 0) AS code_cells, coalesce(markdown_cells, 0) AS markdown_cells,
    coalesce(raw_cells, 0) AS raw_cells, coalesce(other_cells, 0) AS other_cells, coalesce(empty_code_cells, 0) AS empty_code_cells,
    coalesce(total_lines, 0) AS total_lines, coalesce(code_lines, 0) AS code_lines, coalesce(markdown_lines, 0) AS markdown_lines,
    CASE WHEN total_cells > 0 THEN round(total_lines / total_cells::DOUBLE, 3) ELSE 0e0 END AS avg_cell_lines,
    CASE WHEN code_cells > 0 THEN round(code_lines / code_cells::DOUBLE, 3) ELSE 0e0 END AS avg_code_cell_lines,
    CASE WHEN code_lines > 0 THEN round(markdown_lines / code_lines::DOUBLE, 4) ELSE coalesce(markdown_lines, 0)::DOUBLE END AS markdown_to_code_ratio,
    coalesce(total_source_chars, 0) AS total_source_chars,
    coalesce(executed_code_cells, 0) AS executed_code_cells, coalesce(max_execution_count, 0) AS max_execution_count,
    coalesce(execution_order_anomalies, 0) AS execution_order_anomalies, coalesce(has_execution_gaps, false) AS has_execution_gaps,
    coalesce(fully_executed_in_order, false) AS fully_executed_in_order,
    coalesce(cells_with_output, 0) AS cells_with_output, coalesce(total_outputs, 0) AS total_outputs, coalesce(image_outputs, 0) AS image_outputs,
    coalesce(html_outputs, 0) AS html_outputs, coalesce(stream_outputs, 0) AS stream_outputs, coalesce(error_outputs, 0) AS error_outputs,
    coalesce(largest_output_bytes, 0) AS largest_output_bytes, coalesce(cells_with_output, 0) > 0 AS has_any_output,
    d.has_widget_state, coalesce(widget_output_count, 0) AS widget_output_count,
    coalesce(cell_tag_count, 0) AS cell_tag_count, coalesce(distinct_cell_tags, '') AS distinct_cell_tags,
    d.has_custom_metadata, d.extension_hints, coalesce(imports, '') AS imports, coalesce(import_count, 0) AS import_count,
    coalesce(detected_libraries, '') AS detected_libraries, coalesce(detected_categories, '') AS detected_categories,
    coalesce(detected_library_count, 0) AS detected_library_count, coalesce(n_categories, 0) AS n_categories,
    coalesce(categories, []) AS categories, coalesce(libraries, []) AS libraries
  FROM described d LEFT JOIN tallies USING (doc_id) LEFT JOIN tagged USING (doc_id) LEFT JOIN profile USING (doc_id)
    LEFT JOIN import_lists USING (doc_id) LEFT JOIN found_lists USING (doc_id))"""


# --- scores ---------------------------------------------------------------------

def sat(value: str, scale: int) -> str:
    return f"(CASE WHEN {value} > 0 THEN round(1 - exp(-({value})::DOUBLE / {scale}e0), 4) ELSE 0e0 END)::DECIMAL(10,4)"


def share(value: str) -> str:
    return f"({value})::DECIMAL(20,12)"


def yes(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1 ELSE 0 END)::DECIMAL(10,4)"


def clip(value: str) -> str:
    return f"round(greatest(0::DECIMAL(20,12), least(1::DECIMAL(20,12), {value})), 4)::DOUBLE"


def blend(*terms: tuple[str, str]) -> str:
    return clip(" + ".join(f"{w}::DECIMAL(4,2) * {t}" for w, t in terms))


def has(category: str) -> str:
    return yes(f"list_contains(categories, '{category}')")


_EXEC = """CASE WHEN executed_code_cells = 0 THEN 0e0 WHEN fully_executed_in_order THEN 1e0
  ELSE greatest(0e0, 1e0 - execution_order_anomalies::DOUBLE / greatest(1, executed_code_cells)) * CASE WHEN has_execution_gaps THEN 0.6e0 ELSE 1e0 END END"""
_MD_SHARE = """CASE WHEN markdown_cells + code_cells > 0 THEN markdown_cells::DOUBLE / (markdown_cells + code_cells) ELSE 0e0 END"""
_BALANCE = """CASE WHEN code_cells > 0 AND markdown_cells > 0 THEN exp(-abs(ln(markdown_cells::DOUBLE / code_cells + 1e-9))) ELSE 0e0 END"""
_DOCS = "CASE WHEN total_lines > 0 THEN markdown_lines::DOUBLE / total_lines ELSE 0e0 END"

SCORE_SQL = {
    "notebook_size_index": blend(("0.5", sat("total_cells", 40)), ("0.5", sat("total_lines", 400))),
    "narrative_index": blend(("0.6", share(_MD_SHARE)), ("0.4", sat("markdown_lines", 60))),
    "reproducibility_score": blend(
        ("0.2", yes("kernel_name IS NOT NULL")),
        ("0.2", yes("python_major_minor IS NOT NULL")),
        ("0.45", share(_EXEC)),
        ("0.15", yes("import_count > 0")),
    ),
    "visualization_density": blend(("0.5", has("plotting")), ("0.5", sat("image_outputs", 4))),
    "interactive_widget_score": blend(
        ("0.4", has("interactive")), ("0.3", yes("has_widget_state")), ("0.3", sat("widget_output_count", 2))
    ),
    "scientific_computing_score": blend(("0.5", has("array")), ("0.35", has("scientific")), ("0.15", has("data_io"))),
    "ml_usage_score": blend(("0.4", has("ml")), ("0.4", has("deep_learning")), ("0.2", has("llm"))),
    "complexity_score": blend(
        ("0.35", sat("code_lines", 300)), ("0.25", sat("import_count", 8)), ("0.2", sat("total_outputs", 15)), ("0.2", sat("n_categories", 3))
    ),
    "educational_score": blend(("0.6", share(_BALANCE)), ("0.4", sat("markdown_lines", 50))),
    "documentation_density": clip(share(_DOCS)),
}
SCORES_SQL = "scored AS (SELECT *, " + ", ".join(f"{sql} AS {name}" for name, sql in SCORE_SQL.items()) + " FROM features)"
ALL_SQL = ",\n".join(("WITH " + CELLS_SQL, META_SQL, TALLY_SQL, DETECT_SQL, FEATURES_SQL, SCORES_SQL))
FLAGS_SQL = ", ".join(f"list_contains(libraries, '{lib}') AS lib_{lib}" for lib in LIBRARIES)
PATH_SQL = "'docs/' || doc_id || '.ipynb' AS path"
