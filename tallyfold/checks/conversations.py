"""Queries over ``conversations`` as a cell table: a conversation is a document,
a turn a cell position, and the role decides the cell type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.checks import bindings as B
from tallyfold.checks.notebook_sql import SCORE_SQL
from tallyfold.checks.registry import query
from tallyfold.functions.scores import with_scores
from tallyfold.operators import cell_table as C


def conversation_cells(spark, sf) -> DataFrame:
    """Every turn as a JSON cell, read back into a typed cell."""
    turns = B.table(spark, sf, "conversations")
    kind = F.create_map(*[F.lit(x) for x in ("assistant", "code", "user", "markdown", "system", "raw")])
    cell = F.to_json(
        F.struct(
            F.try_element_at(kind, F.col("role")).alias("cell_type"),
            F.col("text").alias("source"),
            F.when(F.col("role") == "assistant", F.col("turn")).alias("execution_count"),
        )
    )
    return C.typed_cells(turns.select("conv_id", "turn", cell.alias("cell")), "conv_id", "turn")


_LINES = """CASE WHEN rtrim(text, chr(10)) = '' THEN 0 ELSE length(rtrim(text, chr(10)))
    - length(replace(rtrim(text, chr(10)), chr(10), '')) + 1 END"""
_CELLS_SQL = f"""WITH cells AS (SELECT conv_id, turn, text, {_LINES} AS lines, turn AS ec,
    CASE role WHEN 'assistant' THEN 'code' WHEN 'user' THEN 'markdown' WHEN 'system' THEN 'raw' END AS kind FROM conversations),
tallies AS (SELECT conv_id, count(*) AS total_cells, count(*) FILTER (kind = 'code') AS code_cells,
    count(*) FILTER (kind = 'markdown') AS markdown_cells, count(*) FILTER (kind = 'raw') AS raw_cells,
    count(*) FILTER (kind IS NULL) AS other_cells,
    count(*) FILTER (kind = 'code' AND NOT regexp_matches(text, '\\S')) AS empty_code_cells,
    sum(lines)::BIGINT AS total_lines, coalesce(sum(lines) FILTER (kind = 'code'), 0)::BIGINT AS code_lines,
    coalesce(sum(lines) FILTER (kind = 'markdown'), 0)::BIGINT AS markdown_lines, sum(length(text))::BIGINT AS total_source_chars
  FROM cells GROUP BY 1),
ratios AS (SELECT *, round(total_lines / total_cells::DOUBLE, 3) AS avg_cell_lines,
    CASE WHEN code_cells > 0 THEN round(code_lines / code_cells::DOUBLE, 3) ELSE 0e0 END AS avg_code_cell_lines,
    CASE WHEN code_lines > 0 THEN round(markdown_lines / code_lines::DOUBLE, 4) ELSE markdown_lines::DOUBLE END AS markdown_to_code_ratio
  FROM tallies),
runs AS (SELECT conv_id, ec, lag(ec) OVER (PARTITION BY conv_id ORDER BY turn) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, row_number() OVER (PARTITION BY conv_id ORDER BY ec, turn) AS rank
  FROM cells WHERE kind = 'code' AND ec > 0),
profile AS (SELECT conv_id, count(*) AS executed_code_cells, max(ec) AS max_execution_count,
    count(*) FILTER (ec <= before) AS execution_order_anomalies, bool_or(ec <> rank) AS has_execution_gaps,
    bool_and(ec = place) AS fully_executed_in_order FROM runs GROUP BY 1),
features AS (SELECT r.*, coalesce(executed_code_cells, 0) AS executed_code_cells, coalesce(max_execution_count, 0) AS max_execution_count,
    coalesce(execution_order_anomalies, 0) AS execution_order_anomalies, coalesce(has_execution_gaps, false) AS has_execution_gaps,
    coalesce(fully_executed_in_order, false) AS fully_executed_in_order, NULL AS kernel_name, NULL AS python_major_minor,
    0 AS import_count, 0 AS total_outputs, 0 AS n_categories FROM ratios r LEFT JOIN profile USING (conv_id))"""


def _sql(columns: str, source: str = "features") -> str:
    return f"{_CELLS_SQL} SELECT conv_id, {columns} FROM {source}"


def conversation_features(spark, sf) -> DataFrame:
    """Conversation features with the columns the scores also read."""
    rows = C.cell_table_features(conversation_cells(spark, sf), "conv_id", "turn")
    none = F.lit(None).cast("string")
    return rows.withColumns(
        {
            "kernel_name": none,
            "python_major_minor": none,
            "import_count": F.lit(0),
            "total_outputs": F.lit(0),
            "categories": F.array().cast("array<string>"),
        }
    )


@query("line_counts", _sql("turn, lines, length(text) AS chars", "cells"))
def line_counts(spark, sf):
    return conversation_cells(spark, sf).select("conv_id", "turn", "lines", "chars")


_TALLIES = ("total_cells", "code_cells", "markdown_cells", "raw_cells", "other_cells", "empty_code_cells")
_VOLUME = ("total_lines", "code_lines", "markdown_lines", "total_source_chars")
_RATIOS = ("avg_cell_lines", "avg_code_cell_lines", "markdown_to_code_ratio")


def _tally_query(name, columns):
    @query(name, _sql(", ".join(columns)))
    def build(spark, sf):
        return C.with_ratios(C.cell_tallies(conversation_cells(spark, sf), "conv_id")).select("conv_id", *columns)

    return build


cell_tallies = _tally_query("cell_tallies", _TALLIES)
text_volume = _tally_query("text_volume", _VOLUME)
text_ratios = _tally_query("text_ratios", _RATIOS)


@query("exec_counts", _sql("executed_code_cells, max_execution_count", "profile"))
def exec_counts(spark, sf):
    profile = C.execution_profile(conversation_cells(spark, sf), "conv_id", "turn")
    return profile.select("conv_id", "executed_code_cells", "max_execution_count")


@query("exec_anomalies", _sql("execution_order_anomalies", "profile"))
def exec_anomalies(spark, sf):
    runs = C.executed(conversation_cells(spark, sf), "conv_id", "turn")
    return C.order_anomalies(runs, "conv_id", "turn", block=2)


@query(
    "exec_anomalies_events",
    """WITH r AS (SELECT user_id, k, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS before
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k > 0)
  SELECT user_id, count(*) FILTER (k <= before) AS execution_order_anomalies FROM r GROUP BY 1""",
)
def exec_anomalies_events(spark, sf):
    """A user's events as executed cells: the counter in ``props`` is the count."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    runs = B.table(spark, sf, "events").select("user_id", "event_id", k.alias("count")).where(F.col("count") > 0)
    return C.order_anomalies(runs, "user_id", "event_id")


@query("exec_gaps", _sql("has_execution_gaps, fully_executed_in_order", "profile"))
def exec_gaps(spark, sf):
    profile = C.execution_profile(conversation_cells(spark, sf), "conv_id", "turn")
    return profile.select("conv_id", "has_execution_gaps", "fully_executed_in_order")


def _score_query(name, *columns):
    @query(name, _sql(", ".join(f"{SCORE_SQL[c]} AS {c}" for c in columns)))
    def build(spark, sf):
        return with_scores(conversation_features(spark, sf), *columns).select("conv_id", *columns)

    return build


score_size = _score_query("score_size", "notebook_size_index")
score_narrative = _score_query("score_narrative", "narrative_index")
score_reproducibility = _score_query("score_reproducibility", "reproducibility_score")
score_complexity = _score_query("score_complexity", "complexity_score")
score_educational = _score_query("score_educational", "educational_score")
score_docs = _score_query("score_docs", "documentation_density")
