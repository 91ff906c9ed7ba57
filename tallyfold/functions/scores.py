"""The ten bounded scores as column expressions over feature columns.

``SCORES`` maps a score name to a function returning its column.  Scores on
detected technology read ``categories`` (ARRAY<STRING>).  To add a score, add
an entry that yields a value in [0, 1].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.rounding import as_share, as_term, clip01, flag, saturating, weighted


def _s(name: str, scale: float) -> Column:
    return as_term(saturating(F.col(name), scale))


def _family(category: str) -> Column:
    return flag(F.array_contains("categories", category))


def size_index() -> Column:
    return weighted((".5", _s("total_cells", 40)), (".5", _s("total_lines", 400)))


def narrative() -> Column:
    content = F.col("markdown_cells") + F.col("code_cells")
    share = F.when(content > 0, F.col("markdown_cells") / content).otherwise(F.lit(0.0))
    return weighted((".6", as_share(share)), (".4", _s("markdown_lines", 60)))


def execution_order() -> Column:
    """1 for a clean run, less the share of anomalies otherwise, 0 if nothing ran."""
    ran = F.col("executed_code_cells")
    kept = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("execution_order_anomalies") / F.greatest(F.lit(1), ran))
    return (
        F.when(ran == 0, F.lit(0.0))
        .when(F.col("fully_executed_in_order"), F.lit(1.0))
        .otherwise(kept * F.when(F.col("has_execution_gaps"), F.lit(0.6)).otherwise(F.lit(1.0)))
    )


def reproducibility() -> Column:
    return weighted(
        (".2", flag(F.col("kernel_name").isNotNull())),
        (".2", flag(F.col("python_major_minor").isNotNull())),
        (".45", as_share(execution_order())),
        (".15", flag(F.col("import_count") > 0)),
    )


def visualization() -> Column:
    return weighted((".5", _family("plotting")), (".5", _s("image_outputs", 4)))


def interactive() -> Column:
    return weighted(
        (".4", _family("interactive")),
        (".3", flag(F.col("has_widget_state"))),
        (".3", _s("widget_output_count", 2)),
    )


def scientific() -> Column:
    return weighted((".5", _family("array")), (".35", _family("scientific")), (".15", _family("data_io")))


def ml_usage() -> Column:
    return weighted((".4", _family("ml")), (".4", _family("deep_learning")), (".2", _family("llm")))


def complexity() -> Column:
    breadth = saturating(F.size("categories"), 3)
    return weighted(
        (".35", _s("code_lines", 300)),
        (".25", _s("import_count", 8)),
        (".2", _s("total_outputs", 15)),
        (".2", as_term(breadth)),
    )


def educational() -> Column:
    code, prose = F.col("code_cells"), F.col("markdown_cells")
    even = F.exp(-F.abs(F.ln(prose / code + F.lit(1e-9))))
    balance = F.when((code > 0) & (prose > 0), even).otherwise(F.lit(0.0))
    return weighted((".6", as_share(balance)), (".4", _s("markdown_lines", 50)))


def documentation() -> Column:
    total = F.col("total_lines")
    share = F.when(total > 0, F.col("markdown_lines") / total).otherwise(F.lit(0.0))
    return clip01(as_share(share))


SCORES = {
    "notebook_size_index": size_index,
    "narrative_index": narrative,
    "reproducibility_score": reproducibility,
    "visualization_density": visualization,
    "interactive_widget_score": interactive,
    "scientific_computing_score": scientific,
    "ml_usage_score": ml_usage,
    "complexity_score": complexity,
    "educational_score": educational,
    "documentation_density": documentation,
}


def with_scores(features: DataFrame, *names: str) -> DataFrame:
    """Add the named scores (all by default) in one projection."""
    chosen = names or tuple(SCORES)
    return features.withColumns({name: SCORES[name]() for name in chosen})
