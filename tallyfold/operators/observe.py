"""The flat observation row: provenance, features, scores and technology flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.fixed_values import LIBRARIES, SCORE_COLUMNS
from tallyfold.functions.scores import with_scores
from tallyfold.operators.detect import summary_columns, wide_flags, with_detection
from tallyfold.operators.parse import FEATURE_COLUMNS, flat_row, parse_documents

PROVENANCE = (
    "repo_full_name", "path", "ref", "size_bytes", "repo_stars", "repo_size_kb",
    "repo_created_at", "repo_pushed_at", "strategy", "stratum",
)
OBSERVATION_COLUMNS = (
    "run_date", "collection_type", *PROVENANCE, *FEATURE_COLUMNS, *SCORE_COLUMNS,
    *(f"lib_{name}" for name in LIBRARIES),
    "detected_libraries", "detected_categories", "detected_library_count",
)


def observe(docs: DataFrame) -> DataFrame:
    """Landed documents (with ``run_date`` and ``collection_type``) to
    observation rows.  Row-local: no shuffle, and ``raw`` ends here."""
    scored = with_scores(with_detection(parse_documents(docs)))
    flagged = scored.withColumns({**wide_flags(F.col("libraries")), **summary_columns()})
    return flat_row(flagged).select(*OBSERVATION_COLUMNS)
