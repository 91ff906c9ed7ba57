"""Top-k reports.  Each sorts by share, then by name, and stops at k rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.trends import latest_rows

REPORT_COLUMNS = ("library", "category", "adoption_pct", "notebook_count")


def top_libraries(adoption: DataFrame, k: int) -> DataFrame:
    """The k most adopted rows of one date (or of whatever is passed in)."""
    return adoption.orderBy(F.desc("adoption_pct"), "library").limit(k).select(*REPORT_COLUMNS)


def as_bars(top: DataFrame) -> DataFrame:
    """A ranking smallest first, as a bar chart reads it."""
    return top.orderBy("adoption_pct", F.desc("library"))


def latest_ranking(adoption: DataFrame, k: int = 15) -> DataFrame:
    """Top k on the latest date, in chart order."""
    return as_bars(top_libraries(latest_rows(adoption), k))


def stat_cards(snapshots: DataFrame, adoption: DataFrame, all_snapshots: DataFrame) -> DataFrame:
    """Headline figures: all-time total, latest volume, and the leading library."""
    total = all_snapshots.agg(F.sum("notebooks_collected")).scalar()
    latest = latest_rows(snapshots)
    newest = adoption.where(F.col("run_date") == snapshots.agg(F.max("run_date")).scalar())
    leader = top_libraries(newest, 1)
    return latest.select(
        "run_date",
        total.alias("total_collected"),
        "notebooks_collected",
        "notebooks_parsed",
        F.col("parse_success_rate"),
        F.col("reproducibility_score_mean"),
        leader.select("library").scalar().alias("top_library"),
        leader.select("adoption_pct").scalar().alias("top_pct"),
    )
