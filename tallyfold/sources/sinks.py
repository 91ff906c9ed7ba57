"""Writers that replace whole dates and leave all other dates alone."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.sources.readers import content_bucket
from tallyfold.sources.runs import SINGLE, Run


def write_dates(
    rows: DataFrame, root: str, run_date: date | None = None, collection_type: str = "daily", replaced: Iterable[date] = ()
) -> None:
    """Write rows by collection type and date as a run of one table, which has the folder ``root`` for itself; a date
    that is written again is replaced in its own collection type only, and a write that dies changes nothing.

    ``run_date`` and ``collection_type`` are given to rows that have no such
    column or no value in it.  ``replaced`` names the dates of a run: those it finds no rows for
    are emptied.  ``rows`` may read the dates they replace.
    """
    run = Run(rows.sparkSession, root)
    run.write(SINGLE, rows, run_date, collection_type, replaced)
    run.commit()


def write_contents(documents: DataFrame, path: str) -> None:
    """Store landed documents by the bucket of their repository, so that a run
    opens only the folders it draws from."""
    rows = documents.select("full_name", "path", "size_bytes", "raw", content_bucket(F.col("full_name")).alias("bucket"))
    rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def upsert(existing: DataFrame, new: DataFrame, key: str = "run_date") -> DataFrame:
    """Rows of ``existing`` whose key is not in ``new``, and all of ``new``;
    columns are matched by name and missing ones are null."""
    kept = existing.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def write_csv(table: DataFrame, path: str) -> None:
    """Mirror a table as CSV files with headers, in date order."""
    ordered = table.orderBy(*[c for c in ("run_date", "collection_type", "library") if c in table.columns])
    ordered.write.mode("overwrite").option("header", "true").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_document(document: DataFrame, path: str) -> None:
    """One row holding one JSON text as a text file."""
    document.write.mode("overwrite").text(path)
