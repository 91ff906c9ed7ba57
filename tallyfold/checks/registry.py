"""Where queries and their SQL counterparts are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, optional: tuple[str, ...] = ()):
    """Register a query under ``name``, with the SQL of the same result.

    ``optional`` names whole-number columns that may be null.  Both sides give
    them as DOUBLE, since clients differ in how they show an absent integer.
    """
    if sql is not None and optional:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in optional)}) FROM ({sql})"

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = build(spark, sf_dir)
            return at_edge(rows.withColumns({c: F.col(c).cast("double") for c in optional}))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def at_edge(rows: DataFrame) -> DataFrame:
    """Result form: dates as ISO text, lists of text joined with ``;``."""
    out = {}
    for field in rows.schema:
        if isinstance(field.dataType, T.DateType):
            out[field.name] = F.date_format(field.name, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.ArrayType):
            out[field.name] = F.array_join(field.name, ";")
    return rows.withColumns(out) if out else rows
