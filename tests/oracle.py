"""Run a query and its SQL on the same tables and compare the results."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _kind(dtype) -> str:
    text = str(dtype).lower()
    for kind, names in {
        "int": ("int8", "int16", "int32", "int64"),
        "text": ("string", "large_string", "string_view"),
        "float": ("double", "float"),
        "bool": ("bool",),
    }.items():
        if text in names:
            return kind
    return text


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got, want = spark_df.toArrow(), con.execute(sql).to_arrow_table()
    g = {n: _kind(t) for n, t in zip(got.schema.names, got.schema.types)}
    w = {n: _kind(t) for n, t in zip(want.schema.names, want.schema.types)}
    if g != w:
        return f"schema differs: {sorted(set(g.items()) ^ set(w.items()))}"
    names = sorted(g)

    def rows(tab):
        cols = [tab.column(n).to_pylist() for n in names]
        return sorted((tuple(repr(v) for v in r) for r in zip(*cols)))

    a, b = rows(got), rows(want)
    if a == b:
        return None if a else "no rows"
    only_a = [r for r in a if r not in set(b)][:2]
    only_b = [r for r in b if r not in set(a)][:2]
    return f"{len(a)} vs {len(b)} rows; {names}; only spark {only_a}; only sql {only_b}"
