"""Lenient reads from VARIANT values: wrong types give null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.functions.text import HAS_TEXT


def get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v) == kind


def lenient_int(v: Column) -> Column:
    """Whole number of a JSON value: numbers truncate, numeric text is read,
    booleans and everything else give null."""
    n = get(v, "$", "bigint")
    return F.when(n.isin(0, 1) & _is(v, "BOOLEAN"), F.lit(None)).otherwise(n)


def lenient_str(v: Column) -> Column:
    """Text that is not blank, untrimmed; any other JSON value gives null."""
    return F.when(_is(v, "STRING") & get(v, "$", "string").rlike(HAS_TEXT), get(v, "$", "string"))


def spelled(v: Column) -> Column:
    """A list item as text, with null and booleans spelled None, True, False."""
    s = get(v, "$", "string")
    return (
        F.when(s.isNull(), F.lit("None"))
        .when(s.isin("true", "false") & _is(v, "BOOLEAN"), F.initcap(s))
        .otherwise(s)
    )


def items(v: Column, path: str = "$") -> Column:
    """A JSON list as ARRAY<VARIANT>; null for any other value."""
    return get(v, path, "array<variant>")


def fields(v: Column, path: str = "$") -> Column:
    """A JSON object as MAP<STRING, VARIANT>; null for any other value."""
    return get(v, path, "map<string,variant>")


def is_truthy(v: Column) -> Column:
    """False for absent, null, false, 0, "", [] and {}."""
    return F.coalesce(~F.is_variant_null(v) & ~F.to_json(v).isin("false", "0", '""', "[]", "{}", "0.0", "-0.0"), F.lit(False))
