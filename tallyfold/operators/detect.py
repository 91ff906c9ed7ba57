"""Modules to technologies: a constant map for the shipped registry, a join for
registries that come as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.fixed_values import CATEGORY_OF, LIBRARIES, MODULE_TO_LIBRARY, REGISTRY
from tallyfold.functions.text import joined

REGISTRY_SCHEMA = "library string, modules array<string>, category string, pypi string"


def registry_frame(spark: SparkSession) -> DataFrame:
    """The shipped registry, one row per module; category defaults to other."""
    rows = [(lib, list(modules), category, pypi) for lib, modules, category, pypi in REGISTRY]
    return module_rows(spark.createDataFrame(rows, REGISTRY_SCHEMA))


def module_rows(registry: DataFrame) -> DataFrame:
    return registry.select(
        "library",
        F.explode("modules").alias("module"),
        F.coalesce("category", F.lit("other")).alias("category"),
        "pypi",
    )


def _lookup(values: Column, table: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.array_compact(F.transform(values, lambda v: F.try_element_at(known, v)))
    return F.sort_array(F.array_distinct(found))


def libraries_of(modules: Column) -> Column:
    """Sorted distinct libraries of a module list; unknown modules drop out."""
    return _lookup(modules, MODULE_TO_LIBRARY)


def categories_of(libraries: Column) -> Column:
    return _lookup(libraries, CATEGORY_OF)


def with_detection(features: DataFrame) -> DataFrame:
    """Add ``libraries`` and ``categories`` from ``imports``, row by row."""
    found = features.withColumn("libraries", libraries_of(F.col("imports")))
    return found.withColumn("categories", categories_of(F.col("libraries")))


def wide_flags(libraries: Column, known: tuple[str, ...] = LIBRARIES) -> dict[str, Column]:
    """One boolean column per known library, whether seen or not."""
    return {f"lib_{name}": F.array_contains(libraries, name) for name in known}


def summary_columns() -> dict[str, Column]:
    return {
        "detected_libraries": joined(F.col("libraries")),
        "detected_categories": joined(F.col("categories")),
        "detected_library_count": F.size("libraries"),
    }


SALTS = 32
TRACKED = 10_000  # modules that the summary of frequent ones follows


def hot_modules(modules: DataFrame, share: float = 1 / SALTS) -> list[str]:
    """Modules on more than ``share`` of all rows, ``1 / share`` at most, from one pass with a mergeable summary of
    frequent items.  Its counts may fall short by a ten-thousandth part of all rows or so."""
    found = modules.agg(F.count("module").alias("rows"), F.expr(f"approx_top_k(module, {max(1, round(1 / share))}, {TRACKED})").alias("top")).first()
    return sorted(entry["item"] for entry in found.top if entry["item"] is not None and entry["count"] > share * found.rows)


def is_small(rows: DataFrame) -> bool:
    """Would the planner send ``rows`` to every task, by their estimated size?"""
    estimate = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    limit = rows.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(estimate)) <= limit


def salted_entries(entries: DataFrame, hot: list[str]) -> DataFrame:
    """Registry rows with ``salt`` 0, those of hot modules once for each of the salts."""
    salts = F.when(F.col("module").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return entries.withColumn("salt", F.explode(salts))


def detect_by_join(modules: DataFrame, registry: DataFrame, key: str, hot: list[str] | None = None) -> DataFrame:
    """Detection against a registry table of any size.

    ``modules`` has (``key``, ``module``).  The join side is left to the
    planner's size check; with a small registry the hits are joined and combined
    in place and only the lists are shuffled.  With a large one, the documents of hot modules (given, or found
    in a pass of their own) are dealt over salts, so a module that every document names is split, and
    only the few registry rows of these are copied.  Repeats fall away in the sets,
    whose size is bounded by the registry entries one document can name.
    """
    entries = registry.select("module", "library", "category").distinct()
    if hot is None:
        hot = [] if is_small(entries) else hot_modules(modules)
    if hot:
        salt = F.when(F.col("module").isin(hot), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).otherwise(0)
        hits = modules.select(key, "module", salt.alias("salt")).join(salted_entries(entries, hot), ["module", "salt"])
    else:
        hits = modules.select(key, "module").join(entries, "module")
    return hits.groupBy(key).agg(
        F.array_sort(F.collect_set("library")).alias("libraries"),
        F.array_sort(F.collect_set("category")).alias("categories"),
    )


def module_list(modules: Column) -> Column:
    """A row per distinct module of a list.  The outer form keeps Spark from
    inferring a filter that would compute the list a second time."""
    return F.explode_outer(F.array_distinct(modules))
