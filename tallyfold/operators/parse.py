"""Raw document JSON to one typed feature row, without a shuffle.

``raw`` is read once into VARIANT fields; every cell becomes a typed struct in
one pass; all tallies are array expressions over those structs.  Each step is
its own projection so that Catalyst keeps the JSON read and the cell pass to
one evaluation per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.fixed_values import EXTENSION_LABELS, STANDARD_METADATA_KEYS, WIDGET_MIME
from tallyfold.functions import text as T
from tallyfold.functions import variant as V
from tallyfold.operators.imports import ast_imports

DOCUMENT_FIELDS = (
    "nbformat VARIANT, nbformat_minor VARIANT, metadata VARIANT, "
    "cells VARIANT, worksheets VARIANT"
)
_JSON_OPTIONS = {"allowSingleQuotes": "false"}


# --- step 1: JSON text to VARIANT fields -------------------------------------

def read_json(docs: DataFrame) -> DataFrame:
    """Add ``doc`` (VARIANT fields), ``parse_ok`` and ``parse_error``.

    The text is read as the only element of a list, so that anything after the
    object makes the list unreadable or longer.
    """
    listed = F.concat(F.lit("["), F.col("raw"), F.lit("]"))
    read = docs.withColumn("read", F.from_json(listed, f"ARRAY<STRUCT<{DOCUMENT_FIELDS}>>", _JSON_OPTIONS))
    parsed = read.withColumn("doc", F.when(F.size("read") == 1, F.col("read")[0])).drop("read")
    blanks = F.lit(" \t\r\n")
    opened = F.ltrim(F.col("raw"), blanks).startswith("{")
    framed = opened & F.rtrim(F.col("raw"), blanks).endswith("}")
    ok = F.coalesce(framed & F.col("doc").isNotNull(), F.lit(False))
    error = F.when(~opened & F.try_parse_json("raw").isNotNull(), F.lit("top-level value is not an object")).otherwise(
        F.lit("json: invalid document")
    )
    return parsed.withColumn("parse_ok", ok).withColumn("parse_error", F.when(~F.col("parse_ok"), error))


# --- step 2: metadata --------------------------------------------------------

def with_metadata(docs: DataFrame) -> DataFrame:
    """Add format, kernel, language, version, widget and extension columns."""
    meta = F.when(F.col("parse_ok"), F.col("doc.metadata"))
    staged = docs.withColumns(
        {
            "meta_keys": F.coalesce(F.map_keys(V.fields(meta)), F.array().cast("array<string>")),
            "kernel_name": V.lenient_str(V.get(meta, "$.kernelspec.name", "variant")),
            "kernel_display_name": V.lenient_str(V.get(meta, "$.kernelspec.display_name", "variant")),
            "kernel_language": V.lenient_str(V.get(meta, "$.kernelspec.language", "variant")),
            "info_language": V.lenient_str(V.get(meta, "$.language_info.name", "variant")),
            "language_version": V.lenient_str(V.get(meta, "$.language_info.version", "variant")),
            "has_widget_state": V.is_truthy(V.get(meta, "$.widgets", "variant")),
            "nbformat": F.when(F.col("parse_ok"), V.lenient_int(F.col("doc.nbformat"))),
            "nbformat_minor": F.when(F.col("parse_ok"), V.lenient_int(F.col("doc.nbformat_minor"))),
        }
    )
    known = F.create_map(*[F.lit(x) for pair in EXTENSION_LABELS for x in pair])
    labels = F.array_compact(F.transform("meta_keys", lambda k: F.try_element_at(known, k)))
    other = F.filter("meta_keys", lambda k: ~k.isin(*STANDARD_METADATA_KEYS))
    staged = staged.withColumns(
        {
            "language": F.coalesce("kernel_language", "info_language"),
            "python_version": T.version_in(F.col("language_version")),
            "has_custom_metadata": F.size(other) > 0,
            "extension_hints": F.sort_array(F.array_distinct(labels)),
        }
    )
    return staged.withColumn("python_major_minor", T.major_minor(F.col("python_version"))).drop(
        "meta_keys", "kernel_language", "info_language"
    )


# --- step 3: cells -----------------------------------------------------------

def resolve_cells(doc: Column) -> Column:
    """The cell list: ``cells``, or the worksheets' cells when there is none."""
    cells, sheets = doc["cells"], doc["worksheets"]
    nothing = F.array().cast("array<variant>")
    absent = cells.isNull() | F.is_variant_null(cells)
    of_sheet = F.transform(V.items(sheets), lambda sheet: F.coalesce(V.items(sheet, "$.cells"), nothing))
    return F.when(absent, F.coalesce(F.flatten(of_sheet), nothing)).otherwise(F.coalesce(V.items(cells), nothing))


def text_of(value: Column) -> Column:
    """A list joined, text as it is, anything else empty."""
    parts = F.array_join(F.transform(V.items(value), V.spelled), "")
    as_text = F.when(F.schema_of_variant(value) == "STRING", V.get(value, "$", "string"))
    return F.coalesce(parts, as_text, F.lit(""))


def _typed_output(output: Column) -> Column:
    shape = V.get(output, "$", "struct<output_type:variant,data:variant>")
    return F.struct(
        shape.isNotNull().alias("is_object"),
        V.get(shape["output_type"], "$", "string").alias("kind"),
        F.map_keys(V.fields(shape["data"])).alias("mimes"),
    )


def _with_json(output: Column) -> Column:
    return F.struct(_typed_output(output).alias("typed"), F.to_json(output).alias("json"))


def _measured_output(output: Column) -> Column:
    kept = [output["typed"][c].alias(c) for c in ("is_object", "kind", "mimes")]
    return F.struct(*kept, T.dumped_length(output["json"]).alias("length"))


def cell_parts(cell: Column) -> Column:
    """The known members of a JSON cell, null for scalars and lists."""
    return V.get(
        cell,
        "$",
        "struct<cell_type:variant,source:variant,input:variant,metadata:variant,execution_count:variant,outputs:variant>",
    )


def _kind(parts: Column) -> Column:
    return V.get(parts["cell_type"], "$", "string")  # other JSON types never spell a known kind


def _is_code(parts: Column) -> Column:
    return F.coalesce(_kind(parts) == "code", F.lit(False))


def _said(parts: Column) -> list[Column]:
    """Kind and text of a cell.  Text is under ``source`` when that key is there, else under ``input``."""
    text = F.when(parts["source"].isNotNull(), text_of(parts["source"])).otherwise(text_of(parts["input"]))
    return [parts.isNotNull().alias("is_object"), _kind(parts).alias("kind"), text.alias("text")]


def _tags(parts: Column) -> Column:
    return F.transform(V.items(parts["metadata"], "$.tags"), V.spelled)


def _execution_count(parts: Column) -> Column:
    return F.when(_is_code(parts), V.lenient_int(parts["execution_count"]))


def _json_outputs(parts: Column) -> Column:
    return F.when(_is_code(parts), V.items(parts["outputs"]))


def typed_cell(parts: Column) -> Column:
    """The members of a JSON cell as typed values."""
    return F.struct(
        *_said(parts),
        _tags(parts).alias("tags"),
        _execution_count(parts).alias("execution_count"),
        F.transform(F.transform(_json_outputs(parts), _with_json), _measured_output).alias("outputs"),
    )


CELL_MEMBERS = ("is_object", "kind", "tags", "execution_count", "outputs")


def _measures(text: Column) -> list[Column]:
    return [
        T.line_count(text).cast("bigint").alias("lines"),
        F.length(text).cast("bigint").alias("chars"),
        T.is_blank(text).alias("blank"),
    ]


def measured_cell(cell: Column) -> Column:
    """A typed cell with its line and character counts in place of its text."""
    return F.struct(*[cell[c].alias(c) for c in CELL_MEMBERS], *_measures(cell["text"]))


def with_cell_parts(docs: DataFrame) -> DataFrame:
    """Add ``parts``: ARRAY of the known members of each cell; empty for failed parses."""
    staged = docs.withColumn("parts", F.when(F.col("parse_ok"), resolve_cells(F.col("doc"))).otherwise(F.array().cast("array<variant>")))
    return staged.withColumn("parts", F.transform("parts", cell_parts)).drop("doc")


def with_typed_cells(docs: DataFrame) -> DataFrame:
    """Add ``cells``: ARRAY of typed cells with text; empty for failed parses."""
    return with_cell_parts(docs).withColumn("cells", F.transform("parts", typed_cell)).drop("parts")


def with_cells(docs: DataFrame) -> DataFrame:
    """Add ``cells`` (kind and measures, without text), ``import_sources`` and, a list for each cell, ``cell_tags``,
    ``cell_counts``, ``json_outputs``, ``typed_outputs`` and ``output_lengths`` (null for outputs that are no objects).

    Each is a column of its own, since Spark leaves out columns that nobody reads but never members that a
    function puts into a struct.  Text is dropped here but for the code cells that hold the word ``import``,
    since every later projection copies what it carries.
    """
    staged = with_cell_parts(docs).withColumns(
        {
            "said": F.transform("parts", lambda p: F.struct(*_said(p))),
            "cell_tags": F.transform("parts", _tags),
            "cell_counts": F.transform("parts", _execution_count),
            "json_outputs": F.transform("parts", _json_outputs),
        }
    )
    naming = F.filter("said", lambda c: (c["kind"] == "code") & c["text"].contains("import"))
    staged = staged.drop("parts").withColumns(
        {
            "cells": F.transform("said", lambda c: F.struct(c["is_object"].alias("is_object"), c["kind"].alias("kind"), *_measures(c["text"]))),
            "import_sources": F.transform(naming, lambda c: c["text"]),
            "typed_outputs": F.transform("json_outputs", lambda outputs: F.transform(outputs, _typed_output)),
        }
    )
    spelled = F.zip_with("json_outputs", "typed_outputs", lambda outputs, typed: F.zip_with(outputs, typed, lambda o, t: F.when(t["is_object"], F.to_json(o))))
    lengths = F.transform(spelled, lambda outputs: F.transform(outputs, T.dumped_length))
    return staged.drop("said").withColumn("output_lengths", lengths)


# --- step 4: tallies ---------------------------------------------------------

def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, b: a + F.coalesce(b, F.lit(0)).cast("bigint"))


def _count(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def with_tallies(docs: DataFrame) -> DataFrame:
    """Cell, line, character, tag and output tallies from the columns of ``with_cells``."""

    def count(kind: str) -> Column:
        return _count(F.col("cells"), lambda c: c["kind"] == kind)

    def lines(kind: str) -> Column:
        return total(F.transform(F.filter("cells", lambda c: c["kind"] == kind), lambda c: c["lines"]))

    def listed(name: str) -> Column:
        return F.flatten(F.filter(name, lambda items: items.isNotNull()))

    staged = docs.withColumns(
        {
            "total_cells": _count(F.col("cells"), lambda c: c["is_object"]),
            "code_cells": count("code"),
            "markdown_cells": count("markdown"),
            "raw_cells": count("raw"),
            "empty_code_cells": _count(F.col("cells"), lambda c: (c["kind"] == "code") & c["blank"]),
            "total_lines": total(F.col("cells.lines")),
            "code_lines": lines("code"),
            "markdown_lines": lines("markdown"),
            "total_source_chars": total(F.col("cells.chars")),
            "distinct_cell_tags": F.sort_array(F.array_distinct(listed("cell_tags"))),
            "execution_counts": F.filter("cell_counts", lambda n: n > 0),
            "cells_with_output": _count(F.col("json_outputs"), lambda o: F.size(o) > 0),
            "outputs": F.filter(listed("typed_outputs"), lambda o: o["is_object"]),
            "cell_items": F.size("cells"),
            "largest_output_bytes": F.coalesce(F.array_max(listed("output_lengths")), F.lit(0).cast("bigint")),
        }
    ).drop("cells", "cell_tags", "cell_counts", "json_outputs", "typed_outputs", "output_lengths")
    staged = staged.withColumn("mimes", listed("outputs.mimes"))
    return staged.withColumns(
        {
            "other_cells": F.col("cell_items") - F.col("code_cells") - F.col("markdown_cells") - F.col("raw_cells"),
            "cell_tag_count": F.size("distinct_cell_tags"),
            "has_any_output": F.col("cells_with_output") > 0,
            "total_outputs": F.size("outputs"),
            "image_outputs": _count(F.col("mimes"), lambda m: m.startswith("image/")),
            "html_outputs": _count(F.col("mimes"), lambda m: m == "text/html"),
            "widget_output_count": _count(F.col("mimes"), lambda m: m == WIDGET_MIME),
            "stream_outputs": _count(F.col("outputs"), lambda o: o["kind"] == "stream"),
            "error_outputs": _count(F.col("outputs"), lambda o: o["kind"] == "error"),
            **text_ratios(),
            **execution_columns(F.col("execution_counts")),
        }
    ).drop("outputs", "mimes", "cell_items", "execution_counts")


def text_ratios() -> dict[str, Column]:
    """Averages to 3 places and the markdown:code line ratio to 4 places."""
    cells, code, code_lines, prose = (F.col(c) for c in ("total_cells", "code_cells", "code_lines", "markdown_lines"))
    none = F.lit(0.0)
    return {
        "avg_cell_lines": F.when(cells > 0, F.round(F.col("total_lines") / cells, 3)).otherwise(none),
        "avg_code_cell_lines": F.when(code > 0, F.round(code_lines / code, 3)).otherwise(none),
        "markdown_to_code_ratio": F.when(code_lines > 0, F.round(prose / code_lines, 4)).otherwise(prose.cast("double")),
    }


def execution_columns(counts: Column) -> dict[str, Column]:
    """What the execution counts of a document, in cell order, say about its run."""
    n = F.size(counts)
    pairs = F.greatest(n - 1, F.lit(0))
    steps = F.zip_with(F.slice(counts, 1, pairs), F.slice(counts, 2, pairs), lambda a, b: b <= a)
    clean = F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1)).cast("bigint"))
    return {
        "executed_code_cells": n,
        "max_execution_count": F.coalesce(F.array_max(counts), F.lit(0).cast("bigint")),
        "execution_order_anomalies": F.size(F.filter(steps, lambda back: back)),
        "has_execution_gaps": (n > 0) & (F.sort_array(counts) != clean),
        "fully_executed_in_order": (n > 0) & (counts == clean),
    }


# --- step 5: imports and the whole row ---------------------------------------

def with_imports(docs: DataFrame) -> DataFrame:
    """Add ``imports`` (sorted distinct top-level names) and ``import_count``.

    ``import_sources`` holds the code cells that can name a module.  Those whose
    import statements all fill a plain line are read by line; only the others
    are handed to the syntax-tree helper, whose names are added.
    """
    unclear = F.filter("import_sources", T.needs_tree)
    staged = docs.withColumns({"exact": ast_imports(F.transform(unclear, T.strip_magics))})
    by_line = F.flatten(F.transform("import_sources", T.regex_imports))
    by_tree = F.flatten(F.filter("exact", lambda names: names.isNotNull()))
    named = F.sort_array(F.array_distinct(T.identifiers(F.concat(by_line, by_tree))))
    return staged.withColumn("imports", named).withColumn("import_count", F.size("imports")).drop("import_sources", "exact")


# --- fixed values: column names of a feature row ---
FEATURE_COLUMNS = (
    "parse_ok", "parse_error",
    "nbformat", "nbformat_minor", "kernel_name", "kernel_display_name", "language",
    "language_version", "python_version", "python_major_minor",
    "total_cells", "code_cells", "markdown_cells", "raw_cells", "other_cells", "empty_code_cells",
    "total_lines", "code_lines", "markdown_lines", "avg_cell_lines", "avg_code_cell_lines",
    "markdown_to_code_ratio", "total_source_chars",
    "executed_code_cells", "max_execution_count", "execution_order_anomalies",
    "has_execution_gaps", "fully_executed_in_order",
    "cells_with_output", "total_outputs", "image_outputs", "html_outputs", "stream_outputs",
    "error_outputs", "largest_output_bytes", "has_any_output",
    "has_widget_state", "widget_output_count",
    "cell_tag_count", "distinct_cell_tags", "has_custom_metadata", "extension_hints",
    "imports", "import_count",
)
# --- end of fixed values ---


def parse_documents(docs: DataFrame) -> DataFrame:
    """All feature columns beside the columns of ``docs`` other than ``raw``."""
    kept = [c for c in docs.columns if c != "raw"]
    staged = with_tallies(with_cells(with_metadata(read_json(docs)).drop("raw")))
    return with_imports(staged).select(*kept, *FEATURE_COLUMNS)


def flat_row(features: DataFrame) -> DataFrame:
    """Lists as sorted ``;``-joined text, the shape rows are stored in."""
    lists = ("distinct_cell_tags", "extension_hints", "imports")
    return features.withColumns({c: T.joined(F.col(c)) for c in lists})
