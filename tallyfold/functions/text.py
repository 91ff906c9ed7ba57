"""Text measures over whole strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns (what counts as a magic line, import or version) ---
# Python's \s, \w and line ends are spelled for Java's regex engine: (?d) makes \n
# the only line end, (?U) widens \s and \w, and the four separators 1C-1F are
# white space in Python only.
SPACE = r"[\s\x1c-\x1f]"
MAGIC_LINE = rf"(?mdU)^{SPACE}*[%!].*$"
IMPORT_LINE = (
    rf"(?mdU)^{SPACE}*(?:import{SPACE}+([a-zA-Z_][\w.]*)"
    rf"|from{SPACE}+([a-zA-Z_][\w.]*){SPACE}+import)"
)
IMPORT_NAME = rf"(?dU)^{SPACE}*(?:import|from){SPACE}+([a-zA-Z_][\w.]*)"
IDENTIFIER = r"(?U)^[^\W\d]\w*$"
VERSION = r"(\d+\.\d+(?:\.\d+)?)"
# --- end of fixed values ---
HAS_TEXT = r"(?U)[^\s\x1c-\x1f]"
# A line that holds one import statement and nothing a syntax tree would read
# differently, or a magic line.
PLAIN_LINE = (
    r"(?md)^[ \t]*(?:import[ \t]+[A-Za-z_][A-Za-z0-9_.]*(?:[ \t]+as[ \t]+[A-Za-z_][A-Za-z0-9_]*)?[ \t]*(?:#.*)?"
    r"|from[ \t]+[A-Za-z_][A-Za-z0-9_.]*[ \t]+import[ \t][^;\n]*|[%!].*)$"
)


def line_count(text: Column) -> Column:
    """Lines of a text, ignoring newlines at its end; empty text has none."""
    body = F.rtrim(text, F.lit("\n"))
    breaks = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))
    return F.when(body == "", F.lit(0)).otherwise(breaks + 1)


def is_blank(text: Column) -> Column:
    return ~text.rlike(HAS_TEXT)


def version_in(text: Column) -> Column:
    """First ``d.d`` or ``d.d.d`` in a text, null when there is none."""
    return F.nullif(F.regexp_extract(text, VERSION, 1), F.lit(""))


def major_minor(version: Column) -> Column:
    return F.substring_index(version, ".", 2)


def top_level(module: Column) -> Column:
    return F.substring_index(module, ".", 1)


def strip_magics(source: Column) -> Column:
    """Blank out shell and magic lines (first visible character % or !)."""
    return F.regexp_replace(source, MAGIC_LINE, "")


def regex_imports(source: Column) -> Column:
    """Top-level names of import lines: the first name of each statement."""
    statements = F.regexp_extract_all(source, F.lit(IMPORT_LINE), F.lit(0))
    named = F.transform(statements, lambda piece: F.regexp_extract(piece, IMPORT_NAME, 1))
    return F.array_distinct(F.transform(named, top_level))


def needs_tree(source: Column) -> Column:
    """Whether a syntax tree may name a module that the line patterns do not.

    It cannot when, apart from plain lines, the source has no ``import`` and no
    line that begins with ``from``, and no character that joins or ends lines
    in another way than a newline.
    """
    rest = F.regexp_replace(source, PLAIN_LINE, "")
    other_ends = source.contains("\\") | source.contains("\r") | source.contains("\f")
    return other_ends | rest.contains("import") | rest.rlike(r"(?md)^\s*from\s")


def identifiers(names: Column) -> Column:
    return F.filter(names, lambda m: m.rlike(IDENTIFIER))


def joined(values: Column) -> Column:
    """A list as sorted text with ``;`` between the items."""
    return F.array_join(F.sort_array(values), ";")


def dumped_length(compact: Column) -> Column:
    """Length of a JSON value when written with ``, `` and ``: `` separators and
    ASCII escapes, worked out from its compact form without re-serialising."""
    no_escapes = F.when(compact.contains("\\"), F.regexp_replace(compact, r"(?s)\\.", "")).otherwise(compact)
    outside = F.regexp_replace(no_escapes, r'"[^"]*"', "")
    separators = F.length(outside) - F.length(F.translate(outside, ",:", ""))
    beyond_ascii = F.length(F.regexp_replace(compact, r"[\x00-\x7e]+", ""))
    beyond_bmp = F.length(F.regexp_replace(compact, r"[^\x{10000}-\x{10ffff}]+", ""))
    escapes = F.when((F.octet_length(compact) > F.length(compact)) | compact.contains("\x7f"), beyond_ascii * 5 + beyond_bmp * 6).otherwise(F.lit(0))
    return (F.length(compact) + separators + escapes).cast("bigint")
