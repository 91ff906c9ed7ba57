"""Import names of code cells: syntax tree where it parses, line patterns always."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tree_reader():
    """The helper run in Python workers.  It is built inside a function so that
    Spark ships it by value and executors need no copy of this package."""
    import ast
    import warnings

    def names_in(source: str) -> list[str] | None:
        """Absolute imports of one source text, null when it does not parse."""
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                nodes = list(ast.walk(ast.parse(source)))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None
        dotted = [a.name for n in nodes if isinstance(n, ast.Import) for a in n.names]
        dotted += [n.module for n in nodes if isinstance(n, ast.ImportFrom) and n.module and not n.level]
        return sorted({name.partition(".")[0] for name in dotted})

    return names_in


def ast_imports(sources: Column) -> Column:
    """ARRAY of sources to ARRAY of name lists; null where a source is not valid."""
    names_in = tree_reader()

    def per_source(batch: pd.Series) -> pd.Series:
        return batch.map(lambda cells: [names_in(s) for s in cells])

    return F.pandas_udf(per_source, "array<array<string>>")(sources)
