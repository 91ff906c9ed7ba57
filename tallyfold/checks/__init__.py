"""The registered queries: census operators bound to the shared test tables,
each beside an independent SQL statement of the same result."""

from tallyfold.checks import aggregation, conversations, parsing, sampling, spans, storage  # noqa: F401
from tallyfold.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
