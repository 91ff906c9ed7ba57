"""Rounding that does not depend on the order rows arrive in.

Means and shares are taken over whole numbers (a 4-place score is counted in
ten-thousandths), so partial sums are exact wherever they are merged, and a
half in the last place is exactly representable when it is rounded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled(col: Column, places: int) -> Column:
    """A value with at most ``places`` decimals as a whole number of units."""
    if places == 0:
        return col.cast("bigint")
    return F.round(col * F.lit(float(10**places)), 0).cast("bigint")


def ratio(numerator: Column, denominator: Column, places: int, factor: int = 1) -> Column:
    """``factor * numerator / denominator`` half-up at ``places``; null when empty."""
    units = (numerator * F.lit(factor * 10**places)).cast("double")
    value = F.round(units / denominator.cast("double"), 0) / F.lit(float(10**places))
    return F.when(denominator > 0, value)


def mean_of(col: Column, held: int, places: int) -> Column:
    """Aggregate: mean of a column that holds ``held`` decimals, kept to ``places``."""
    total, n = F.sum(scaled(col, held)), F.count(col)
    units = (total * F.lit(10 ** (places - held))).cast("double")
    return F.when(n > 0, F.round(units / n.cast("double"), 0) / F.lit(float(10**places)))


def median_of(col: Column, held: int, places: int) -> Column:
    """Aggregate: exact, interpolating median of a bounded-domain column.

    The buffer holds one counter per distinct value.  Callers use it on scores
    (at most 10,001 values) and cell counts (bounded by the file size limit).
    """
    middle = F.median(scaled(col, held)) * F.lit(float(10 ** (places - held)))
    return F.round(middle, 0) / F.lit(float(10**places))


def weighted(*terms: tuple[str, Column]) -> Column:
    """Sum of weight * term in DECIMAL, clipped to [0, 1], half-up at 4 places.

    Each weight is decimal text.  Terms arrive already rounded to 4 places or
    as :func:`share` (12 places), so the sum is exact before it is rounded.
    """
    total = None
    for weight, term in terms:
        part = F.lit(weight).cast("decimal(4,2)") * term
        total = part if total is None else total + part
    return clip01(total)


def clip01(value: Column) -> Column:
    """Clip to [0, 1] and keep 4 places."""
    bounded = F.greatest(F.lit(0).cast("decimal(20,12)"), F.least(F.lit(1).cast("decimal(20,12)"), value))
    return F.round(bounded, 4).cast("double")


def as_share(value: Column) -> Column:
    """An unrounded fraction as a 12-place decimal term."""
    return value.cast("decimal(20,12)")


def as_term(value: Column) -> Column:
    """A 4-place value as a decimal term."""
    return value.cast("decimal(10,4)")


def flag(condition: Column) -> Column:
    """1 or 0 as a decimal term; null counts as 0."""
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(1)).otherwise(F.lit(0)).cast("decimal(10,4)")


def saturating(value: Column, scale: float) -> Column:
    """``1 - exp(-value/scale)`` kept to 4 places, 0 for values <= 0."""
    grown = F.round(F.lit(1.0) - F.exp(-(value.cast("double")) / F.lit(float(scale))), 4)
    return F.when(value > 0, grown).otherwise(F.lit(0.0))
