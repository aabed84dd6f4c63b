"""Rounding to four decimals, half to even.

The two kinds differ only where the exact quotient lies half-way between two
results: table percentages and means round the scaled double, shares round the
quotient's double without scaling it first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = 10_000
_HIGH_BITS = float(2**30)


def round4(value: Column) -> Column:
    """Scale, round half to even, scale back."""
    return F.rint(value * _SCALE) / _SCALE


def share4(part: Column, whole: Column) -> Column:
    """``part / whole`` rounded as a correctly rounded decimal; NULL for an empty whole.

    If ``part / whole`` is exactly half-way, the double that stands for it lies
    a little above, below or on that point. Its upper 30 bits and the rest are
    multiplied separately, which is exact, so the sign of the error is known.
    """
    whole = F.nullif(whole.cast("bigint"), F.lit(0).cast("bigint"))
    part = part.cast("bigint")
    quotient = part / whole
    doubled = part * (2 * _SCALE)
    odd_steps = F.rint(doubled / whole)  # quotient in half-steps
    half_way = (doubled % whole == 0) & (odd_steps % 2 == 1)
    high = F.floor(quotient * _HIGH_BITS) / _HIGH_BITS
    error = (high * (2 * _SCALE) - odd_steps) + (quotient - high) * (2 * _SCALE)
    below = (odd_steps - 1) / 2
    step = (
        F.when(error > 0, below + 1)
        .when(error < 0, below)
        .otherwise(below + below % 2)
    )
    return F.when(half_way, step / _SCALE).otherwise(round4(quotient))
