"""Rounding and rating expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrail.lookups import LOWEST_RATING, RATING_BANDS


def exact_round(x: Column, digits: int) -> Column:
    """Round a double on its exact binary value, ties to even.

    ``round`` and ``bround`` look at the shortest decimal form, so 2.675 (whose binary
    value is a little below the tie) would go up. Near a tie the sign of
    ``x * 10^(digits+1) - tie`` decides; it is exact because x is split into two halves
    whose products are.
    """
    x = x.cast("double")
    scale, unit = F.lit(float(10 ** (digits + 1))), F.lit(float(10**digits))
    nearest = F.rint(x * scale)
    carry = x * F.lit(134217729.0)  # 2^27 + 1
    high = carry - (carry - x)
    error = (high * scale - nearest) + (x - high) * scale
    tie = (F.abs(nearest) % F.lit(10.0) == F.lit(5.0)) & (F.abs(error) < F.lit(0.25))
    below = F.floor(nearest / F.lit(10.0)).cast("double")
    return (
        F.when(tie & (error > 0), (below + 1.0) / unit)
        .when(tie & (error < 0), below / unit)
        .otherwise(F.bround(x, digits))
    )


def rating(score: Column) -> Column:
    """Letter for a score in [0, 10]."""
    (top, letter), *others = RATING_BANDS
    band = F.when(score >= top, F.lit(letter))
    for floor, letter in others:
        band = band.when(score >= floor, F.lit(letter))
    return band.otherwise(F.lit(LOWEST_RATING))
