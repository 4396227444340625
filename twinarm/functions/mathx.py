"""Numeric column helpers that Spark SQL has no built-in for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 26.2.17 coefficients; absolute error below 7.5e-8.
NORMAL_CDF_P = 0.2316419
NORMAL_CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal for z >= 0."""
    t = 1.0 / (1.0 + NORMAL_CDF_P * z)
    poly = F.lit(0.0)
    for b in reversed(NORMAL_CDF_B):
        poly = (poly + F.lit(b)) * t
    return F.exp(-z * z / 2.0) / F.sqrt(2.0 * F.pi()) * poly


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value, at most 1."""
    return F.least(F.lit(1.0), 2.0 * upper_tail(F.abs(z)))


def logit(p: Column) -> Column:
    return F.log(p) - F.log(1.0 - p)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL instead of failing where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
