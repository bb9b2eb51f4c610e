"""Statistical expressions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the normal distribution (Abramowitz and Stegun 26.2.17).
NORMAL_P = 0.2316419
NORMAL_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function, within 1e-7."""
    z = F.abs(x)
    t = 1 / (1 + F.lit(NORMAL_P) * z)
    poly = F.lit(0.0)
    for b in reversed(NORMAL_B):
        poly = (poly + F.lit(b)) * t
    tail = F.exp(-z * z / 2) / F.sqrt(F.lit(2.0) * F.pi()) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(x: str) -> str:
    """The same as DuckDB text."""
    t = f"(1 / (1 + {NORMAL_P}::DOUBLE * abs({x})))"
    poly = "0.0::DOUBLE"
    for b in reversed(NORMAL_B):
        poly = f"(({poly} + {b}::DOUBLE) * {t})"
    tail = f"exp(-abs({x}) * abs({x}) / 2) / sqrt(2.0::DOUBLE * pi()) * {poly}"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


def wald(mean: Column, null: Column, error: Column) -> Column:
    return F.try_divide(mean - null, error)


def wald_p(stat: Column, sided: int = 1) -> Column:
    """1 - Phi(|w|), twice that for two sides."""
    return sided * (1 - normal_cdf(F.abs(stat)))


def chi2_p(stat: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return 2 * (1 - normal_cdf(F.sqrt(stat)))


def shrunk(n: Column, own: Column, overall: Column, least: int = 3) -> Column:
    """A leave-one-out statistic: the overall one without other ratings, half of both below ``least``, else its own."""
    return F.when(n == 0, overall).when(n < least, (overall + own) / 2).otherwise(own)


def amplify(similarity: Column, power: float = 2.5) -> Column:
    return similarity * F.pow(F.abs(similarity), F.lit(power - 1))


def months_since(start: Column, end: Column) -> Column:
    """Whole days over 30, halves to even."""
    return F.bround(F.floor((end.cast("timestamp").cast("long") - start.cast("timestamp").cast("long")) / 86400) / 30, 0).cast("int")
