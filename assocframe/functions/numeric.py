"""Guarded arithmetic and statistics as Columns: parsing, percentages, exact
quantiles, correlations and bias-corrected moments. Zero denominators, constant
columns and too few rows give null (percentages: 0), never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def parse_number(c: Column) -> Column:
    """A text as a double, or null; no suffixes, NaN or infinities."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def clean_number(c: Column) -> Column:
    """A text from a report: missing tokens, yes and no, thousands and percent
    signs."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "yes"), 1.0).when(t.isin("false", "no"), 0.0).otherwise(parse_number(F.regexp_replace(t, "[,%]", "")))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole, and 0 for an empty whole."""
    return F.coalesce(100.0 * part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def rate(flag: Column, among: Column | None = None) -> Column:
    """Aggregate: the percentage of rows (of those in `among`) with a flag."""
    among = F.lit(True) if among is None else among
    return pct(F.count_if(among & flag), F.count_if(among))


def median(c: Column) -> Column:
    return F.percentile(c, 0.5)


def quantile(c: Column, q: float) -> Column:
    """Aggregate: the exact quantile, interpolated."""
    return F.percentile(c, q)


def pearson(x: Column, y: Column, least: int = 3) -> Column:
    """Aggregate: Pearson's r over complete pairs; null under `least` pairs or
    for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when(F.count(a) >= least, F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)))


def skewness(c: Column) -> Column:
    """Aggregate: the bias-corrected skewness; null under three rows."""
    n = F.count(c).cast("double")
    return F.when((n >= 3) & (F.stddev_samp(c) > 0), F.skewness(c) * F.sqrt(F.greatest(n * (n - 1), F.lit(0.0))) / F.nullif(n - 2, F.lit(0.0)))


def kurtosis(c: Column) -> Column:
    """Aggregate: the bias-corrected excess kurtosis; null under four rows."""
    n = F.count(c).cast("double")
    return F.when((n >= 4) & (F.stddev_samp(c) > 0), (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(c) + 6))


def effective_n(cases: Column, controls: Column) -> Column:
    return F.when((cases > 0) & (controls > 0), 4.0 / (1.0 / cases + 1.0 / controls))


def neg_log10(p: Column) -> Column:
    return F.when(p > 0, -F.log10(p))
