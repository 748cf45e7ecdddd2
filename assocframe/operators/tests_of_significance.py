"""Significance of statistics: Student's t, chi-squared and signed ranks. The
statistics come from grouped aggregates; only their distribution functions run
in Python, an Arrow batch at a time."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from assocframe.functions import numeric as m
from assocframe.functions.stats import two_sided_p


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for k in range(1, 300):
        for up in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1 / (1 + up * d)
            c = 1 + up / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, dof: float) -> float:
    return float("nan") if not (dof > 0 and math.isfinite(t)) else incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def chi2_tail(x: float, dof: int) -> float:
    """The upper tail for an even number of degrees, a finite sum."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, dof // 2):
        term *= half / k
        total += term
    return math.exp(-half) * total


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else t_two_sided(float(a), float(b)) for a, b in zip(t, dof, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def even_chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else chi2_tail(float(a), int(b)) for a, b in zip(x, dof, strict=True)], dtype=float)


def correlation_p(r: Column, n: Column) -> Column:
    """Of a correlation of n pairs."""
    return t_p(r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0))), (n - 2).cast("double"))


def one_sample_t(df: DataFrame, key: list[str], value: str, mean: float = 0.0) -> DataFrame:
    x = F.col(value)
    out = df.groupBy(*key).agg(F.count(x).alias("n"), F.try_divide((F.avg(x) - mean) * F.sqrt(F.count(x)), F.stddev_samp(x)).alias("t"))
    return out.withColumn("p", t_p(F.col("t"), (F.col("n") - 1).cast("double")))


def fisher(df: DataFrame, key: list[str], p: str) -> DataFrame:
    out = df.where(F.col(p) > 0).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), (-2 * F.sum(F.log(p))).alias("chi2"))
    return out.withColumn("p", even_chi2_p(F.col("chi2"), 2 * F.col("n")))


def signed_ranks(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Wilcoxon's signed-rank test against zero: zeros are left out, ties have
    average ranks, and p is the normal approximation with their correction."""
    x = F.col(value)
    d = df.where(x.isNotNull() & (x != 0)).withColumn("_a", F.abs(x))
    tie = F.count(F.lit(1)).over(Window.partitionBy(*key, "_a"))
    d = d.withColumn("_t", tie).withColumn("_r", F.rank().over(Window.partitionBy(*key).orderBy("_a")) + (tie - 1) / 2.0)
    out = d.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(x > 0, F.col("_r"))), F.lit(0.0)).alias("w"), F.sum((F.col("_t") * F.col("_t") - 1).cast("double")).alias("ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    z = F.try_divide(F.col("w") - n * (n + 1) / 4, spread)
    return out.select(*key, "n", "w", z.alias("z"), two_sided_p(z).alias("p"))


def ld_score_regression(df: DataFrame, key: list[str]) -> DataFrame:
    """Slope and intercept of chi2 on LD score, weighted by 1 / max(LD, 1); h2 is
    slope * variants / N. One grouped pass over sums."""
    w = 1.0 / F.greatest("ld", F.lit(1.0))
    x, y = F.col("ld"), F.col("chi2")
    s = df.where(x.isNotNull() & y.isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("variants"), F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), m.median(F.col("N")).alias("n"))
    slope = F.try_divide(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    out = s.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw"))
    return out.select(*key, "variants", "slope", "intercept", (F.col("slope") * F.col("variants") / F.col("n")).alias("h2"))


def lift(places: DataFrame, blocks: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Positions in another build by blocks (CHR, start, end, to_chr, shift): a
    range join on bins of `width`. A block lists the bins it touches, a place
    looks in its own, so each place meets only the blocks of its bin."""
    binned = blocks.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    at = places.withColumn("_bin", F.floor(F.col("POS") / width))
    hit = (at.POS >= F.col("start")) & (at.POS < F.col("end"))
    out = at.join(binned, (at.CHR == binned.CHR) & (at._bin == binned._bin) & hit, "left")
    return out.select(*[at[c] for c in places.columns], "to_chr", (at.POS + F.col("shift")).alias("to_pos"))


