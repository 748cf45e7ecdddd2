"""Heritability from LD-score regression, with errors by a block jackknife, and its
liability form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from assocframe.functions import numeric as m, stats as st
from assocframe.runtime import positions

#: The median of chi-squared with one degree of freedom (fixed value).
MEDIAN_CHI2 = 0.454936423119572
_CELL = 1_000_000
_SUMS = ("_w", "_x", "_y", "_xx", "_xy", "_m")


def chromosome_order(c: Column) -> Column:
    """1 to 22, then X, Y and MT; others after them."""
    named = F.upper(c)
    return F.coalesce(F.when(named == "X", 23).when(named == "Y", 24).when(named.isin("M", "MT"), 25), c.try_cast("int"), F.lit(99))


def liability(h2: Column, case_share: Column, prevalence: Column) -> Column:
    """h2 of a binary trait on the scale of liability, from that of a sample with a
    share of cases and the population's prevalence; null outside (0, 1)."""
    inside = (prevalence > 0) & (prevalence < 1) & (case_share > 0) & (case_share < 1)
    k = F.when(inside, prevalence)
    at = st.normal_quantile(1 - k)
    density = F.exp(-at * at / 2) / math.sqrt(2 * math.pi)
    return h2 * k * k * (1 - k) * (1 - k) / (case_share * (1 - case_share) * density * density)


def _slope(s: dict[str, Column]) -> tuple[Column, Column]:
    spread = s["_w"] * s["_xx"] - s["_x"] * s["_x"]
    slope = F.when(spread > 1e-12 * s["_w"] * s["_xx"], (s["_w"] * s["_xy"] - s["_x"] * s["_y"]) / spread)  # null where x doesn't vary
    return slope, F.try_divide(s["_y"] - slope * s["_x"], s["_w"])


def ld_score_regression(df: DataFrame, key: list[str], order: list[str], blocks: int = 200) -> DataFrame:
    """Per key: h2 and intercept of chi2 on N * ld / variants, their errors, the
    ratio (intercept - 1) / (mean chi2 - 1) with its error, mean chi2, lambda and
    median N * h2. Rows need ld, chi2, N and the columns of `order` (chromosome,
    position, then what makes the order unique).

    Weights are 1 / (max(ld, 1) (1 + N h2 ld / variants)**2) with the h2 of the means,
    (mean chi2 - 1) / mean(N ld / variants), within 0 and 1. Errors come from leaving
    out each of `blocks` runs of neighbours with equal numbers of rows: one row of sums
    for a block, and from what precedes and follows it the sums without it, so nothing
    is subtracted. Rows of a key meet only by cells of a million bases. Rows without
    ld, chi2 or N are left out; errors are null for fewer than two blocks with rows."""
    known = df.where("ld is not null and chi2 is not null and N is not null").select(*key, *order, F.col("ld").cast("double").alias("ld"), F.col("chi2").cast("double").alias("chi2"), F.col("N").cast("double").alias("N"))
    least = F.greatest("ld", F.lit(1.0))
    per = known.groupBy(*key).agg(F.count(F.lit(1)).alias("variants"), F.avg("chi2").alias("mean_chi2"), F.avg(F.col("N") * F.col("ld")).alias("_nl"), m.median(F.col("chi2")).alias("_median"), m.median(F.col("N")).alias("_n"))
    per = per.withColumn("_start", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((F.col("mean_chi2") - 1) * F.col("variants"), F.col("_nl")), F.lit(0.0)))))
    chromosome, position = order[:2]
    cells = known.withColumn("_chr", chromosome_order(F.col(chromosome))).withColumn("_cell", F.floor(F.col(position) / _CELL))
    rows = positions(cells, key, ["_chr", "_cell"], [F.col(c) for c in order[1:]], "_rank").join(per.select(*key, "variants", "_start"), key)
    x = F.col("N") * F.col("ld") / F.col("variants")
    w = 1.0 / (least * F.pow(1 + F.col("_start") * x, 2))
    block = F.floor((F.col("_rank") - 1) * blocks / F.col("variants"))
    sums = rows.select(*key, block.alias("_block"), w.alias("_w"), x.alias("_u"), "chi2").groupBy(*key, "_block")
    v, y, u = F.col("_w"), F.col("chi2"), F.col("_u")
    parts = sums.agg(F.sum(v).alias("_w"), F.sum(v * u).alias("_x"), F.sum(v * y).alias("_y"), F.sum(v * u * u).alias("_xx"), F.sum(v * u * y).alias("_xy"), F.count(F.lit(1)).cast("double").alias("_m"))
    run = Window.partitionBy(*key).orderBy("_block")  # `blocks` rows at most
    before, after = run.rowsBetween(Window.unboundedPreceding, -1), run.rowsBetween(1, Window.unboundedFollowing)
    without = {c: F.coalesce(F.sum(c).over(before), F.lit(0.0)) + F.coalesce(F.sum(c).over(after), F.lit(0.0)) for c in _SUMS}
    parts = parts.select(*key, *_SUMS, *[k.alias(f"{c}_out") for c, k in without.items()])
    left_out = _slope({c: F.col(f"{c}_out") for c in _SUMS})
    parts = parts.select(*key, *_SUMS, *[k.alias(c) for c, k in zip(("_h", "_i"), left_out, strict=True)])
    n = F.count(F.lit(1))
    spread = lambda c: F.when(n > 1, (n - 1) * F.sqrt(F.var_samp(c) / n))  # noqa: E731  of the pseudo-values n * all - (n - 1) * without
    whole = parts.groupBy(*key).agg(*[F.sum(c).alias(c) for c in _SUMS], spread("_h").alias("h2_se"), spread("_i").alias("intercept_se"))
    h2, intercept = _slope({c: F.col(c) for c in _SUMS})
    out = whole.withColumn("h2", h2).withColumn("intercept", intercept).join(per, key)
    excess = F.col("mean_chi2") - 1
    return out.select(
        *key,
        "variants",
        "h2",
        "h2_se",
        "intercept",
        "intercept_se",
        F.try_divide(F.col("intercept") - 1, excess).alias("ratio"),
        F.try_divide(F.col("intercept_se"), F.abs(excess)).alias("ratio_se"),
        "mean_chi2",
        (F.col("_median") / MEDIAN_CHI2).alias("lambda_gc"),
        (F.col("_n") * F.col("h2")).alias("n_times_h2"),
    )
