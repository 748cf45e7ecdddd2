"""Ranks, false discovery rates, ranking metrics and resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from assocframe.functions import numeric as m
from assocframe.operators.profile import average_ranks


def rank_min_desc(df: DataFrame, key: list[str], by: str, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.rank().over(Window.partitionBy(*key).orderBy(F.col(by).desc_nulls_last())))


def rank_first(df: DataFrame, key: list[str], by: str, tie: str, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(F.col(by).desc_nulls_last(), F.col(tie))))


def top_k(df: DataFrame, key: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= k)


def bh_fdr(df: DataFrame, key: list[str], p: str, tie: str, name: str = "q") -> DataFrame:
    """Benjamini-Hochberg within a key: p * m / rank, then the running minimum
    from the largest p, 1 at most; a null p keeps a null."""
    w = Window.partitionBy(*key, F.col(p).isNull())
    ranked = df.withColumn("_n", F.count(p).over(w)).withColumn("_r", F.row_number().over(w.orderBy(p, tie)))
    raw = ranked.withColumn("_q", F.col(p) * F.col("_n") / F.col("_r"))
    back = w.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return raw.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.min("_q").over(back), F.lit(1.0)))).drop("_n", "_r", "_q")


def ndcg(df: DataFrame, key: list[str], actual: str, predicted: str, tie: str, k: int) -> DataFrame:
    """Gain is the value over the group's least; null under two rows or where
    all are equal."""
    w = Window.partitionBy(*key)
    d = df.withColumn("_g", F.col(actual) - F.min(actual).over(w)).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_top", F.max(actual).over(w) - F.min(actual).over(w))
    d = d.withColumn("_a", F.row_number().over(w.orderBy(F.desc(actual), tie))).withColumn("_p", F.row_number().over(w.orderBy(F.desc(predicted), tie)))
    gain = lambda c: F.sum(F.when(F.col(c) <= k, F.col("_g") / F.log2(F.col(c) + 1.0)))
    return d.groupBy(*key).agg(F.when((F.max("_n") >= 2) & (F.max("_top") > 0), gain("_p") / F.nullif(gain("_a"), F.lit(0.0))).alias(f"ndcg_{k}"))


def top_overlap(df: DataFrame, key: list[str], actual: str, predicted: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(*key)
    d = df.withColumn("_a", F.row_number().over(w.orderBy(F.desc(actual), tie))).withColumn("_p", F.row_number().over(w.orderBy(F.desc(predicted), tie)))
    return d.groupBy(*key).agg((F.count_if((F.col("_a") <= k) & (F.col("_p") <= k)) / F.least(F.count(F.lit(1)), F.lit(k))).alias(f"overlap_{k}"))


def top1_hit(df: DataFrame, key: list[str], actual: str, predicted: str) -> DataFrame:
    """Whether the sets of largest actual and largest predicted rows meet."""
    w = Window.partitionBy(*key)
    return df.withColumn("_hit", (F.col(actual) == F.max(actual).over(w)) & (F.col(predicted) == F.max(predicted).over(w))).groupBy(*key).agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("top1"))


def regression_metrics(df: DataFrame, key: list[str], actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE, R2, mean absolute rank error, Pearson and Spearman."""
    w = Window.partitionBy(*key)
    d = average_ranks(df, key, [actual, predicted]).withColumn("_m", F.avg(actual).over(w))
    e = F.col(actual) - F.col(predicted)
    return d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.sum((F.col(actual) - F.col("_m")) * (F.col(actual) - F.col("_m"))))).alias("r2"),
        F.avg(F.abs(F.col(f"r_{actual}") - F.col(f"r_{predicted}"))).alias("rank_error"), m.pearson(F.col(actual), F.col(predicted)).alias("pearson"), m.pearson(F.col(f"r_{actual}"), F.col(f"r_{predicted}")).alias("spearman"),
    )


def bootstrap(df: DataFrame, key: list[str], value: str, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """Mean and its percentile interval by resampling each key's few values,
    with numpy's generator, so results repeat exactly."""

    def draw(g: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(g[value].dropna().to_numpy(float))
        means = x[np.random.default_rng(seed).integers(0, len(x), (rounds, len(x)))].mean(axis=1) if len(x) else np.full(1, np.nan)
        return pd.DataFrame({**{k: [g[k].iloc[0]] for k in key}, "n": [len(x)], "mean": [x.mean() if len(x) else None], "low": [np.quantile(means, 0.025)], "high": [np.quantile(means, 0.975)]})

    kinds = dict(df.dtypes)
    return df.select(*key, value).groupBy(*key).applyInPandas(draw, ", ".join([*(f"{k} {kinds[k]}" for k in key), "n long, mean double, low double, high double"]))


def permutation(df: DataFrame, key: list[str], actual: str, predicted: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """(k + 1) / (n + 1): how often shuffled predictions correlate as well."""

    def shuffle(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna().sort_values([actual, predicted])
        x, y = g[actual].rank().to_numpy(), g[predicted].rank().to_numpy()
        row = {k: [g[k].iloc[0] if len(g) else None] for k in key}
        if len(x) < 3 or x.std() == 0 or y.std() == 0:
            return pd.DataFrame(row | {"rho": [None], "p": [None]})
        x, y = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
        seen, rng = (x * y).mean(), np.random.default_rng(seed)
        null = np.array([(x * rng.permutation(y)).mean() for _ in range(rounds)])
        return pd.DataFrame(row | {"rho": [seen], "p": [((null >= seen - 1e-12).sum() + 1) / (rounds + 1)]})

    kinds = dict(df.dtypes)
    return df.select(*key, actual, predicted).groupBy(*key).applyInPandas(shuffle, ", ".join([*(f"{k} {kinds[k]}" for k in key), "rho double, p double"]))
