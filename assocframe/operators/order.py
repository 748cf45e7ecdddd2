"""Exact order statistics, ranks and Kendall's tau of groups of any size.

Two passes give an exact rank without a sort of a group in one task: a mergeable
sketch proposes bounds that cut each group into cells of about equal numbers of rows,
then values are counted, and a value's place is the sum of what precedes its cell and
what precedes it within. Equal values are one row from the first shuffle on, so a value
of a third of all rows is no hot key. Results don't depend on how good the bounds are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Cells of a group; a task sorts the distinct values of one.
CELLS = 256
#: Rows of a cell at least, as far as the bounds go.
LEAST = 1 << 12
#: Rows of a block of Kendall's counting, and blocks at most.
ROWS, BLOCKS = 1 << 17, 256


def placed(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value, n, before, total): for each distinct value of a key its number of
    rows, the number of rows with smaller values, and of all. Nulls are left out."""
    known = df.where(F.col(value).isNotNull()).select(*key, value)
    cuts = [i / CELLS for i in range(1, CELLS)]
    bounds = known.groupBy(*key).agg(F.percentile_approx(value, F.array(*[F.lit(c) for c in cuts]), F.lit(20 * CELLS)).alias("_all"), F.count(F.lit(1)).alias("_rows"))
    # small groups have fewer cells: every so-manieth bound
    wide = F.greatest(F.lit(1), F.floor(CELLS * F.lit(LEAST) / F.col("_rows"))).cast("int")
    bounds = bounds.select(*key, F.filter("_all", lambda _, i: (i + 1) % wide == 0).alias("_cuts"))
    counted = known.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    steps = F.array(*[F.lit(1 << i) for i in range((CELLS - 1).bit_length() - 1, -1, -1)])
    # how many bounds are below the value, by halves
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("_cuts", at + step - 1) < F.col(value), step).otherwise(0))
    rows = _join(counted, bounds, key).withColumn("_cell", below).drop("_cuts")
    run = Window.partitionBy(*key).orderBy("_cell")  # CELLS rows at most
    cells = rows.groupBy(*key, "_cell").agg(F.sum("n").alias("_m"))
    cells = cells.select(*key, "_cell", (F.sum("_m").over(run) - F.col("_m")).alias("_first"), F.sum("_m").over(Window.partitionBy(*key)).alias("total"))
    inside = Window.partitionBy(*key, "_cell").orderBy(value)
    rows = rows.withColumn("_within", F.sum("n").over(inside) - F.col("n"))
    return _join(rows, cells, [*key, "_cell"]).select(*key, value, "n", (F.col("_first") + F.col("_within")).alias("before"), "total")


def _join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which null keys are equal."""
    other = right.select(*[F.col(c).alias(f"_on_{i}") for i, c in enumerate(on)], *[c for c in right.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(f"_on_{i}")) for i, c in enumerate(on)]
    return left.join(other, same).drop(*[f"_on_{i}" for i in range(len(on))])


def at_places(df: DataFrame, key: list[str], value: str, places: dict[str, Callable[[Column], Column]], read: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """(key, total, ...): per key read(value) at the given places, which are functions of
    the number of rows (the smallest value is at 0); between two rows by their share."""
    n = F.col("total")
    here = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), read(F.col(value))))
    out = []
    for name, place in places.items():
        low, high, part = here(F.floor(place(n))), here(F.ceil(place(n))), F.max(place(n) - F.floor(place(n)))
        out.append((low + (high - low) * part).alias(name))
    return placed(df, key, value).groupBy(*key).agg(F.max("total").alias("total"), *out)


def quantiles(df: DataFrame, key: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(key, total, ...): linear between rows, as percentile() has it."""
    return at_places(df, key, value, {name: (lambda n, q=q: (n - 1) * q) for name, q in shares.items()})


def average_ranks(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """df with r_<column>: ranks from 1 within the key, ties averaged; null for nulls.
    Rows of one value meet in a join, which is split where they are many."""
    given = df
    for c in columns:
        ranks = placed(given, key, c).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(c).alias("_v"), (F.col("before") + (F.col("n") + 1) / 2.0).alias(f"r_{c}"))
        same = [F.col(c) == F.col("_v"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]]
        df = df.join(ranks, same, "left").drop("_v", *[f"_k{i}" for i in range(len(key))])
    return df


def inversions(y: np.ndarray, n: np.ndarray, base: int = 64) -> int:
    """The sum of n[i] * n[j] over i < j with y[i] > y[j], by merging sorted runs."""
    size = -(-len(y) // base) * base
    y, n = np.append(np.asarray(y, float), np.full(size - len(y), np.inf)), np.append(np.asarray(n, np.int64), np.zeros(size - len(n), np.int64))
    total, upper = 0, np.triu(np.ones((base, base), bool), 1)
    for k in range(0, size, base * 256):
        a, w = y[k : k + base * 256].reshape(-1, base), n[k : k + base * 256].reshape(-1, base)
        total += int(np.einsum("kij,ki,kj->", (a[:, :, None] > a[:, None, :]) & upper, w, w))
    order = np.argsort(y.reshape(-1, base), axis=1, kind="stable") + np.arange(0, size, base)[:, None]
    y, n = y[order.ravel()], n[order.ravel()]
    while base < size:
        for k in range(0, size - base, 2 * base):
            left, right = slice(k, k + base), slice(k + base, min(k + 2 * base, size))
            run = np.append(0, np.cumsum(n[left]))
            total += int(((run[-1] - run[np.searchsorted(y[left], y[right], "right")]) * n[right]).sum())
            both = np.argsort(y[k : right.stop], kind="stable") + k
            y[k : right.stop], n[k : right.stop] = y[both], n[both]
        base *= 2
    return total


def kendall(df: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """(key, n, tau): Kendall's tau-b over complete pairs, null where x or y is constant.

    Discordant pairs are counted in three parts. Rows lie in blocks by x and bins by y.
    Pairs of different blocks and bins follow from the counts of cells; those of one
    block, and those of one bin in different blocks, are inversions of a task's own
    sequence. Equal pairs are one row; a value of more than a block's rows is a block (by
    y's bins) or bin of its own, so no task has more than a block's rows, or two."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*key, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_w"))
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*key, F.col(x).alias("_x"), F.col(y).alias("_y"))
    many = lambda n: n.cast("decimal(38, 0)") * (n - 1) / 2
    parts = F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.ceil(F.col("total") / ROWS)))
    size = F.col("total") / parts

    def side(c: str) -> tuple[DataFrame, DataFrame]:
        p = placed(pairs, key, c)
        spot = F.floor(F.col("before") / size) * 2 + (F.col("n") > size).cast("long")
        ties = p.groupBy(*key).agg(F.max("total").alias("_n"), F.sum(many(F.col("n"))).alias(f"_ties{c}"))
        return p.select(*key, c, spot.alias(f"_at{c}"), (F.col("n") > size).alias(f"_own{c}")), ties

    (at_x, ties_x), (at_y, ties_y) = side("_x"), side("_y")
    rows = _join(_join(rows, at_x, [*key, "_x"]), at_y, [*key, "_y"])
    # rows of one x don't invert: their blocks may be split by y
    block = F.col("_at_x") * (2 * BLOCKS + 2) + F.when(F.col("_own_x"), F.col("_at_y")).otherwise(0)
    rows = rows.select(*key, "_x", "_y", "_w", block.alias("_block"), F.col("_at_y").alias("_bin"), F.col("_own_x"), F.col("_own_y"))
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "_d decimal(38, 0)"])

    def told(g: pd.DataFrame, d: int) -> pd.DataFrame:
        return pd.DataFrame({**{k: [g[k].iloc[0]] for k in key}, "_d": [d]}).astype({"_d": object}).assign(_d=lambda t: [_decimal(v) for v in t["_d"]])

    def by(order: list[str]) -> Callable:
        def count(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(order)
            return told(g, inversions(g["_y"].to_numpy(), g["_w"].to_numpy()))

        return count

    def cells(g: pd.DataFrame) -> pd.DataFrame:
        _, b = np.unique(g["_block"], return_inverse=True)
        _, c = np.unique(g["_bin"], return_inverse=True)
        h = np.zeros((b.max() + 1, c.max() + 1), object)
        np.add.at(h, (b, c), g["_w"].astype(object).to_numpy())
        below = np.zeros_like(h)
        below[:-1, 1:] = np.cumsum(np.cumsum(h[::-1], axis=0)[::-1], axis=1)[1:, :-1]  # later blocks, smaller bins
        return told(g, int((h * below).sum()))

    local = rows.where("not _own_x").groupBy(*key, "_block").applyInPandas(by(["_x", "_y"]), schema)
    binned = rows.where("not _own_y").groupBy(*key, "_bin").applyInPandas(by(["_block", "_y"]), schema)
    crossed = rows.groupBy(*key, "_block", "_bin").agg(F.sum("_w").alias("_w")).groupBy(*key).applyInPandas(cells, schema)
    d = local.unionByName(binned).unionByName(crossed).groupBy(*key).agg(F.sum("_d").alias("_d"))
    same = rows.groupBy(*key).agg(F.sum(many(F.col("_w"))).alias("_both"))
    t = _join(_join(_join(ties_x, ties_y.drop("_n"), key), same, key), d, key)
    every = many(F.col("_n"))
    signs = (every - F.col("_ties_x") - F.col("_ties_y") + F.col("_both") - 2 * F.col("_d")).cast("double")
    of = F.sqrt((every - F.col("_ties_x")).cast("double") * (every - F.col("_ties_y")).cast("double"))
    return t.select(*key, F.col("_n").alias("n"), F.try_divide(signs, of).alias("tau"))


def _decimal(v: int):
    from decimal import Decimal

    return Decimal(v)
