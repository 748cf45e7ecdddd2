"""Pairwise concordance of files: one grouping by variant stands for all pairs of files
within a phenotype."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.sql import Column, DataFrame, functions as F

from assocframe.functions import numeric as m
from assocframe.operators import tests_of_significance as ts
from assocframe.operators.fold_evaluation import Moments
from assocframe.operators.harmonise import first_by
from assocframe.operators.profile import KEY
from assocframe.runtime import materialise, sized_join

PAIR, SIDES = ["phenotype", "file1", "file2"], ["b1", "b2", "p1", "p2"]
#: Rows that are packed at once, those of a cell of ranks (about), values that a pair's
#: cells are drawn from, and values of a task that ranks them (about).
PACKED, ROWS, DRAWN, HELD = 1 << 18, 1 << 18, 1 << 10, 1 << 21


def _usable() -> Column:
    letters = [F.col(c).isin("A", "C", "G", "T") for c in ("EA", "NEA")]
    return (F.col("P") > 0) & (F.col("P") <= 1) & F.col("BETA").isNotNull() & letters[0] & letters[1]


def minimal(variants: DataFrame) -> DataFrame:
    """One row per file and variant key: the least P, then row_id."""
    return first_by(variants.where(_usable()).select(KEY, "CHR", "POS", "EA", "NEA", "BETA", "SE", "P", "EAF", "row_id"), [KEY, "CHR", "POS", "EA", "NEA"], "P", "row_id")


def harmonised_pairs(variants: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """Rows of pairs of files of one phenotype: the same alleles, or swapped ones
    with the second effect turned. The same alleles win where both occur.

    Files meet by place and sorted alleles, in one shuffle: a file's one or two rows of
    these (by which allele is the effect) are one row, each the least P, then row_id; a
    place's files are one list, of which each pair is taken, so there is no join. A hash
    leads the keys, as sorts compare it first."""
    v = sized_join(variants.where(_usable()).where(F.col("CHR").isNotNull() & F.col("POS").isNotNull()), phenotypes.select(KEY, "phenotype").where(F.col("phenotype").isNotNull()), [KEY])
    x, y = F.least("EA", "NEA").alias("x"), F.greatest("EA", "NEA").alias("y")
    v = v.select("phenotype", "CHR", "POS", x, y, F.col(KEY).alias("file"), (F.col("EA") <= F.col("NEA")).alias("first"), "BETA", "P", "EAF", "row_id")
    place = ["_h", "phenotype", "CHR", "POS", "x", "y"]
    v = v.withColumn("_h", F.xxhash64(*place[1:])).repartition("_h")
    row, by = F.struct("BETA", "P", "EAF"), F.struct("P", "row_id")
    files = v.groupBy(*place, "file").agg(F.min_by(row, F.when(F.col("first"), by)).alias("same"), F.min_by(row, F.when(~F.col("first"), by)).alias("other"))
    lists = files.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("file", "same", "other"))).alias("_l")).where(F.size("_l") > 1)
    one = lists.select(*place[1:], "_l", F.posexplode("_l").alias("_i", "_a"))
    two = one.select(*place[1:], "_a", F.explode(F.slice("_l", F.col("_i") + 2, F.size("_l"))).alias("_b"))
    sides = [F.struct(F.lit(first).alias("first"), F.col(f"_a.{s}").alias("one"), F.col(f"_b.{s}").alias("same"), F.col(f"_b.{o}").alias("other")) for first, s, o in ((True, "same", "other"), (False, "other", "same"))]
    found = two.select(*place[1:], F.col("_a.file").alias("file1"), F.col("_b.file").alias("file2"), F.explode(F.array(*sides)).alias("_s")).where("_s.one is not null").select("*", "_s.*")
    turned = F.col("same").isNull()
    pick = lambda c, turn: F.when(turned, turn(F.col(f"other.{c}"))).otherwise(F.col(f"same.{c}"))
    alleles = F.when(F.col("first"), F.col("x")).otherwise(F.col("y")).alias("EA"), F.when(F.col("first"), F.col("y")).otherwise(F.col("x")).alias("NEA")
    return found.select("phenotype", "file1", "file2", "CHR", "POS", *alleles, F.col("one.BETA").alias("b1"), F.col("one.P").alias("p1"), F.col("one.EAF").alias("f1"), pick("BETA", lambda c: -c).alias("b2"), pick("P", lambda c: c).alias("p2"), pick("EAF", lambda c: 1 - c).alias("f2"), turned.cast("int").alias("turned"))


#: Comparisons of two files, by the columns that are held against each other.
COMPARISONS = {
    "beta_vs_beta": ("b1", "b2"),
    "p_vs_p": ("p1", "p2"),
    "log10p_vs_log10p": ("l1", "l2"),
    "beta1_vs_p2": ("b1", "p2"),
    "p1_vs_beta2": ("p1", "b2"),
    "beta1_vs_log10p2": ("b1", "l2"),
    "log10p1_vs_beta2": ("l1", "b2"),
}


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of pairs to blocks of one pair of files: rows, turned ones, the sides."""

    def blocks(held: list[pd.DataFrame]) -> pd.DataFrame:
        d = pd.concat(held)
        return pd.DataFrame([(*k, len(g), int((g["turned"] == 0).sum()), int((g["turned"] == 1).sum()), *[g[c].to_numpy(float).tobytes() for c in SIDES]) for k, g in d.groupby(PAIR, sort=False, dropna=False)], columns=[*PAIR, "n", "direct", "turned", *SIDES])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= PACKED:
            yield blocks(held)
            held, n = [], 0
    if n:
        yield blocks(held)


def _moments(x: np.ndarray, y: np.ndarray) -> Moments:
    on = ~np.isnan(x) & ~np.isnan(y)
    return Moments(np.stack([x[on], y[on]], axis=1))


def _r(of: Moments) -> tuple[int, float | None]:
    a, c, b = of.products[0, 0], of.products[0, 1], of.products[1, 1]
    return of.n, float(c / (np.sqrt(a) * np.sqrt(b))) if of.n >= 3 and a > 0 and b > 0 else None


def _added(a: tuple, b: tuple) -> tuple:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def _sides(row: tuple) -> list[np.ndarray]:
    return [np.frombuffer(x) for x in row[-len(SIDES) :]]


def _plain(row: tuple) -> tuple:
    b1, b2, p1, p2 = _sides(row)
    l1, l2 = (-np.log10(np.where(p > 0, p, np.nan)) for p in (p1, p2))
    of = {"b1": b1, "b2": b2, "p1": p1, "p2": p2, "l1": l1, "l2": l2}
    return tuple(row[:3]), (*row[3:6], *[_moments(of[x], of[y]) for x, y in COMPARISONS.values()])


#: Spearman's comparisons: ranks of -log10 P are those of P turned round.
_RANKED = [("b1", "b2"), ("p1", "p2"), ("b1", "p2"), ("p1", "b2")]


def _ranked(blocks: RDD, sizes: dict[tuple, int], parts: int) -> RDD:
    """(pair, moments of ranks): values go to cells with their places in a block, and
    their average ranks come back. A pair of at most ROWS rows is one cell a side; those
    of others (`sizes`) are cut at places of a sample."""

    def drawn(row: tuple) -> Iterator[tuple]:
        n = sizes.get(tuple(row[:3]))
        for i, v in enumerate(_sides(row) if n else ()):
            v = np.sort(v[~np.isnan(v)])
            k = max(1, round(DRAWN * len(v) / n))
            if len(v):
                yield (*row[:3], i), v[((np.arange(k) + 0.5) * len(v) / k).astype(int)]

    def bounds(x: tuple) -> tuple:
        v, cells = np.sort(x[1]), -(-sizes[x[0][:3]] // ROWS)
        return x[0], np.unique(v[np.arange(1, cells) * len(v) // cells])

    cut = dict(blocks.flatMap(drawn).reduceByKey(lambda a, b: np.concatenate([a, b])).map(bounds).collect()) if sizes else {}
    none = np.zeros(0)

    def counted(row: tuple) -> Iterator[tuple]:
        for i, v in enumerate(_sides(row) if tuple(row[:3]) in sizes else ()):
            c = cut.get((*row[:3], i), none)
            yield (*row[:3], i), np.bincount(np.searchsorted(c, v[~np.isnan(v)], "right"), minlength=len(c) + 1)

    before = {k: np.r_[0, np.cumsum(n)[:-1]] for k, n in blocks.flatMap(counted).reduceByKey(np.add).collect()} if sizes else {}

    def sent(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        for at, row in enumerate(rows):
            for i, v in enumerate(_sides(row)):
                k = (*row[:3], i)
                known = np.flatnonzero(~np.isnan(v)).astype(np.int32)
                cell = np.searchsorted(cut.get(k, none), v[known], "right")
                for c in np.unique(cell) if len(cell) else [0]:
                    place = known[cell == c]
                    yield (*k, int(c)), (part, at, len(v), place, v[place])

    def ranks(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: dict = {}
        for k, piece in rows:
            held.setdefault(k, []).append(piece)
        while held:
            k, pieces = held.popitem()
            v = np.concatenate([x[4] for x in pieces])
            order = np.argsort(v, kind="stable")
            w = v[order]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, int)
            n = np.diff(np.r_[first, len(w)])
            r = np.empty(len(v))
            r[order] = np.repeat(first + (n + 1) / 2, n)
            r += before[k[:4]][k[4]] if k[:4] in before else 0
            for x, own in zip(pieces, np.split(r, np.cumsum([len(x[4]) for x in pieces])[:-1]), strict=True):
                yield x[:2], (k[:3], k[3], x[2], x[3], own)

    def told(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: dict = {}
        for k, (pair, i, n, place, r) in rows:
            if k not in held:
                held[k] = pair, {c: np.full(n, np.nan) for c in SIDES}
            held[k][1][SIDES[i]][place] = r
        for pair, of in held.values():
            yield pair, tuple(_moments(of[x], of[y]) for x, y in _RANKED)

    back = blocks.mapPartitionsWithIndex(sent).partitionBy(parts).mapPartitions(ranks).partitionBy(parts)
    return back.mapPartitions(told).reduceByKey(_added)


def correlations(pairs: DataFrame) -> DataFrame:
    """Per pair of files the shared variants, those of the same and of swapped alleles,
    and for each comparison Pearson's and Spearman's n, r and p: null under three rows
    or where a side is constant. Ranks are exact and shared by the comparisons: those
    of -log10 P are those of P turned round. Rows lie in blocks of a pair of files; only
    values, places in a block and ranks are shuffled, as arrays. NaN counts as missing."""
    spark, kinds = pairs.sparkSession, dict(pairs.dtypes)
    keys = ", ".join(f"{k} {kinds[k]}" for k in PAIR)
    packed = materialise(pairs.select(*PAIR, "turned", *[F.col(c).cast("double").alias(c) for c in SIDES]).mapInPandas(_packed, f"{keys}, n long, direct long, turned long, " + ", ".join(f"{c} binary" for c in SIDES)), "pairs")
    n = packed.groupBy(*PAIR).agg(F.sum("n").alias("n"))
    sizes = {tuple(r[:3]): r[3] for r in n.where(F.col("n") > ROWS).collect()}  # as many as the rows fill
    blocks = packed.rdd.map(tuple)
    rows = packed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, rows * len(SIDES) // HELD)

    def row(x: tuple) -> tuple:
        pair, ((whole, direct, turned, *plain), ranked) = x
        out = [*pair, whole, direct, turned]
        for of, (a, b) in zip(plain, COMPARISONS.values(), strict=True):
            m, r = _r(ranked[_RANKED.index((a.replace("l", "p"), b.replace("l", "p")))])
            turns = (a[0] == "l") != (b[0] == "l")
            out += [*_r(of), m, -r if turns and r is not None else r]
        return tuple(out)

    names = [f"{k}_{how}" for k in COMPARISONS for how in ("pearson", "spearman")]
    schema = f"{keys}, n_common_snps long, n_direct_allele_match long, n_flipped_allele_match long, " + ", ".join(f"{x}_n long, {x}_r double" for x in names)
    out = spark.createDataFrame(blocks.map(_plain).reduceByKey(_added).join(_ranked(blocks, sizes, parts)).map(row), schema)
    return out.select(*PAIR, "n_common_snps", "n_direct_allele_match", "n_flipped_allele_match", *[c for n in names for c in (f"{n}_n", f"{n}_r", ts.correlation_p(F.col(f"{n}_r"), F.col(f"{n}_n")).alias(f"{n}_p"))])


def pairwise(pairs: DataFrame) -> DataFrame:
    """Per pair of files: shared variants and Pearson correlations."""
    return pairs.groupBy("phenotype", "file1", "file2").agg(
        F.count(F.lit(1)).alias("shared"), F.sum("turned").alias("turned"), m.pearson(F.col("b1"), F.col("b2")).alias("beta_r"), m.pearson(F.abs("b1"), F.abs("b2")).alias("abs_beta_r"),
        m.pearson(m.neg_log10(F.col("p1")), m.neg_log10(F.col("p2"))).alias("logp_r"), m.pearson(F.col("f1"), F.col("f2")).alias("eaf_r"), m.rate(F.signum("b1") == F.signum("b2")).alias("same_sign_pct"),
    )


def summary(pairs: DataFrame, metrics: list[str]) -> DataFrame:
    """Per metric over pairs: counts, centre, range, signs and sizes."""
    x = F.col("value")
    long = pairs.unpivot(["file1", "file2"], metrics, "metric", "value").where(x.isNotNull())
    return long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), m.median(x).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"), F.count_if(x > 0).alias("positive"), F.count_if(x < 0).alias("negative"), *[F.count_if(F.abs(x) >= k / 10).alias(f"abs_{k}") for k in (1, 2, 5)])


def tables(pairs: DataFrame, metric: str) -> DataFrame:
    """Per phenotype: files, pairs, quartiles and range of a metric."""
    x = F.col(metric)
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = pairs.groupBy("phenotype").agg(F.count(F.lit(1)).alias("pairs"), F.size(F.array_union(F.collect_set("file1"), F.collect_set("file2"))).alias("files"), q.alias("q"), F.min(x).alias("min"), F.max(x).alias("max"))
    return out.select("phenotype", "pairs", "files", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "min", "max")
