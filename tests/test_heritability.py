"""LD-score regression and its jackknife against numpy."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from assocframe.operators import heritability as hb


def plain(x, blocks):
    """x: rows (ld, chi2, n) in order."""
    ld, y, n = x.T
    m = len(x)
    h = min(1.0, max(0.0, (y.mean() - 1) * m / (n * ld).mean()))
    u = n * ld / m
    w = 1 / (np.maximum(ld, 1) * (1 + h * u) ** 2)

    def fit(keep):
        a = np.c_[u[keep], np.ones(keep.sum())]
        return np.linalg.solve(a.T @ (a * w[keep, None]), a.T @ (w[keep] * y[keep]))

    block = np.arange(m) * blocks // m
    every = fit(np.ones(m, bool))
    out = np.array([fit(block != b) for b in np.unique(block)])
    k = len(out)
    pseudo = k * every - (k - 1) * out
    return every, np.sqrt(pseudo.var(axis=0, ddof=1) / k)


@pytest.mark.parametrize("blocks, rows", [(20, 500), (200, 60), (3, 40)])
def test_errors_are_the_jackknifes(spark, blocks, rows):
    rng = np.random.default_rng(blocks)
    made = []
    for f in (1, 2):
        for i in range(rows):
            c = rng.choice(["1", "2", "10", "X"])
            made.append((f, str(c), int(rng.integers(1, 5_000_000)), i, float(rng.uniform(0.2, 90)), float(rng.chisquare(1) * 2), float(rng.integers(900, 1100))))
    df = spark.createDataFrame([*made, (1, "1", 5, -1, None, 1.0, 1.0), (1, "1", 5, -2, 1.0, None, 1.0)], "f int, CHR string, POS long, id int, ld double, chi2 double, N double").repartition(4)
    for r in hb.ld_score_regression(df, ["f"], ["CHR", "POS", "id"], blocks).collect():
        own = sorted((m for m in made if m[0] == r.f), key=lambda m: ({"X": 23}.get(m[1]) or int(m[1]), m[2], m[3]))
        (h2, intercept), (h2_se, intercept_se) = plain(np.array([m[4:] for m in own]), blocks)
        assert (r.h2, r.intercept, r.h2_se, r.intercept_se) == pytest.approx((h2, intercept, h2_se, intercept_se), rel=1e-8)
        assert r.variants == rows and r.ratio == pytest.approx((intercept - 1) / (np.mean([m[5] for m in own]) - 1))
        assert r.lambda_gc == pytest.approx(np.median([m[5] for m in own]) / NormalDist().inv_cdf(0.75) ** 2)


def test_one_row_has_no_error(spark):
    df = spark.createDataFrame([(1, "1", 5, 2.0, 1.5, 10.0)], "f int, CHR string, POS long, ld double, chi2 double, N double")
    r = hb.ld_score_regression(df, ["f"], ["CHR", "POS"]).first()
    assert r.h2 is None and r.h2_se is None and r.mean_chi2 == 1.5


def test_liability(spark):
    df = spark.createDataFrame([(0.2, 0.5, 0.01), (0.2, 0.3, 0.3), (0.1, 0.4, 0.0), (0.1, 1.0, 0.2), (None, 0.5, 0.1)], "h double, p double, k double")
    got = [r[0] for r in df.select(hb.liability(F.col("h"), F.col("p"), F.col("k"))).collect()]
    want = [h * (k * (1 - k)) ** 2 / (p * (1 - p) * NormalDist().pdf(NormalDist().inv_cdf(1 - k)) ** 2) for h, p, k in ((0.2, 0.5, 0.01), (0.2, 0.3, 0.3))]
    assert got[:2] == pytest.approx(want, rel=1e-6) and got[2:] == [None, None, None]
