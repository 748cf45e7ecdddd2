"""Order statistics and Kendall's tau against numpy and all pairs."""

import random

import numpy as np
import pytest

from assocframe.operators import order
from assocframe.runtime import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def rows_of(rng, n):
    """One value of a third of all rows, few and many distinct ones, nulls."""
    return [(rng.choice(["a", "b", None]), rng.choice([0.25, rng.choice([1.0, 2.0, -3.0]), rng.gauss(0, 5), None]), float(rng.randrange(7)) if rng.random() < 0.9 else None) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, x double, y double").repartition(5)


@pytest.mark.parametrize("cells, least", [(2, 1), (256, 1), (256, 1 << 12), (16, 40)])
def test_quantiles_and_ranks(spark, monkeypatch, cells, least):
    monkeypatch.setattr(order, "CELLS", cells)
    monkeypatch.setattr(order, "LEAST", least)
    rows = rows_of(random.Random(cells), 400)
    df = frame(spark, rows)
    shares = {"lo": 0.0, "q1": 0.05, "m": 0.5, "hi": 1.0}
    got = {r.k: r for r in order.quantiles(df, ["k"], "x", shares).collect()}
    ranked = {r.i: r.r_x for r in order.average_ranks(df, ["k"], ["x"]).collect()}
    assert len(ranked) == 400
    for k in ("a", "b", None):
        x = np.array([r[1] for r in rows if r[0] == k and r[1] is not None])
        assert got[k].total == len(x)
        assert [got[k][c] for c in shares] == pytest.approx([np.quantile(x, q) for q in shares.values()])
        for i, r in enumerate(rows):
            if r[0] == k:
                assert ranked[i] == (None if r[1] is None else (x < r[1]).sum() + ((x == r[1]).sum() + 1) / 2)


def test_inversions():
    rng = np.random.default_rng(1)
    for n, base in ((0, 4), (1, 4), (37, 4), (300, 8), (1000, 64)):
        y, w = rng.integers(0, 20, n).astype(float), rng.integers(1, 5, n)
        want = sum(int(w[i]) * int(w[j]) for i in range(n) for j in range(i + 1, n) if y[i] > y[j])
        assert order.inversions(y, w, base) == want


@pytest.mark.parametrize("size", [3, 40, 1 << 17])
def test_kendall_is_that_of_all_pairs(spark, monkeypatch, size):
    """Blocks of a few rows, with values of more than a block's, and one block."""
    monkeypatch.setattr(order, "ROWS", size)
    rows = rows_of(random.Random(size), 260) + [("c", 1.0, 2.0)] * 5 + [("d", None, 1.0)]
    got = {r.k: r for r in order.kendall(frame(spark, rows), ["k"], "x", "y").collect()}
    assert "d" not in got
    for k in ("a", "b", None, "c"):
        p = np.array([r[1:] for r in rows if r[0] == k and None not in r[1:]])
        s = np.sign(p[:, None] - p[None])
        both, nx, ny = (s[..., 0] * s[..., 1]).sum(), (s[..., 0] != 0).sum(), (s[..., 1] != 0).sum()
        assert got[k].n == len(p) and got[k].tau == (pytest.approx(both / np.sqrt(nx * ny)) if nx * ny else None)
