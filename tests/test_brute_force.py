"""Operators that SQL can't express, against plain versions."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assocframe.operators import compat, ld, ml, profile as p, ranking as rk
from assocframe.plans.views import view
from assocframe.runtime import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def test_loci(spark, small):
    rows = [(r.job_index, r.CHR, r.POS, r.P, r.row_id) for r in view(spark, small, "variants").where("P < 0.05").collect()]
    groups = defaultdict(list)
    for r in rows:
        groups[r[:2]].append(r)
    want = set()
    for g in groups.values():
        leads = []
        for r in sorted(g, key=lambda r: (r[3], r[4])):
            if all(abs(r[2] - x[2]) > 500_000 for x in leads):
                leads.append(r)
        want |= set(leads)
    got = {(r.job_index, r.CHR, r.POS, r.P, r.row_id) for r in compat.loci(view(spark, small, "variants"), p=0.05).collect()}
    assert got == want


def test_bootstrap_and_permutation_repeat(spark, small):
    f = view(spark, small, "features").where("job_index < 10")
    a, b = (rk.bootstrap(f.repartition(n), ["phenotype"], "target", 200).orderBy("phenotype").collect() for n in (1, 3))
    assert a == b
    for r in a:
        x = np.sort([v.target for v in f.where(F.col("phenotype") == r.phenotype).collect()])
        means = x[np.random.default_rng(42).integers(0, len(x), (200, len(x)))].mean(axis=1)
        assert (r.n, r.mean, r.low, r.high) == pytest.approx((len(x), x.mean(), np.quantile(means, 0.025), np.quantile(means, 0.975)))
    g = spark.createDataFrame([("k", float(i), float(i)) for i in range(8)] + [("c", 1.0, 2.0)] * 4, "g string, y double, p double")
    found = {r.g: r for r in rk.permutation(g, ["g"], "y", "p", 300).collect()}
    assert found["k"].rho == pytest.approx(1) and found["k"].p < 0.02 and found["c"].p is None


def test_linked_variants_and_pruning(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 3, 80)
    dose = {"a": base, "b": np.where(rng.random(80) < 0.05, 2 - base, base), "c": rng.integers(0, 3, 80), "far": base}
    pos = {"a": 100, "b": 150_100, "c": 160_000, "far": 900_000}
    d = spark.createDataFrame([(str(i), s, int(v)) for s, x in dose.items() for i, v in enumerate(x)], "IID string, SNPID string, dosage int")
    places = spark.createDataFrame([(s, "1", q) for s, q in pos.items()], "SNPID string, CHR string, POS long")
    found = {(r.s1, r.s2): (r.n, r.r2) for r in ld.by_distance(d, places, 200_000).collect()}
    assert set(found) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (x, y), (n, r2) in found.items():
        assert n == 80 and r2 == pytest.approx(np.corrcoef(dose[x], dose[y])[0, 1] ** 2)
    # of a pair the one of the lower frequency goes; `far` is in the window too, as windows count variants
    f = {s: min(x.mean() / 2, 1 - x.mean() / 2) for s, x in dose.items()}
    assert {r.SNPID for r in ld.prune(d, places).collect()} == ({"c", "a"} if f["b"] <= f["a"] else {"c", "b"})


def test_p_and_z_agree(spark):
    rows = [(1, 0.1, 0.05, 2.0, math.erfc(2 / math.sqrt(2)), 1.0), (1, 0.2, 0.05, 4.0, math.erfc(4 / math.sqrt(2)), 1.1), (1, -0.3, 0.1, -3.0, 0.5, 0.9), (1, 0.0, 0.1, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "job_index int, BETA double, SE double, Z double, P double, OR double")
    r = p.profile(df, p.effects()).first()
    assert r.p_concordance_pct == 75.0 and r.z_concordance_pct == 100.0 and r.z_correlation == pytest.approx(1.0)


def test_held_out_groups_are_predicted_by_the_others(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"g{i % 4}", float(x), None if i % 9 == 0 else float(y), 1.0, 2.0 * float(x)) for i, (x, y) in enumerate(rng.normal(size=(80, 2)))]
    df = spark.createDataFrame(rows, "i int, g string, a double, b double, c double, y double")
    found = ml.hold_one_out(df, ["a", "b", "c"], "y", "g", alpha=1e-6)
    assert found.count() == 80 and all(abs(r.fitted - r.y) < 1e-3 for r in found.collect())
    assert dict(ml.importances(ml.pipeline(["a", "b", "c"], "y", alpha=1e-6).fit(df), ["a", "b", "c"]))["c"] == 0.0
    assert ml.hold_one_out(df.limit(3), ["a", "b"], "y", "g").count() == 0
