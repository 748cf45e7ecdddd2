"""Pairs of files and their correlations against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assocframe.operators import concordance as cc
from assocframe.plans import registry
from assocframe.plans.views import ORDERS, view
from assocframe.runtime import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def test_ranks_of_many_cells_and_blocks(spark, monkeypatch):
    """Ties across blocks, nulls, a constant side and pairs of one row: ranks by arrays of
    few values a cell; no row is joined to its ranks."""
    rng = np.random.default_rng(7)
    n = 600
    d = pd.DataFrame({"phenotype": "p", "file1": 1, "file2": rng.integers(2, 4, n), "turned": rng.integers(0, 2, n), "b1": rng.integers(-5, 6, n) / 100, "b2": rng.normal(size=n), "p1": rng.integers(1, 40, n) / 40, "p2": rng.random(n) + 1e-9})
    d.loc[::7, "b2"] = np.nan
    d.loc[n] = ["p", 4, 5, 0, 0.1, 0.2, 0.5, 0.5]
    d = pd.concat([d, d[:9].assign(file1=6, file2=7, b1=0.25)])
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in d.itertuples(index=False)]
    df = spark.createDataFrame(rows, "phenotype string, file1 int, file2 int, turned int, b1 double, b2 double, p1 double, p2 double").repartition(5)
    for name, v in (("PACKED", 50), ("ROWS", 40), ("DRAWN", 64)):
        monkeypatch.setattr(cc, name, v)
    found = cc.correlations(df)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.file1, r.file2): r for r in found.collect()}
    assert set(got) == {(1, 2), (1, 3), (4, 5), (6, 7)}
    d = d.assign(l1=-np.log10(d.p1), l2=-np.log10(d.p2))
    for k, g in d.groupby(["file1", "file2"]):
        r = got[k]
        assert (r.n_common_snps, r.n_direct_allele_match, r.n_flipped_allele_match) == (len(g), (g.turned == 0).sum(), (g.turned == 1).sum())
        for name, (x, y) in cc.COMPARISONS.items():
            for how, of in (("pearson", g), ("spearman", g[["b1", "b2", "p1", "p2", "l1", "l2"]].rank())):
                both = of[[x, y]].dropna()
                assert r[f"{name}_{how}_n"] == len(both)
                want = both[x].corr(both[y]) if len(both) > 2 and both[x].nunique() > 1 else None
                assert r[f"{name}_{how}_r"] == (want if want is None else pytest.approx(want, abs=1e-9)), (k, name, how)
                assert (r[f"{name}_{how}_p"] is None) == (want is None)


def test_pairs_of_files_are_taken_without_a_join(spark, small):
    """The rows of a plain walk; a variant's rows meet in one shuffle."""
    found = cc.harmonised_pairs(view(spark, small, "variants"), view(spark, small, "jobs"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    v = cc.minimal(view(spark, small, "variants")).join(view(spark, small, "jobs").select("job_index", "phenotype"), "job_index").where(F.col("CHR").isNotNull()).collect()
    of = {(r.phenotype, r.job_index, r.CHR, r.POS, r.EA, r.NEA): r for r in v}
    want = set()
    for (phenotype, one, chrom, pos, ea, nea), r in of.items():
        for two in {k[1] for k in of if k[0] == phenotype and k[1] > one}:
            for turned, key in ((0, (ea, nea)), (1, (nea, ea))):
                if s := of.get((phenotype, two, chrom, pos, *key)):
                    want.add((phenotype, one, two, chrom, pos, ea, nea, r.BETA, r.P, r.EAF, -s.BETA if turned else s.BETA, s.P, 1 - s.EAF if turned else s.EAF, turned))
                    break
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) > 0 and set(got) == want


def test_pairs_of_rows_whose_id_is_beyond_a_bigint(spark, small, tmp_path):
    """Orders' keys that differ by a multiple of what the view's other columns divide
    by: the same pairs and p, and the order of the exact number."""
    far = 97_000_000
    for name, key in (("lineitem", "l_orderkey"), ("supplier", None), ("part", None)):
        t = spark.read.parquet(f"{small}/{name}.parquet")
        (t.withColumn(key, F.col(key) + far) if key else t).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("join_pairwise_p", "join_pairwise_full", "join_rsid_allele"):
        one, other = (sorted(map(tuple, registry.queries()[name](spark, d).collect())) for d in (small, str(tmp_path)))
        assert one == other and one, name
    cols = "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_tax", "l_quantity"
    rows = spark.createDataFrame([(o, p, n, s, 0.0, 1.0) for o in (0, 1, 9_223_372, 54_000_000) for p in (0, 99_999, 100_000, 7_200_000) for n in (1, 7) for s in (3, 999)], ", ".join(f"{c} {'double' if c in cols[4:] else 'long'}" for c in cols))
    key = F.expr(ORDERS["variants"]["row_id"])
    exact = lambda r: r.l_orderkey * 10**12 + r.l_partkey * 10**7 + r.l_linenumber * 10**6 + r.l_suppkey % 1000 * 1000 + 1
    got = rows.select("*", key.alias("k")).collect()
    assert [r.k.high * 10**12 + r.k.low for r in got] == [exact(r) for r in got] and all(0 <= r.k.low < 10**12 for r in got)
