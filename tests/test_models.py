"""Penalty search and fold evaluation against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assocframe.operators import fold_evaluation as fe, ml, penalty, prs
from assocframe.plans import model_queries as mq, registry
from assocframe.plans.views import view
from assocframe.runtime import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.mark.parametrize("kind", ["ridge", "lasso", "elastic_net"])
def test_search_over_the_whole_grid(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 4)) * [1, 5, 1, 2]
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=90)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, d double, y double")
    model = ml.pipeline(list("abcd"), "y", kind).fit(df)
    last = model.stages[-1]
    assert len(penalty.GRIDS[kind][0]) == (100 if kind == "ridge" else 80)
    assert last.alpha in penalty.GRIDS[kind][0] and last.share in penalty.GRIDS[kind][1]
    scaled = np.array([r.scaled.toArray() for r in model.transform(df).select("scaled").collect()])
    z = (scaled - scaled.mean(axis=0)) / scaled.std(axis=0)
    w, rest = last.coefficients.toArray() * scaled.std(axis=0), y - y.mean()
    slope = z.T @ (rest - z @ w)
    if kind == "ridge":
        assert slope == pytest.approx(last.alpha * w, abs=1e-6)
    else:
        slope = slope / 90 - last.alpha * (1 - last.share) * w
        on = w != 0
        assert slope[on] == pytest.approx(last.alpha * last.share * np.sign(w[on]), abs=1e-6)
        assert (abs(slope[~on]) <= last.alpha * last.share + 1e-6).all()
    fitted = [r.prediction for r in model.transform(df).select("prediction").collect()]
    assert fitted == pytest.approx(list(y.mean() + z @ w), abs=1e-6)


def test_the_search_takes_the_best_of_held_out_parts(spark):
    """Every alpha fitted by rows on the same parts."""
    rng = np.random.default_rng(2)
    x, part = rng.normal(size=(60, 5)), np.arange(60) % 3
    y = 0.4 * x[:, 0] + rng.normal(size=60)
    z = np.c_[np.ones(60), x, y]
    alphas, _ = penalty.GRIDS["ridge"]
    mean = []
    for a in alphas:
        r2 = []
        for k in range(3):
            t, h = part != k, part == k
            m, c = x[t].mean(axis=0), y[t].mean()
            w = np.linalg.solve((x[t] - m).T @ (x[t] - m) + a * np.eye(5), (x[t] - m).T @ (y[t] - c))
            r2.append(fe.r2(y[h], c + (x[h] - m) @ w))
        mean.append(np.mean(r2))
    assert penalty.search(np.array([z[part == k].T @ z[part == k] for k in range(3)]), "ridge")[0] == pytest.approx(alphas[int(np.argmax(mean))])


def test_tree_counts_are_the_studied_programs():
    assert ml.learner("forest", "y").getNumTrees() == 500
    boosting = ml.learner("boosting", "y")
    assert (boosting.getMaxIter(), boosting.getStepSize()) == (300, 0.03)
    assert {"lopo_cv", "lopo_lasso", "lopo_elastic_net", "lopo_forest", "lopo_boosting", "eval_fold"} <= set(registry.queries())


@pytest.mark.parametrize("binary", [True, False])
def test_folds_are_evaluated_by_three_models(spark, binary):
    rng = np.random.default_rng(3)
    age, score = rng.normal(50, 9, 200), rng.normal(size=200)
    y = 0.05 * (age - 50) + score + rng.normal(size=200)
    y = (y > 0).astype(float) if binary else y
    s = spark.createDataFrame([(str(i), i % 4, float(y[i]), float(age[i])) for i in range(200)], "IID string, fold int, y double, AGE double")
    k = spark.createDataFrame([(str(i), t, float(score[i] * t)) for i in range(190) for t in (0.5, 1.0)], "IID string, threshold double, score double")
    rows = fe.evaluate(s, k, ["AGE"]).collect()
    assert len(rows) == 8 and {r.metric for r in rows} == {"AUC" if binary else "R2"}
    has = np.arange(200) < 190
    for r in rows:
        held = np.arange(200) % 4 == r.fold
        for name, cols, use in (("null", [age], np.ones(200, bool)), ("pure", [score * r.threshold], has), ("best", [age, score * r.threshold], has)):
            x = np.stack(cols, axis=1)
            t, h = use & ~held, use & held
            v = (x - x[t].mean(axis=0)) / x[t].std(axis=0)
            v = np.c_[v, np.ones(200)]
            if binary:
                w = np.zeros(v.shape[1])
                for _ in range(20_000):
                    w -= 0.01 * (w + v[t].T @ (1 / (1 + np.exp(-v[t] @ w)) - y[t]))
                pairs = [(a > b) + (a == b) / 2 for a in (v[h] @ w)[y[h] == 1] for b in (v[h] @ w)[y[h] == 0]]
                want = np.mean(pairs)
            else:
                w = np.linalg.lstsq(v[t], y[t], rcond=None)[0]
                want = 1 - ((y[h] - v[h] @ w) ** 2).sum() / ((y[h] - y[h].mean()) ** 2).sum()
            assert r[f"test_{name}"] == pytest.approx(want, abs=1e-6), name
        assert (r.train_n, r.test_n) == ((has & ~held).sum(), (has & held).sum())


def test_components_are_those_of_the_dosages(spark, small):
    """The registered query against an eigendecomposition of the whole matrix."""
    dose = [(r.IID, r.SNPID, r.dosage) for r in mq.dosages(spark, small).collect()]
    samples, variants = sorted({r[0] for r in dose}), sorted({r[1] for r in dose})
    x = np.full((len(samples), len(variants)), np.nan)
    for i, v, g in dose:
        x[samples.index(i), variants.index(v)] = g
    f = np.nanmean(x, axis=0) / 2
    x, f = x[:, (f > 0) & (f < 1)], f[(f > 0) & (f < 1)]
    z = np.nan_to_num((x - 2 * f) / np.sqrt(2 * f * (1 - f)))
    want = np.linalg.eigh(z @ z.T)[1][:, ::-1][:, :6]
    rows = {r.IID: r for r in registry.queries()["plink_pca"](spark, small).collect()}
    assert set(rows) == {r.IID for r in view(spark, small, "samples").collect()} and {"FID", "PC6"} <= set(next(iter(rows.values())).asDict())
    for k in range(6):
        got = np.array([rows[i][f"PC{k + 1}"] if i in rows else np.nan for i in samples])
        on = ~np.isnan(got)
        assert min(abs(got - want[:, k])[on].max(), abs(got + want[:, k])[on].max()) < 1e-7


def test_leading_vectors_of_a_matrix_that_is_not_whole():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 900))
    want = np.linalg.eigh(x @ x.T)[1][:, ::-1][:, :6]
    got = prs.leading(lambda u: x @ (x.T @ u), 700, 6)
    assert np.abs((got * want).sum(axis=0)) == pytest.approx(np.ones(6), abs=1e-9)


def test_clumped_scores_leave_linked_variants_out(spark, small):
    t = {r.SNPID: r for r in view(spark, small, "target").collect()}
    index = {r.SNPID for r in registry.queries()["plink_clump"](spark, small).collect()}
    assert index < set(t)
    want = {}
    for r in mq.dosages(spark, small).collect():
        if r.SNPID in index:
            for k, at in enumerate([*(0.00001 + 0.05 * i for i in range(20)), 1.0]):
                if t[r.SNPID].P <= at:
                    n, x = want.get((r.IID, k), (0, 0.0))
                    want[r.IID, k] = (n + 1, x + r.dosage * t[r.SNPID].BETA)
    got = {(r.IID, r.step): (r.variants, r.score) for r in registry.queries()["prsice_clumped"](spark, small).collect()}
    assert set(got) == set(want)
    assert all(got[k][0] == n and got[k][1] == pytest.approx(x / (2 * n), abs=1e-9) for k, (n, x) in want.items())


def test_every_row_has_its_place(spark):
    """On a table with more rows than sort_multi returns, nulls last."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.f_size is None, -(r.f_size or 0.0), r.f_rate, r.job_index) for r in view(spark, sf, "features").collect()]
    want = {r[3]: i + 1 for i, r in enumerate(sorted(rows))}
    got = {r.job_index: r.place for r in registry.queries()["sort_multi_all"](spark, sf).collect()}
    assert len(got) > 25 and got == want


def test_components_of_vectors_in_parts(spark, small, monkeypatch):
    """Without vectors of the samples' number in the driver, restarts included, whatever
    the parts; the driver's own solver isn't asked."""
    from assocframe.operators import spectral

    want = {r.IID: r for r in prs.components(mq.dosages(spark, small)).collect()}
    monkeypatch.setattr(prs, "WHOLE", 20)
    monkeypatch.setattr(prs, "leading", None)
    monkeypatch.setattr(spectral, "MOST", 40)
    monkeypatch.setattr(spectral, "KEPT", 2)
    got = {r.IID: r for r in prs.components(mq.dosages(spark, small)).collect()}
    assert set(got) == set(want)
    for k in range(1, 7):
        a, b = (np.array([d[i][f"PC{k}"] for i in sorted(want)]) for d in (got, want))
        assert np.abs(a - b).max() < 1e-6


def test_equal_eigenvalues_have_all_their_vectors(spark):
    """Eight equal blocks, and a part that has no entries: six orthonormal vectors of
    the greatest eigenvalue."""
    from assocframe.operators import spectral

    rng = np.random.default_rng(5)
    x = rng.normal(size=(9, 5))
    z = np.kron(np.eye(8), x)
    rows = [(int(i), int(j), float(z[i, j])) for i, j in zip(*np.nonzero(z), strict=True)]
    df = spark.createDataFrame(rows, "at long, to long, z double")
    got = sorted(tuple(r) for r in spectral.leading(spark, df, 100, 40, 6).collect())
    v = np.array(got)[:, 1:]
    assert [r[0] for r in got] == list(range(100)) and np.abs(v[72:]).max() < 1e-12
    assert v.T @ v == pytest.approx(np.eye(6), abs=1e-9)
    assert z @ (z.T @ v[:72]) == pytest.approx(np.linalg.eigvalsh(x @ x.T)[-1] * v[:72], abs=1e-6)


def test_scores_ask_for_the_dosages_once(spark, small):
    """One scan of the largest table, and a score at every threshold from a sample's first."""
    found = prs.score(mq.dosages(spark, small), view(spark, small, "target"), prs.thresholds(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan parquet" in line and "l_partkey" in line for line in plan.splitlines()) == 1
    y = view(spark, small, "samples").select("IID", F.col("PHENO").alias("y"))
    plan = prs.best_fit(found, y)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan parquet" in line and "l_partkey" in line for line in plan.splitlines()) == 1
    d = spark.createDataFrame([("a", "v1", 1), ("a", "v2", 2), ("b", "v3", 1)], "IID string, SNPID string, dosage int")
    w = spark.createDataFrame([("v1", 0.5, 0.01), ("v2", 0.25, 0.3), ("v3", 1.0, 0.9)], "SNPID string, BETA double, P double")
    grid = spark.createDataFrame([(0.001,), (0.01,), (0.1,), (0.3,), (1.0,)], "threshold double")
    got = {(r.IID, r.threshold): (r.variants, r.score) for r in prs.score(d, w, grid).collect()}
    assert got == {("a", 0.01): (1, 0.25), ("a", 0.1): (1, 0.25), ("a", 0.3): (2, 0.25), ("a", 1.0): (2, 0.25), ("b", 1.0): (1, 0.5)}


def test_no_task_holds_a_folds_samples(spark, monkeypatch):
    """Blocks and cells of a few samples give what one block and cell give; predictions
    tie, some samples have no score, one fold has one class, and a threshold one score."""
    rng = np.random.default_rng(6)
    age, score = rng.integers(20, 26, 300).astype(float), rng.integers(-2, 3, 300) / 4
    y = (rng.random(300) < 1 / (1 + np.exp(-score))).astype(float)
    fold = np.where(np.arange(300) < 9, 7, np.arange(300) % 3)
    y[:9] = 1.0
    s = spark.createDataFrame([(str(i), int(fold[i]), float(y[i]), float(age[i])) for i in range(300)], "IID string, fold int, y double, AGE double").repartition(3)
    k = spark.createDataFrame([(str(i), t, float(score[i])) for i in range(280) for t in (0.1, 0.9)] + [("299", 1.0, 0.5)], "IID string, threshold double, score double")
    seen = []
    plain = fe.Moments.__init__
    monkeypatch.setattr(fe.Moments, "__init__", lambda self, x: (seen.append(len(x)), plain(self, x))[1])
    want = {(r.fold, r.threshold): r for r in fe.evaluate(s, k, ["AGE"]).collect()}
    assert max(seen) == 0 and len(want) == 12  # the driver makes none of rows
    for t in (0.1, 0.9):
        for held in range(3):
            z = np.where(fold[:280] == held, score[:280], np.nan)
            pairs = [(a > b) + (a == b) / 2 for a in z[(y[:280] == 1) & ~np.isnan(z)] for b in z[(y[:280] == 0) & ~np.isnan(z)]]
            assert want[held, t].test_pure == pytest.approx(np.mean(pairs), abs=1e-12)
        assert want[7, t].test_best is None and (want[7, t].test_n, want[7, t].test_controls) == (9, 0)
    assert want[0, 1.0].train_n + want[0, 1.0].test_n == 1 and want[0, 1.0].train_best is None
    monkeypatch.setattr(fe, "BLOCK", 16)
    monkeypatch.setattr(fe, "ROWS", 20)
    monkeypatch.setattr(fe, "DRAWN", 64)
    for r in fe.evaluate(s, k, ["AGE"]).collect():
        for c, v in want[r.fold, r.threshold].asDict().items():
            assert r[c] == (v if v is None or isinstance(v, str) else pytest.approx(v, abs=1e-12)), c


def test_tables_leave_no_shuffles_on_disk(spark, small, monkeypatch):
    """What the components and the evaluation write drops its shuffles' files; a product
    sends the places that have entries alone."""
    import time
    from pathlib import Path

    from assocframe import runtime
    from assocframe.operators import spectral

    dirs = [Path(d.getPath()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for f in d.rglob("shuffle_*")}
    before = files()
    with runtime.shuffles_dropped(spark):
        rows = runtime.materialise(spark.range(10_000).groupBy((F.col("id") % 997).alias("k")).count(), "counted")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and rows.count() == 997
    seen = {}
    plain = runtime.materialise
    for module in (prs, fe):
        monkeypatch.setattr(module, "materialise", lambda df, tag, *a, **b: (seen.__setitem__(tag, spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")), plain(df, tag, *a, **b))[1])
    monkeypatch.setattr(prs, "WHOLE", 20)
    monkeypatch.setattr(spectral, "leading", lambda spark, entries, n, m, k: spark.range(n).select("id", *[F.lit(0.5)] * k))
    found = prs.components(mq.dosages(spark, small))
    s = found.select("IID", F.lit(1).alias("fold"), F.lit(1.0).alias("y"), "PC1")
    fe.evaluate(s, found.select("IID", F.lit(0.1).alias("threshold"), F.col("PC1").alias("score")), ["PC1"])
    assert {"known", "scaled", "dosages", "blocks"} <= set(seen) and set(seen.values()) == {"true"}
    at, to, z = np.array([0, 2, 2, 1], np.int32), np.array([5, 9, 5, 5], np.int32), np.array([0.5, 2.0, 0.5, 4.0])
    values, code = spectral._coded(z)
    piece = list(spectral._sorted(iter([(0, (3, at.tobytes(), to.tobytes(), values.tobytes(), code.tobytes()))]), 3))
    ((part, (places, sums)),) = spectral._times(iter([(0, np.eye(3)), *piece]))
    assert part == 3 and dict(zip(places.tolist(), sums.tolist(), strict=True)) == {5: [0.5, 4.0, 0.5], 9: [0.0, 0.0, 2.0]}


def test_close_values_by_a_filter(spark, monkeypatch):
    """Values at the edge of a random matrix, and places with more entries than levels."""
    from assocframe.operators import spectral

    rng = np.random.default_rng(8)
    z = np.where(rng.random((160, 200)) < 0.3, rng.normal(size=(160, 200)), 0.0)
    z[:, 7] = rng.normal(size=160)
    values, want = np.linalg.eigh(z @ z.T)
    assert values[-8] > values[-1] / 2
    for name, v in (("MOST", 40), ("KEPT", 2), ("LEVEL", 8), ("DEGREE", 3)):
        monkeypatch.setattr(spectral, name, v)
    steps, plain = [], spectral._combined
    monkeypatch.setattr(spectral, "_combined", lambda of, by: (steps.append(len(by)) if of is None else 0, plain(of, by))[1])
    df = spark.createDataFrame([(int(i), int(j), float(z[i, j])) for i, j in zip(*np.nonzero(z), strict=True)], "at long, to long, z double")
    got = np.array(sorted(tuple(r) for r in spectral.leading(spark, df, 160, 200, 6).collect()))[:, 1:]
    assert 3 in steps  # of the recurrence
    assert np.abs((got * want[:, ::-1][:, :6]).sum(axis=0)) == pytest.approx(np.ones(6), abs=1e-9)
