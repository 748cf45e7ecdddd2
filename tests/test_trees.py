"""Randomised and boosted trees against plain versions."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from assocframe.operators import ml, trees
from assocframe.runtime import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def data(n, seed):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(size=n), rng.integers(0, 4, n), rng.random(n), np.ones(n)]
    return x, np.sin(2 * x[:, 0]) + (x[:, 1] > 1) + 0.1 * rng.normal(size=n)


def frame(spark, x, y):
    return spark.createDataFrame([(Vectors.dense(r), float(v)) for r, v in zip(x, y, strict=True)], ["scaled", "y"]).repartition(3)


def predicted(model, df):
    return np.array([r.prediction for r in model.transform(df).collect()]), np.array([r.y for r in df.collect()])


def test_randomised_trees_obey_their_rules(spark, monkeypatch):
    """Leaves hold their rows' means, two rows at least; thresholds lie between the
    least and the greatest value of the node; nothing that could be split is left."""
    monkeypatch.setattr(trees, "CELLS", 4 * 200 * 3)  # groups of three trees
    x, y = data(200, 1)
    model = trees.ExtraTrees("y", trees=7).fit(frame(spark, x, y))
    t = model.trees()
    assert len(t.feature) == 7 and len({tuple(r) for r in t.threshold}) == 7
    for k in range(7):
        todo = [(0, np.arange(200))]
        while todo:
            v, rows = todo.pop()
            f = t.feature[k, v]
            if f < 0:
                assert t.value[k, v] == pytest.approx(y[rows].mean()) and len(rows) >= 2
                continue
            c = x[rows, f]
            assert c.min() <= t.threshold[k, v] <= c.max()
            left = c <= t.threshold[k, v]
            assert left.sum() >= 2 and (~left).sum() >= 2
            todo += [(t.left[k, v], rows[left]), (t.left[k, v] + 1, rows[~left])]
    again = trees.ExtraTrees("y", trees=7).fit(frame(spark, x[::-1], y[::-1])).trees()
    assert (again.feature == t.feature).all() and again.threshold == pytest.approx(t.threshold)


def test_randomised_trees_learn(spark):
    x, y = data(300, 2)
    model = trees.ExtraTrees("y", trees=60).fit(frame(spark, x[:200], y[:200]))
    p, held = predicted(model, frame(spark, x[200:], y[200:]))
    assert 1 - ((p - held) ** 2).mean() / held.var() > 0.8


def plain_boosting(x, y, rounds, rate, leaves, least, l2):
    """Best first, one leaf at a time, over all cuts."""
    p = np.full(len(y), y.mean())
    for _ in range(rounds):
        g, parts = y - p, [np.arange(len(y))]

        def best(rows, g=g):
            top, n, s = (-np.inf,), len(rows), g[rows].sum()
            for f in range(x.shape[1]):
                u = np.unique(x[:, f])
                for i, c in enumerate((u[1:] + u[:-1]) / 2):
                    left = x[rows, f] <= c
                    k = left.sum()
                    if k >= least and n - k >= least:
                        a = g[rows[left]].sum()
                        gain = a**2 / (k + l2) + (s - a) ** 2 / (n - k + l2) - s**2 / (n + l2)
                        top = max(top, (gain, -f, -i, c), key=lambda z: z[:3])
            return top

        splits = [best(parts[0])]
        while len(parts) < leaves:
            i = max(range(len(parts)), key=lambda i: splits[i][0])
            if not splits[i][0] > 1e-12:
                break
            rows, (_, f, _, c) = parts.pop(i), splits.pop(i)
            left = x[rows, -f] <= c
            for part in (rows[left], rows[~left]):
                parts.append(part)
                splits.append(best(part))
        for rows in parts:
            p[rows] += rate * g[rows].sum() / (len(rows) + l2)
    return p


@pytest.mark.parametrize("rebuild, leaves, least", [(2, 5, 4), (20, 15, 20)])
def test_boosting_is_the_plain_one(spark, monkeypatch, rebuild, leaves, least):
    monkeypatch.setattr(trees, "REBUILD", rebuild)
    x, y = data(120, 3)
    x = np.round(x, 1)
    df = frame(spark, x, y)
    p, held = predicted(trees.HistBoosting("y", rounds=5, rate=0.3, leaves=leaves, least=least).fit(df), df)
    want = plain_boosting(x, y, 5, 0.3, leaves, least, 0.1)
    assert sorted(zip(held, p, strict=True)) == [(pytest.approx(a), pytest.approx(b)) for a, b in sorted(zip(y, want, strict=True))]


@pytest.mark.parametrize("kind", ["extra_trees", "hist_boosting"])
def test_in_a_pipeline_saved_and_loaded(spark, tmp_path, kind):
    x, y = data(60, 4)
    df = spark.createDataFrame([(*map(float, r), None if i % 7 == 0 else float(r[0]), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, d double, e double, y double")
    model = ml.pipeline(list("abcde"), "y", kind, trees=5).fit(df)
    ml.dump(model, str(tmp_path / "m"), list("abcde"), "y")
    back = ml.load(str(tmp_path / "m"))[0]
    read = lambda m: [r.prediction for r in m.transform(df).select("prediction").collect()]
    assert read(back) == read(model) and len(set(read(model))) > 3
    assert len(trees.Trees(0).values(np.zeros((2, 3))).sum(axis=1)) == 2


@pytest.mark.parametrize("local", [1 << 20, 0])
def test_rows_of_equal_features_are_one_cell(spark, monkeypatch, local):
    """Ten times the rows over the same features: the trees of the plain way, without a
    job for each level where the cells are few."""
    monkeypatch.setattr(trees, "LOCAL", local)
    x, y = data(40, 5)
    x, y = np.tile(np.round(x, 1), (10, 1)), np.concatenate([y + k / 10 for k in range(10)])
    df = frame(spark, x, y)
    passes, told = [], trees._told
    monkeypatch.setattr(trees, "_told", lambda blocks, *a: passes.append(isinstance(blocks, list)) or told(blocks, *a))
    model = trees.HistBoosting("y", rounds=4, rate=0.3, leaves=4, least=20).fit(df)
    assert passes and set(passes) == {bool(local)}
    p, held = predicted(model, df)
    want = plain_boosting(x, y, 4, 0.3, 4, 20, 0.1)
    assert sorted(zip(held, p, strict=True)) == [(pytest.approx(a), pytest.approx(b)) for a, b in sorted(zip(y, want, strict=True))]
    t = trees.ExtraTrees("y", trees=3).fit(df).trees()
    leaf = t.nodes(x)
    for k in range(3):
        for v in np.unique(leaf[:, k]):
            assert t.value[k, v] == pytest.approx(y[leaf[:, k] == v].mean())


def test_joined_trees_have_no_more_room_than_nodes():
    """Trees of different sizes, joined again round after round, as boosting does."""
    made = []
    for k in range(40):
        t = trees.Trees(1)
        for v in range(k % 3 + 1):
            t.split(np.array([0]), np.array([2 * v]), np.array([0]), np.array([0.5]))
        made.append(t)
        whole = trees.Trees.joined(made)
        assert whole.feature.shape[1] == max(int(m.size[0]) for m in made) and max(m.feature.shape[1] for m in made) < 20


def test_boosting_fits_a_row_for_each_set_of_features(spark):
    """As the learner does over all rows, which copies would otherwise multiply."""
    x, y = data(24, 6)
    x, y = np.tile(np.round(x, 1), (5, 1)), np.concatenate([y + k / 7 for k in range(5)])
    df = frame(spark, x, y)
    cells, seen = ml.learner("boosting", "y", trees=6), []
    whole = cells.inner.copy()
    whole.clear(whole.weightCol)
    inner = cells.inner
    cells.inner = type("Spy", (), {"getLabelCol": inner.getLabelCol, "fit": lambda self, d: seen.append(d.count()) or inner.fit(d)})()
    got, want = predicted(cells.fit(df), df)[0], predicted(whole.fit(df), df)[0]
    assert seen == [24] and sorted(got) == pytest.approx(sorted(want))


def test_a_forest_draws_rows_wherever_they_are(spark, monkeypatch):
    """Leaves hold the means of what their tree draws, two rows at least, by Poisson's law,
    and copies are drawn like others; the same trees whatever the partitions."""
    x, y = data(150, 7)
    x[:, [0, 2]] = np.round(x[:, [0, 2]], 1)
    x, y = np.concatenate([x, x[:40]]), np.concatenate([y, y[:40]])
    model = ml.learner("forest", "y", trees=45).fit(frame(spark, x, y))
    again = ml.learner("forest", "y", trees=45).fit(frame(spark, x[::-1], y[::-1]).coalesce(1))
    t = model.trees()
    assert len(t.feature) == 45 and (again.trees().feature == t.feature).all() and again.trees().threshold == pytest.approx(t.threshold)
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    equal = frame(spark, x, y).select(vector_to_array("scaled").alias("x"), "y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("x", "y")).collect()
    draws = np.stack([np.random.Generator(np.random.Philox(key=np.array([np.int64(r.h).view(np.uint64), 42], np.uint64))).poisson(r.n, 45) for r in equal])
    assert len(equal) == 150 and draws.mean() == pytest.approx(190 / 150, abs=0.05)
    leaf = t.nodes(np.array([r.x for r in equal]))
    label = np.array([r.y for r in equal])
    for k in range(45):
        for v in np.unique(leaf[draws[:, k] > 0, k]):
            on = leaf[:, k] == v
            assert draws[on, k].sum() >= 2
            assert t.value[k, v] + y.mean() == pytest.approx(np.average(label[on], weights=draws[on, k]))
    share = model.featureImportances.toArray()
    assert share.sum() == pytest.approx(1) and share.argmax() == 0 and share[3] == 0
    filled = len({tuple((x[i, f] > t.threshold[(t.feature == f)]).sum() for f in range(4)) for i in range(len(x))})
    monkeypatch.setattr(trees, "LOCAL", 7 * filled // 2)  # many cells: Spark's own
    assert ml.learner("forest", "y", trees=3).fit(frame(spark, x, y)).getNumTrees == 3


def test_a_forest_learns_as_sparks_own(spark):
    from pyspark.ml.regression import RandomForestRegressor

    x, y = data(300, 8)
    ours = ml.learner("forest", "y", trees=100).fit(frame(spark, x[:200], y[:200]))
    own = RandomForestRegressor(featuresCol="scaled", labelCol="y", numTrees=100, minInstancesPerNode=2, maxDepth=30, featureSubsetStrategy="all", seed=42).fit(frame(spark, x[:200], y[:200]))
    (p, held), (q, _) = (predicted(m, frame(spark, x[200:], y[200:])) for m in (ours, own))
    assert 1 - ((p - held) ** 2).mean() / held.var() > 0.8
    assert ((p - held) ** 2).mean() < 1.25 * ((q - held) ** 2).mean(), (((p - held) ** 2).mean(), ((q - held) ** 2).mean())
    assert ours.featureImportances.toArray() == pytest.approx(own.featureImportances.toArray(), abs=0.05)


def test_few_values_have_a_bin_each(spark):
    """Whatever their shares: a rare value isn't joined with its neighbour."""
    x = np.repeat(np.arange(10.0), [1000, 4, 4, 4, 4, 4, 4, 4, 4, 4])[:, None]
    y = np.where(x[:, 0] % 2 > 0, 1.0, -1.0)
    p, label = predicted(ml.learner("forest", "y", trees=200).fit(frame(spark, x, y)), frame(spark, x, y))
    assert np.abs(p - label).max() < 0.35
