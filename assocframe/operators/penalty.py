"""Linear models whose penalty is chosen by cross-validation.

All fits of a search need only each part's count, means and products of columns,
so the rows are read once; the grid is walked on the driver over matrices of the
width of the features. Objectives are those of scikit-learn's RidgeCV, LassoCV
and ElasticNetCV, features in units of their population deviation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from assocframe.runtime import positions

#: kind: (alphas, shares of the absolute penalty)
GRIDS: dict[str, tuple[np.ndarray, tuple[float, ...]]] = {
    "ridge": (np.logspace(-4, 4, 100), (0.0,)),
    "lasso": (np.logspace(-4, 1, 80), (1.0,)),
    "elastic_net": (np.logspace(-4, 1, 80), (0.1, 0.3, 0.5, 0.7, 0.9)),
}


def moments(df: DataFrame, label: str, parts: int, rows: int) -> np.ndarray:
    """Per part the products of (1, features, label): parts of equal size in an
    order by hashes, so that they don't depend on the order of the rows."""
    z = F.concat(F.array(F.lit(1.0)), vector_to_array("scaled"), F.array(F.col(label).cast("double")))
    hashed = df.select(z.alias("z"), F.lit(0).alias("_g")).withColumn("_h", F.xxhash64("z"))
    # cells by the hash's first bits, so that no task has all rows
    nth = positions(hashed.withColumn("_c", F.shiftright("_h", 52)), ["_g"], ["_c"], ["_h", "z"])
    cut = nth.select("z", F.floor((F.col("position") - 1) * parts / rows).cast("int").alias("part"))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, g in b.groupby("part"):
                x = np.stack(g["z"].to_numpy())
                total[k] = total.get(k, 0.0) + x.T @ x
        yield pd.DataFrame({"part": list(total), "g": [v.ravel() for v in total.values()]})

    out = None
    for r in cut.mapInPandas(products, "part int, g array<double>").collect():
        width = round(len(r.g) ** 0.5)
        out = np.zeros((parts, width, width)) if out is None else out
        out[r.part] += np.reshape(r.g, (width, width))
    return out


def _split(g: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray]:
    n, x, y = g[0, 0], g[0, 1:-1] / g[0, 0], g[0, -1] / g[0, 0]
    return n, x, y, g[1:-1, 1:-1] - n * np.outer(x, x), g[1:-1, -1] - n * x * y


def _descend(s: np.ndarray, c: np.ndarray, w: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The minimum of w s w / 2 - c w + l1 |w| + l2 w w / 2, by coordinates."""
    w, at = w.copy(), np.diag(s)
    for _ in range(30_000):
        most = 0.0
        for j in range(len(w)):
            r = c[j] - s[j] @ w + at[j] * w[j]
            new = np.sign(r) * max(abs(r) - l1, 0.0) / (at[j] + l2) if at[j] + l2 > 0 else 0.0
            most, w[j] = max(most, abs(new - w[j])), new
        if most < 1e-10:
            break
    return w


def path(g: np.ndarray, kind: str, alphas: np.ndarray, share: float) -> list[np.ndarray]:
    """(intercept, coefficients) for each alpha; alphas fall."""
    n, x, y, s, c = _split(g)
    w, out = np.zeros(len(x)), []
    for a in alphas:
        w = np.linalg.solve(s + a * np.eye(len(x)), c) if kind == "ridge" else _descend(s / n, c / n, w, a * share, a * (1 - share))
        out.append(np.r_[y - x @ w, w])
    return out


def search(parts: np.ndarray, kind: str) -> tuple[float, float]:
    """The alpha and share with the best mean over held-out parts: of R2 for
    ridge (the least alpha of equal ones), else of the squared error (the
    greatest)."""
    total, (alphas, shares) = parts.sum(axis=0), GRIDS[kind]
    alphas = np.sort(alphas)[::-1]
    best = None
    for share in shares:
        loss = np.zeros(len(alphas))
        for held in parts:
            n, spread = held[0, 0], held[-1, -1] - held[0, -1] ** 2 / held[0, 0]
            v = np.array([np.r_[-w, 1.0] for w in path(total - held, kind, alphas, share)])
            error = np.einsum("ai,ij,aj->a", v, held, v)
            loss += (error / spread if spread > 0 else 0.0) if kind == "ridge" else error / n
        at = len(loss) - 1 - int(np.argmin(loss[::-1])) if kind == "ridge" else int(np.argmin(loss))
        if best is None or loss[at] < best[0]:
            best = (loss[at], float(alphas[at]), share)
    return best[1], best[2]


class Search(Estimator):
    def __init__(self, kind: str, label: str):
        super().__init__()
        self.kind, self.label = kind, label

    def _fit(self, dataset: DataFrame) -> Fitted:
        rows = dataset.count()
        g = moments(dataset, self.label, min(5, max(2, rows // 20)), rows)
        g = g[g[:, 0, 0] > 0]
        n, x, _, s, _ = _split(g.sum(axis=0))
        sd = np.sqrt(np.maximum(np.diag(s) / n, 0.0))
        sd[sd == 0] = 1.0
        to = np.eye(len(x) + 2)
        to[1:-1, 0], to[1:-1, 1:-1] = -x / sd, np.diag(1 / sd)
        g = to @ g @ to.T
        alpha, share = search(g, self.kind)
        w = path(g.sum(axis=0), self.kind, np.array([alpha]), share)[0]
        return Fitted(DenseVector(w[1:] / sd), float(w[0] - (w[1:] / sd) @ x), alpha, share)


class Fitted(Model, DefaultParamsWritable, DefaultParamsReadable):
    """A linear model; what it has are params, so that it can be saved and loaded."""

    weights = Param(Params._dummy(), "weights", "coefficients by feature", TypeConverters.toListFloat)
    constant = Param(Params._dummy(), "constant", "the intercept", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "the penalty and the share of its absolute part", TypeConverters.toListFloat)

    def __init__(self, coefficients: DenseVector | None = None, intercept: float = 0.0, alpha: float = 0.0, share: float = 0.0):
        super().__init__()
        self._set(weights=[] if coefficients is None else [float(c) for c in coefficients], constant=float(intercept), penalty=[float(alpha), float(share)])

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(self.getOrDefault("weights"))

    @property
    def intercept(self) -> float:
        return self.getOrDefault("constant")

    @property
    def alpha(self) -> float:
        return self.getOrDefault("penalty")[0]

    @property
    def share(self) -> float:
        return self.getOrDefault("penalty")[1]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        w = F.array(*[F.lit(float(c)) for c in self.coefficients])
        terms = F.zip_with(vector_to_array("scaled"), w, lambda a, b: a * b)
        return dataset.withColumn("prediction", F.aggregate(terms, F.lit(self.intercept), lambda a, b: a + b))
