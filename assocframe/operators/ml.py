"""Models: leave-one-group-out validation, importances and a final ranking.

Fits run on Spark's own learners; the loop is over groups of files, of which
there are a few. A fold's imputation, screening and scaling see its training
rows alone. Linear models search their penalty (assocframe.operators.penalty)
unless they are given one; forests have 500 trees and boosting 300 rounds.
Extremely randomised trees and histogram boosting, which Spark lacks, and the forest,
whose many deep trees Spark's own grows slowly, are in assocframe.operators.trees."""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from assocframe.operators import penalty, ranking as rk, trees
from assocframe.runtime import materialise, release


class Celled(Estimator):
    """A learner on rows of equal features as one row: their mean label, and as its
    weight their number. For squared errors over all rows that asks for the same splits,
    as the spread within such rows is in both sides of a split's gain."""

    def __init__(self, inner: GBTRegressor):
        super().__init__()
        self.inner = inner

    def getMaxIter(self) -> int:  # Spark's names of these
        return self.inner.getMaxIter()

    def getStepSize(self) -> float:
        return self.inner.getStepSize()

    def _fit(self, dataset: DataFrame) -> Model:
        label, x = self.inner.getLabelCol(), vector_to_array("scaled").alias("_x")
        cells = dataset.select(x, F.col(label).cast("double").alias(label)).groupBy("_x").agg(F.avg(label).alias(label), F.count(F.lit(1)).cast("double").alias("_rows"))
        written = materialise(cells.select(array_to_vector("_x").alias("scaled"), label, "_rows"), "cells")
        model = self.inner.fit(written)
        release(written)
        return model


def learner(kind: str, label: str, **options):
    if kind in penalty.GRIDS and "alpha" not in options:
        return penalty.Search(kind, label)
    if kind in ("ridge", "lasso", "elastic_net"):
        mix = {"ridge": 0.0, "lasso": 1.0, "elastic_net": 0.5}[kind]
        return LinearRegression(featuresCol="scaled", labelCol=label, regParam=options["alpha"], elasticNetParam=options.get("l1_ratio", mix), maxIter=50)
    if kind == "forest":
        return trees.RandomForest(label, options.get("trees", 500))
    if kind == "boosting":
        return Celled(GBTRegressor(featuresCol="scaled", labelCol=label, weightCol="_rows", maxIter=options.get("trees", 300), stepSize=0.03, maxDepth=2, seed=42))
    if kind == "extra_trees":
        return trees.ExtraTrees(label, options.get("trees", 500))
    if kind == "hist_boosting":
        return trees.HistBoosting(label, options.get("trees", 300))
    raise ValueError(f"unknown learner {kind}")


def pipeline(features: list[str], label: str, kind: str = "ridge", **options) -> Pipeline:
    filled = [f"{f}_filled" for f in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=features, outputCols=filled, relativeError=1e-6),
        VectorAssembler(inputCols=filled, outputCol="raw"),
        VarianceThresholdSelector(featuresCol="raw", outputCol="varied", varianceThreshold=1e-12),
        StandardScaler(inputCol="varied", outputCol="scaled", withMean=True),
        learner(kind, label, **options),
    ])


def hold_one_out(df: DataFrame, features: list[str], label: str, group: str, kind: str = "ridge", least_train: int = 10, least_test: int = 2, **options) -> DataFrame:
    """Predictions of each group by a model of the others. Groups with too few
    rows on either side are skipped."""
    df = df.where(F.col(label).isNotNull()).cache()
    sizes = {r[group]: r["count"] for r in df.groupBy(group).count().collect()}
    out = None
    for g, n in sorted(sizes.items()):
        if n < least_test or sum(sizes.values()) - n < least_train:
            continue
        model = pipeline(features, label, kind, **options).fit(df.where(F.col(group) != g))
        # written, so that no model is kept, nor asked again by each metric
        found = materialise(model.transform(df.where(F.col(group) == g)).select(*df.columns, F.col("prediction").alias("fitted")), "fitted")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return df.withColumn("fitted", F.lit(None).cast("double")).limit(0)
    return out


def dump(model: PipelineModel, path: str, features: list[str], label: str, **told: str) -> None:
    """Write a fitted pipeline, with its features, label and what else is told of it, to
    a folder, in place of what is there."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(features, label, told)], "features array<string>, label string, told map<string, string>").coalesce(1).write.mode("overwrite").json(f"{path}/card")


def load(path: str) -> tuple[PipelineModel, list[str], str, dict[str, str]]:
    """(model, features, label, told) of a folder that dump() wrote."""
    card = SparkSession.active().read.schema("features array<string>, label string, told map<string, string>").json(f"{path}/card").first()
    return PipelineModel.load(f"{path}/model"), list(card.features), card.label, dict(card.told or {})


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Coefficients or tree importances by feature; 0 where screening dropped it."""
    kept = model.stages[2].selectedFeatures
    last = model.stages[-1]
    values = last.coefficients.toArray() if hasattr(last, "coefficients") else last.featureImportances.toArray()
    found = dict(zip([features[i] for i in kept], map(float, values), strict=True))
    return [(f, found.get(f, 0.0)) for f in features]


def evaluate(predictions: DataFrame, label: str, group: str, tie: str) -> DataFrame:
    """Per held-out group: regression and ranking metrics."""
    out = rk.regression_metrics(predictions, [group], label, "fitted")
    for part in (rk.ndcg(predictions, [group], label, "fitted", tie, 3), rk.top_overlap(predictions, [group], label, "fitted", tie, 3), rk.top1_hit(predictions, [group], label, "fitted")):
        out = out.join(part, group)
    return out


def best_model(comparison: DataFrame, key: list[str], metric: str, tie: str) -> DataFrame:
    return rk.top_k(comparison, key, [F.desc_nulls_last(metric), F.col(tie)], 1).drop("place")


def final_rank(df: DataFrame, features: list[str], label: str, group: str, tie: str, kind: str = "ridge") -> DataFrame:
    """All rows fitted and ranked within their group."""
    known = df.where(F.col(label).isNotNull())
    fitted = pipeline(features, label, kind).fit(known).transform(df).select(*df.columns, F.col("prediction").alias("fitted"))
    return fitted.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("fitted"), tie)))
