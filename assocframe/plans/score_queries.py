"""Queries of scores by fold, of weights, columns and first rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assocframe.operators import dataset as ds, fold_evaluation as fe, prs, tests_of_significance as ts
from assocframe.plans.base import query, rounded
from assocframe.plans.model_queries import _DOSE, dosages
from assocframe.plans.views import view

_GRID = "g AS (SELECT 0.00001 + 0.05 * i AS threshold, CAST(i AS INT) AS step FROM range(20) t(i))"


@query("prsice_best_fit", f"""WITH {_DOSE}, {_GRID}, s AS (SELECT IID, step, sum(dosage * BETA) / (2 * count(*)) AS score FROM dose JOIN target USING (SNPID) JOIN g ON P <= threshold GROUP BY IID, step),
 r AS (SELECT step, count(*) AS samples, regr_r2(PHENO - 1, score) AS r2, regr_slope(PHENO - 1, score) AS beta FROM s JOIN samples USING (IID) WHERE PHENO > 0 GROUP BY step HAVING var_pop(score) > 0)
 SELECT step, samples, round(r2, 8) AS r2, round(beta, 6) + 0.0 AS beta, row_number() OVER (ORDER BY round(r2, 10) DESC, step) = 1 AS best FROM r""")
def prsice_best_fit(spark: SparkSession, d: str) -> DataFrame:
    """R2 of the phenotype on the score at each threshold, and the best."""
    grid = spark.range(20).select(F.col("id").cast("int").alias("step"), (F.lit(0.00001) + F.lit(0.05) * F.col("id")).alias("threshold"))
    scores = prs.score(dosages(spark, d), view(spark, d, "target"), grid)
    y = view(spark, d, "samples").where("PHENO > 0").select("IID", (F.col("PHENO") - 1).alias("y"))
    found = prs.best_fit(scores, y).join(F.broadcast(grid), "threshold")  # twenty rows
    return found.select("step", "samples", F.round("r2", 8).alias("r2"), (F.round("beta", 6) + 0.0).alias("beta"), "best")


_NULL = "0.5 + CAST(fold % 3 AS DOUBLE) / 50.0"


@query("fold_incremental", f"SELECT job_index, label, count(*) AS folds, round(avg(train - ({_NULL})), 8) + 0.0 AS train_incremental, round(avg(test - ({_NULL})), 8) + 0.0 AS test_incremental, round(avg(abs((train - ({_NULL})) - (test - ({_NULL})))), 8) AS gap FROM folds GROUP BY job_index, label")
def fold_incremental(spark: SparkSession, d: str) -> DataFrame:
    """What a model adds to the null model, by fold, and its mean over folds."""
    null = F.expr(_NULL)
    f = view(spark, d, "folds").select("job_index", "label", "fold", F.col("train").alias("train_best"), F.col("test").alias("test_best"), null.alias("train_null"), null.alias("test_null"))
    return rounded(fe.incremental_average(fe.incremental(f), ["job_index", "label"]))


@query("score_columns_shared", "SELECT job_index, label FROM folds GROUP BY job_index, label HAVING count(DISTINCT fold) = (SELECT count(DISTINCT fold) FROM folds)")
def score_columns_shared(spark: SparkSession, d: str) -> DataFrame:
    """Score columns that every fold of a file has."""
    return ds.in_every(view(spark, d, "folds"), ["job_index", "label"], "fold")


@query("agg_weights", "WITH w AS (SELECT label AS feature, fold, train - test AS weight FROM folds) SELECT feature, count(*) AS n, round(avg(weight), 8) + 0.0 AS mean, round(avg(abs(weight)), 8) AS mean_abs, round(stddev_samp(weight), 8) AS sd, round(100.0 * greatest(count(*) FILTER (WHERE weight > 0), count(*) FILTER (WHERE weight < 0)) / count(*), 8) AS same_sign_pct FROM w GROUP BY feature")
def agg_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ds.weights(view(spark, d, "folds").select(F.col("label").alias("feature"), (F.col("train") - F.col("test")).alias("weight")), "feature", "weight"))


_STANDARD = ("SNPID", "CHR", "POS", "EA", "NEA", "BETA", "SE", "P", "EAF", "MAF", "Z", "N")


@query("agg_standard_columns", " UNION ALL ".join(f"SELECT job_index, '{c}' AS column_name, count({c}) AS known, round(100.0 * count({c}) / count(*), 8) AS complete_pct FROM variants GROUP BY job_index" for c in _STANDARD))
def agg_standard_columns(spark: SparkSession, d: str) -> DataFrame:
    """How complete each standard column of each file is, in one pass."""
    return rounded(ds.completeness(view(spark, d, "variants"), ["job_index"], _STANDARD))


@query("head_rows", "SELECT job_index, row_id FROM (SELECT job_index, row_id, row_number() OVER (PARTITION BY job_index ORDER BY row_id) AS r FROM variants) WHERE r <= 25")
def head_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 rows of each file: the limit is what is asked for."""
    return ds.head(view(spark, d, "variants").select("job_index", "row_id"), ["job_index"], ["row_id"], 25)


_RANKED = "r AS (SELECT label, train - test AS x, rank() OVER (PARTITION BY label ORDER BY abs(train - test)) + (count(*) OVER (PARTITION BY label, abs(train - test)) - 1) / 2.0 AS r FROM folds WHERE train <> test)"


@query("wilcoxon_statistic", f"WITH {_RANKED} SELECT label, count(*) AS n, coalesce(sum(r) FILTER (WHERE x > 0), 0) AS w FROM r GROUP BY label")
def wilcoxon_statistic(spark: SparkSession, d: str) -> DataFrame:
    return ts.signed_ranks(view(spark, d, "folds").withColumn("gap", F.col("train") - F.col("test")), ["label"], "gap").select("label", "n", "w")


@query("t_statistic", "SELECT label, count(*) AS n, round(avg(train - test) * sqrt(count(*)) / stddev_samp(train - test), 6) AS t FROM folds GROUP BY label")
def t_statistic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ts.one_sample_t(view(spark, d, "folds").withColumn("gap", F.col("train") - F.col("test")), ["label"], "gap").select("label", "n", "t"), 6)
