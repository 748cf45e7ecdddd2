"""Queries of ranking, datasets, reports and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assocframe.functions import stats as st
from assocframe.operators import allelic, dataset as ds, fold_evaluation as fe, ld, order, profile as p, prs, ranking as rk, report as rp
from assocframe.plans.base import query, rounded
from assocframe.plans.views import view
from assocframe.runtime import materialise, positions, release, shuffles_dropped


def _f(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "features")


# ranks and rates

@query("rank_min_desc", "SELECT job_index, phenotype, CAST(rank() OVER (PARTITION BY phenotype ORDER BY round(target, 1) DESC NULLS LAST) AS INT) AS place FROM features")
def rank_min_desc(spark, d):
    return rk.rank_min_desc(_f(spark, d).withColumn("t", F.round("target", 1)), ["phenotype"], "t").select("job_index", "phenotype", "place")


@query("rank_first", "SELECT job_index, CAST(row_number() OVER (PARTITION BY phenotype ORDER BY f_size DESC NULLS LAST, job_index) AS INT) AS place FROM features")
def rank_first(spark, d):
    return rk.rank_first(_f(spark, d), ["phenotype"], "f_size", "job_index").select("job_index", "place")


@query("cumcount", "SELECT job_index, CAST(row_number() OVER (PARTITION BY phenotype ORDER BY f_rate DESC, f_size ASC NULLS LAST, job_index) AS INT) AS place FROM features")
def cumcount(spark, d):
    return rk.top_k(_f(spark, d), ["phenotype"], [F.desc("f_rate"), F.col("f_size").asc_nulls_last(), "job_index"], 1 << 30).select("job_index", "place")


@query("topk_per_group", "SELECT phenotype, job_index, place FROM (SELECT phenotype, job_index, CAST(row_number() OVER (PARTITION BY phenotype ORDER BY target DESC, job_index) AS INT) AS place FROM features) WHERE place <= 3")
def topk_per_group(spark, d):
    return rk.top_k(_f(spark, d), ["phenotype"], [F.desc("target"), "job_index"], 3).select("phenotype", "job_index", "place")


@query("average_rank", "SELECT job_index, rank() OVER (PARTITION BY phenotype ORDER BY round(f_rate, 1)) + (count(*) OVER (PARTITION BY phenotype, round(f_rate, 1)) - 1) / 2.0 AS r FROM features")
def average_rank(spark, d):
    return p.average_ranks(_f(spark, d).withColumn("x", F.round("f_rate", 1)), ["phenotype"], ["x"]).select("job_index", F.col("r_x").alias("r"))


@query("transform_map_back", "SELECT job_index, round(target - avg(target) OVER (PARTITION BY phenotype), 8) + 0.0 AS centred FROM features")
def transform_map_back(spark, d):
    from pyspark.sql import Window

    return rounded(_f(spark, d).select("job_index", (F.col("target") - F.avg("target").over(Window.partitionBy("phenotype"))).alias("centred")))


_BH = "least(1.0, min(p_value * n / r) OVER (PARTITION BY {0} ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


@query("bh_fdr", f"WITH r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p_value, job_index) AS r FROM features) SELECT job_index, round({_BH.format('1')}, 8) AS q FROM r")
def bh_fdr(spark, d):
    return rounded(rk.bh_fdr(_f(spark, d), [], "p_value", "job_index").select("job_index", "q"))


@query("bh_fdr_grouped", f"WITH r AS (SELECT *, count(*) OVER (PARTITION BY phenotype) AS n, row_number() OVER (PARTITION BY phenotype ORDER BY p_value, job_index) AS r FROM features) SELECT job_index, round({_BH.format('phenotype')}, 8) AS q FROM r")
def bh_fdr_grouped(spark, d):
    return rounded(rk.bh_fdr(_f(spark, d), ["phenotype"], "p_value", "job_index").select("job_index", "q"))


_PLACED = "r AS (SELECT phenotype, target, target - min(target) OVER (PARTITION BY phenotype) AS g, row_number() OVER (PARTITION BY phenotype ORDER BY target DESC, job_index) AS a, row_number() OVER (PARTITION BY phenotype ORDER BY predicted DESC, job_index) AS p FROM features)"


@query("ndcg", f"WITH {_PLACED} SELECT phenotype, round(CASE WHEN count(*) >= 2 AND max(g) > 0 THEN sum(CASE WHEN p <= 3 THEN g / log2(p + 1.0) END) / sum(CASE WHEN a <= 3 THEN g / log2(a + 1.0) END) END, 8) AS ndcg_3 FROM r GROUP BY phenotype")
def ndcg(spark, d):
    return rounded(rk.ndcg(_f(spark, d), ["phenotype"], "target", "predicted", "job_index", 3))


@query("top_overlap", f"WITH {_PLACED} SELECT phenotype, round(CAST(count(*) FILTER (WHERE a <= 3 AND p <= 3) AS DOUBLE) / least(count(*), 3), 8) AS overlap_3 FROM r GROUP BY phenotype")
def top_overlap(spark, d):
    return rounded(rk.top_overlap(_f(spark, d), ["phenotype"], "target", "predicted", "job_index", 3))


@query("top1", "WITH r AS (SELECT phenotype, target = max(target) OVER (PARTITION BY phenotype) AND predicted = max(predicted) OVER (PARTITION BY phenotype) AS hit FROM features) SELECT phenotype, bool_or(hit) AS top1 FROM r GROUP BY phenotype")
def top1(spark, d):
    return rk.top1_hit(_f(spark, d), ["phenotype"], "target", "predicted")


def _rank(x: str) -> str:
    return f"rank() OVER (PARTITION BY phenotype ORDER BY {x}) + (count(*) OVER (PARTITION BY phenotype, {x}) - 1) / 2.0"


@query("regression_metrics", f"""WITH r AS (SELECT phenotype, target AS t, predicted AS q, target - predicted AS e, {_rank('target')} AS a, {_rank('predicted')} AS b, avg(target) OVER (PARTITION BY phenotype) AS m FROM features)
 SELECT phenotype, count(*) AS n, round(avg(abs(e)), 8) AS mae, round(sqrt(avg(e * e)), 8) AS rmse, round(1 - sum(e * e) / nullif(sum((t - m) * (t - m)), 0), 8) AS r2, round(avg(abs(a - b)), 8) AS rank_error,
 round(CASE WHEN count(*) >= 3 THEN covar_samp(t, q) / nullif(stddev_samp(t) * stddev_samp(q), 0) END, 8) AS pearson, round(CASE WHEN count(*) >= 3 THEN covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) END, 8) AS spearman FROM r GROUP BY phenotype""")
def regression_metrics(spark, d):
    return rounded(rk.regression_metrics(_f(spark, d), ["phenotype"], "target", "predicted"))


@query("kendall", """SELECT a.phenotype, round(CAST(sum(sign(a.target - b.target) * sign(a.f_rate - b.f_rate)) AS DOUBLE) / nullif(sqrt(CAST(count(*) FILTER (WHERE a.target <> b.target) AS DOUBLE) * count(*) FILTER (WHERE a.f_rate <> b.f_rate)), 0), 8) + 0.0 AS tau
 FROM features a JOIN features b ON a.phenotype = b.phenotype AND a.job_index < b.job_index GROUP BY a.phenotype""")
def kendall(spark, d):
    return rounded(order.kendall(_f(spark, d), ["phenotype"], "target", "f_rate").where("n > 1").select("phenotype", "tau"))


@query("bootstrap")
def bootstrap(spark, d):
    return rk.bootstrap(_f(spark, d), ["phenotype"], "target")


@query("permutation")
def permutation(spark, d):
    return rk.permutation(_f(spark, d), ["phenotype"], "target", "predicted")


@query("agg_target_corr", """WITH r AS (SELECT rank() OVER (ORDER BY target) + (count(*) OVER (PARTITION BY target) - 1) / 2.0 AS a, rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2.0 AS b FROM features)
 SELECT count(*) AS pairs, round(covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b)), 8) AS rho FROM r""")
def agg_target_corr(spark, d):
    return rounded(p.spearman(_f(spark, d).withColumn("k", F.lit(1)), ["k"], "target", "predicted").drop("k"))


@query("fisher_combine", "SELECT phenotype, count(*) AS n, round(-2 * sum(ln(p_value)), 8) AS chi2, CAST(2 * count(*) AS BIGINT) AS dof FROM features WHERE p_value > 0 GROUP BY phenotype")
def fisher_combine(spark, d):
    return rounded(_f(spark, d).where("p_value > 0").groupBy("phenotype").agg(F.count(F.lit(1)).alias("n"), (-2 * F.sum(F.log("p_value"))).alias("chi2"), (2 * F.count(F.lit(1))).alias("dof")))


@query("significance_label", "SELECT job_index, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE 'ns' END AS label FROM features")
def significance_label(spark, d):
    return _f(spark, d).select("job_index", st.significance(F.col("p_value")).alias("label"))


# datasets

@query("join_feature_merge", """WITH a AS (SELECT job_index, count(*) AS rows FROM variants GROUP BY job_index), b AS (SELECT job_index, max(test) AS best FROM folds WHERE job_index < 15 GROUP BY job_index)
 SELECT j.job_index, phenotype, a.rows AS f4_rows, CASE WHEN a.job_index IS NULL THEN 'missing_job_row' ELSE 'present' END AS f4_status, round(b.best, 8) AS prs_best, CASE WHEN b.job_index IS NULL THEN 'missing_job_row' ELSE 'present' END AS prs_status FROM jobs j LEFT JOIN a USING (job_index) LEFT JOIN b USING (job_index)""")
def join_feature_merge(spark, d):
    a = view(spark, d, "variants").groupBy("job_index").agg(F.count(F.lit(1)).alias("rows"))
    b = view(spark, d, "folds").where("job_index < 15").groupBy("job_index").agg(F.max("test").alias("best"))
    return rounded(ds.merge_features(view(spark, d, "jobs").select("job_index", "phenotype"), {"f4": a, "prs": b}))


@query("join_model_data", "SELECT f.phenotype, f.accession, round(f.f_rate, 8) AS f_rate, round(j.perf, 8) AS perf FROM features f JOIN jobs j ON f.phenotype = j.phenotype AND f.accession = j.accession")
def join_model_data(spark, d):
    return rounded(ds.one_to_one(_f(spark, d).select("phenotype", "accession", "f_rate"), view(spark, d, "jobs").select("phenotype", "accession", "perf"), ["phenotype", "accession"]))


@query("join_tool_wide", "SELECT j.job_index, round(max(test) FILTER (WHERE label = '1-URGENT'), 8) AS urgent, round(max(test) FILTER (WHERE label = '2-HIGH'), 8) AS high FROM jobs j LEFT JOIN folds f ON j.job_index = f.job_index GROUP BY j.job_index")
def join_tool_wide(spark, d):
    wide = view(spark, d, "folds").groupBy("job_index").pivot("label", ["1-URGENT", "2-HIGH"]).agg(F.max("test")).withColumnsRenamed({"1-URGENT": "urgent", "2-HIGH": "high"})
    return rounded(view(spark, d, "jobs").select("job_index").join(wide, "job_index", "left"))


@query("union_by_name", "SELECT job_index, phenotype, NULL AS perf FROM features UNION ALL SELECT job_index, phenotype, round(perf, 8) FROM jobs")
def union_by_name(spark, d):
    return rounded(ds.union_by_name([_f(spark, d).select("job_index", "phenotype"), view(spark, d, "jobs").select("phenotype", "job_index", "perf")]))


@query("feature_screen", " UNION ALL ".join(f"""SELECT '{c}' AS feature, count({c}) AS present, count(*) AS rows, count(DISTINCT {c}) AS "distinct", round(1 - CAST(count({c}) AS DOUBLE) / count(*), 8) AS missing_share,
 CASE WHEN count({c}) < 10 THEN 'too_few_values' WHEN 1 - CAST(count({c}) AS DOUBLE) / count(*) > 0.5 THEN 'too_many_missing' WHEN count(DISTINCT {c}) < 2 THEN 'constant' ELSE 'kept' END AS decision FROM features""" for c in ("f_size", "f_rate", "f_const", "f_sparse")))
def feature_screen(spark, d):
    return rounded(ds.screen(_f(spark, d), ["f_size", "f_rate", "f_const", "f_sparse"]))


@query("gap_quality", "SELECT job_index, fold, label, round(-abs(train - test), 8) + 0.0 AS gap_quality, round(test - abs(train - test), 8) AS stability, round(train + test, 8) AS \"both\" FROM folds")
def gap_quality(spark, d):
    return rounded(ds.targets(view(spark, d, "folds")).select("job_index", "fold", "label", "gap_quality", "stability", "both"))


@query("prefix_columns", "SELECT job_index, round(f_rate, 8) AS f9_f_rate, round(f_size, 8) AS f9_f_size FROM features")
def prefix_columns(spark, d):
    v = _f(spark, d).select("job_index", "f_rate", "f_size")
    return rounded(v.withColumnsRenamed({c: f"f9_{c}" for c in v.columns if c != "job_index"}))


@query("reorder_columns", "SELECT accession, job_index, phenotype FROM jobs")
def reorder_columns(spark, d):
    v = view(spark, d, "jobs").select("job_index", "phenotype", "accession")
    first = ["accession"]
    return v.select(*first, *[c for c in v.columns if c not in first])


@query("agg_schema_uniqueness", """WITH u AS (SELECT 'phenotype' AS "column", phenotype AS v FROM features UNION ALL SELECT 'accession', accession FROM features), c AS (SELECT "column", v, count(*) AS n FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS r FROM c)
 SELECT "column", CAST(sum(n) AS BIGINT) AS present, count(*) AS "distinct", min(v) FILTER (WHERE r = 1) AS mode, max(n) AS mode_count FROM r GROUP BY "column" """)
def agg_schema_uniqueness(spark, d):
    return ds.unique_schema(_f(spark, d).select("phenotype", "accession"))


@query("agg_constant_columns", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\", count(DISTINCT {c}) <= 1 AS constant FROM features" for c in ("f_size", "f_const", "phenotype")))
def agg_constant_columns(spark, d):
    return ds.constant_columns(_f(spark, d).select("f_size", "f_const", "phenotype"))


@query("agg_duplicate_columns", "SELECT 'again,f_rate' AS columns FROM (SELECT count(*) AS n FROM features WHERE f_rate IS NOT NULL) WHERE n > 0")
def agg_duplicate_columns(spark, d):
    return ds.duplicate_columns(_f(spark, d).select("job_index", "f_rate", "f_size", F.col("f_rate").alias("again")), "job_index")


# reports

@query("agg_describe_categorical", "SELECT o_orderpriority AS value, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM orders), 8) AS pct FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def agg_describe_categorical(spark, d):
    return rounded(rp.categorical(spark.read.parquet(f"{d}/orders.parquet"), "o_orderpriority"))


_Q = ", ".join(f"round(quantile_cont(v, {q / 100}), 8) AS p{q}" for q in (5, 25, 50, 75, 95))


@query("agg_describe_numeric", f"""WITH u AS (SELECT 'f_size' AS metric, f_size AS v FROM features UNION ALL SELECT 'f_rate', f_rate FROM features) SELECT metric, count(v) AS n, round(100.0 * (count(*) - count(v)) / count(*), 8) AS missing_pct, round(min(v), 8) AS min, {_Q}, round(avg(v), 8) AS mean, round(max(v), 8) AS max, round(stddev_samp(v), 8) AS sd FROM u GROUP BY metric""")
def agg_describe_numeric(spark, d):
    return rounded(rp.numeric(_f(spark, d), ["f_size", "f_rate"]))


@query("agg_heritability_table", f"""WITH u AS (SELECT phenotype, 'f_rate' AS metric, f_rate AS v FROM features) SELECT phenotype, metric, count(v) AS n, round(100.0 * (count(*) - count(v)) / count(*), 8) AS missing_pct, round(min(v), 8) AS min, {_Q}, round(avg(v), 8) AS mean, round(max(v), 8) AS max, round(stddev_samp(v), 8) AS sd FROM u GROUP BY ALL""")
def agg_heritability_table(spark, d):
    return rounded(rp.numeric(_f(spark, d), ["f_rate"], ["phenotype"]))


@query("agg_describe_boolean", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS value, count(*) AS count FROM orders GROUP BY 1")
def agg_describe_boolean(spark, d):
    return rp.boolean(spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderstatus") == "F").alias("f")), "f")


@query("agg_zero_nonzero", "SELECT count(*) FILTER (WHERE l_discount = 0) AS zero, count(*) FILTER (WHERE l_discount <> 0) AS nonzero, count(*) FILTER (WHERE l_discount IS NULL) AS missing FROM lineitem")
def agg_zero_nonzero(spark, d):
    return rp.zero_nonzero(spark.read.parquet(f"{d}/lineitem.parquet"), "l_discount")


def _band_sql(x: str, edges: list[float]) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'missing' WHEN {x} < {edges[0]} THEN '< {edges[0]:g}' " + " ".join(f"WHEN {x} >= {a} AND {x} < {b} THEN '{a:g} - {b:g}'" for a, b in zip(edges, edges[1:], strict=False)) + f" ELSE '>= {edges[-1]:g}' END"


@query("agg_bucket_counts", f"SELECT {_band_sql('test', [0.55, 0.6, 0.7, 0.8])} AS band, count(*) AS rows FROM folds GROUP BY 1")
def agg_bucket_counts(spark, d):
    return rp.bands(view(spark, d, "folds"), "test", [0.55, 0.6, 0.7, 0.8])


@query("agg_quality_bands", f"SELECT phenotype, {_band_sql('f_size', [10, 50, 90])} AS band, count(*) AS rows FROM features GROUP BY ALL")
def agg_quality_bands(spark, d):
    return rp.bands(_f(spark, d), "f_size", [10, 50, 90], ["phenotype"])


@query("describe_auto", "SELECT 'f_size' AS \"column\", count(f_size) AS present, count(DISTINCT f_size) AS \"distinct\", 'numeric' AS kind FROM features UNION ALL SELECT 'phenotype', count(phenotype), count(DISTINCT phenotype), 'categorical' FROM features UNION ALL SELECT 'sex', count(*), 2, 'boolean' FROM features")
def describe_auto(spark, d):
    return rp.describe_auto(_f(spark, d).withColumn("sex", (F.col("job_index") % 2).cast("string")), ["f_size", "phenotype", "sex"])


@query("agg_by_phenotype", "SELECT phenotype, count(f_size) AS n, round(min(f_size), 8) AS min, round(median(f_size), 8) AS median, round(max(f_size), 8) AS max FROM features GROUP BY phenotype")
def agg_by_phenotype(spark, d):
    return rounded(rp.by_group(_f(spark, d), ["phenotype"], "f_size"))


@query("agg_group_size", "SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY ALL ORDER BY 3 DESC, 1, 2 LIMIT 5")
def agg_group_size(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderstatus", "o_orderpriority").count().orderBy(F.desc("count"), "o_orderstatus", "o_orderpriority").limit(5)


@query("explode_list_count", "SELECT w AS item, count(*) AS count FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE trim(w) <> '' GROUP BY w ORDER BY 2 DESC, 1 LIMIT 20")
def explode_list_count(spark, d):
    return rp.list_counts(spark.read.parquet(f"{d}/part.parquet"), "p_name", " ")


@query("agg_completeness", "WITH h AS (SELECT DISTINCT job_index, fold FROM folds WHERE fold < 3 AND job_index < 17), f AS (SELECT job_index, count(*) AS n FROM h GROUP BY job_index) SELECT phenotype, count(*) FILTER (WHERE n = 3) AS complete, count(*) FILTER (WHERE n IS NULL OR n < 3) AS incomplete FROM jobs LEFT JOIN f USING (job_index) GROUP BY phenotype")
def agg_completeness(spark, d):
    have = view(spark, d, "folds").where("fold < 3 and job_index < 17").select("job_index", F.concat(F.lit("f"), "fold").alias("part"))
    return rp.completeness(have, view(spark, d, "jobs"), ["f0", "f1", "f2"])


@query("agg_generalisation_gap", "SELECT label, count(*) FILTER (WHERE train - test > 0.05) AS over, count(*) FILTER (WHERE abs(train - test) <= 0.05) AS near, count(*) FILTER (WHERE train - test < -0.05) AS under FROM folds GROUP BY label")
def agg_generalisation_gap(spark, d):
    g = F.col("train") - F.col("test")
    return view(spark, d, "folds").groupBy("label").agg(F.count_if(g > 0.05).alias("over"), F.count_if(F.abs(g) <= 0.05).alias("near"), F.count_if(g < -0.05).alias("under"))


@query("agg_tool_comparison", "SELECT phenotype, count(*) AS n, round(avg(target - predicted), 8) AS mean_diff, round(median(target - predicted), 8) AS median_diff, count(*) FILTER (WHERE target > predicted) AS first_wins, count(*) FILTER (WHERE target < predicted) AS second_wins FROM features GROUP BY phenotype")
def agg_tool_comparison(spark, d):
    g = F.col("target") - F.col("predicted")
    return rounded(_f(spark, d).groupBy("phenotype").agg(F.count(F.lit(1)).alias("n"), F.avg(g).alias("mean_diff"), F.percentile(g, 0.5).alias("median_diff"), F.count_if(g > 0).alias("first_wins"), F.count_if(g < 0).alias("second_wins")))


@query("agg_run_reason", "SELECT job_index, CASE WHEN bool_and(test < 0.6) THEN 'all_weak' WHEN bool_or(test > 0.79) THEN 'some_strong' ELSE 'mixed' END AS reason, mode(label) IS NOT NULL AS has_mode FROM folds GROUP BY job_index")
def agg_run_reason(spark, d):
    return view(spark, d, "folds").groupBy("job_index").agg(F.when(F.bool_and(F.col("test") < 0.6), "all_weak").when(F.bool_or(F.col("test") > 0.79), "some_strong").otherwise("mixed").alias("reason"), F.mode("label").isNotNull().alias("has_mode"))


@query("agg_importance", "SELECT label AS feature, count(*) AS n, round(avg(test), 8) AS mean, round(stddev_samp(test), 8) AS sd, round(median(test), 8) AS median, round(max(test), 8) AS max, count(DISTINCT fold) AS folds FROM folds GROUP BY label")
def agg_importance(spark, d):
    x = F.col("test")
    return rounded(view(spark, d, "folds").groupBy(F.col("label").alias("feature")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.percentile(x, 0.5).alias("median"), F.max(x).alias("max"), F.count_distinct("fold").alias("folds")))


@query("agg_feature_stability", """WITH w AS (SELECT label, train - test AS v FROM folds), a AS (SELECT label, count(*) FILTER (WHERE v > 0) AS pos, count(*) FILTER (WHERE v < 0) AS neg, CAST(count(*) FILTER (WHERE abs(v) > 0.05) AS DOUBLE) / count(*) AS freq, avg(v) AS m, stddev_samp(v) / sqrt(count(*)) AS se FROM w GROUP BY label)
 SELECT label, pos AS positive, neg AS negative, round(freq, 8) AS selected, round(CAST(greatest(pos, neg) AS DOUBLE) / nullif(pos + neg, 0), 8) AS consistency, freq >= 0.5 AND CAST(greatest(pos, neg) AS DOUBLE) / nullif(pos + neg, 0) >= 0.7 AND abs(m) > 1.96 * se AS stable FROM a""")
def agg_feature_stability(spark, d):
    v = F.col("train") - F.col("test")
    a = view(spark, d, "folds").groupBy("label").agg(F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"), (F.count_if(F.abs(v) > 0.05) / F.count(F.lit(1))).alias("selected"), F.avg(v).alias("m"), (F.stddev_samp(v) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    steady = F.try_divide(F.greatest("positive", "negative"), F.col("positive") + F.col("negative"))
    return rounded(a.select("label", "positive", "negative", "selected", steady.alias("consistency"), ((F.col("selected") >= 0.5) & (steady >= 0.7) & (F.abs("m") > 1.96 * F.col("se"))).alias("stable")))


@query("agg_model_comparison", """WITH u AS (SELECT label, 'train' AS metric, train AS v FROM folds UNION ALL SELECT label, 'test', test FROM folds) SELECT label, metric, count(*) AS n, round(avg(v), 8) AS mean, round(stddev_samp(v), 8) AS sd, round(stddev_samp(v) / sqrt(count(*)), 8) AS se, round(median(v), 8) AS median, round(min(v), 8) AS min, round(max(v), 8) AS max FROM u GROUP BY ALL""")
def agg_model_comparison(spark, d):
    v = F.col("v")
    long = view(spark, d, "folds").unpivot(["label"], ["train", "test"], "metric", "v")
    return rounded(long.groupBy("label", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), (F.stddev_samp(v) / F.sqrt(F.count(F.lit(1)))).alias("se"), F.percentile(v, 0.5).alias("median"), F.min(v).alias("min"), F.max(v).alias("max")))


@query("problem_files", "SELECT job_index, phenotype FROM features WHERE f_size IS NULL OR f_rate < 0.1 OR target < 0")
def problem_files(spark, d):
    return _f(spark, d).where(F.col("f_size").isNull() | (F.col("f_rate") < 0.1) | (F.col("target") < 0)).select("job_index", "phenotype")


@query("high_missing", "SELECT phenotype, round(100.0 * (count(*) - count(f_sparse)) / count(*), 8) AS missing_pct FROM features GROUP BY phenotype HAVING 100.0 * (count(*) - count(f_sparse)) / count(*) >= 50")
def high_missing(spark, d):
    x = 100.0 * (F.count(F.lit(1)) - F.count("f_sparse")) / F.count(F.lit(1))
    return rounded(_f(spark, d).groupBy("phenotype").agg(x.alias("missing_pct")).where("missing_pct >= 50"))


@query("sort_multi", "SELECT job_index, CAST(row_number() OVER (ORDER BY f_size DESC NULLS LAST, f_rate ASC, job_index) AS INT) AS place FROM features ORDER BY place LIMIT 25")
def sort_multi(spark, d):
    from pyspark.sql import Window

    best = _f(spark, d).orderBy(F.col("f_size").desc_nulls_last(), "f_rate", "job_index").limit(25)
    order = Window.orderBy(F.col("f_size").desc_nulls_last(), "f_rate", "job_index")
    return best.select("job_index", F.row_number().over(order).alias("place"))


@query("sort_multi_all", "SELECT job_index, f_size, f_rate, row_number() OVER (ORDER BY f_size DESC NULLS LAST, f_rate ASC, job_index) AS place FROM features")
def sort_multi_all(spark, d):
    """The place of every row in sort_multi's order."""
    cell = F.coalesce(-F.col("f_size"), F.lit(float("inf")))
    return positions(_f(spark, d).withColumn("_c", cell), [], ["_c", "f_rate"], ["job_index"], "place").select("job_index", "f_size", "f_rate", "place")


# scores

_DOSE = """dose AS (SELECT IID, SNPID, min(dosage) AS dosage FROM (SELECT CAST(o_custkey AS VARCHAR) AS IID, 'rs' || CAST(l_partkey AS VARCHAR) AS SNPID, CAST(l_linenumber % 3 AS INT) AS dosage FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY IID, SNPID)"""


def dosages(spark: SparkSession, d: str) -> DataFrame:
    li, o = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/orders.parquet")
    rows = li.select("l_orderkey", "l_partkey", "l_linenumber").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("o_custkey").cast("string").alias("IID"), F.concat(F.lit("rs"), F.col("l_partkey").cast("string")).alias("SNPID")).agg(F.min((F.col("l_linenumber") % 3).cast("int")).alias("dosage"))


@query("plink_score", f"""WITH {_DOSE}, g AS (SELECT pow(10.0, -10 + 10 * i / 19.0) AS threshold, i FROM range(20) t(i)) SELECT IID, CAST(i AS INT) AS step, count(*) AS variants, round(sum(dosage * BETA) / (2 * count(*)), 10) + 0.0 AS score FROM dose JOIN target USING (SNPID) JOIN g ON P <= threshold GROUP BY IID, i""")
def plink_score(spark, d):
    grid = prs.thresholds(spark)
    found = prs.score(dosages(spark, d), view(spark, d, "target"), grid)
    return rounded(found.join(F.broadcast(grid), "threshold").select("IID", "step", "variants", "score"), 10)


@query("prsice_run", f"""WITH {_DOSE}, g AS (SELECT 0.00001 + 0.05 * i AS threshold, i FROM range(20) t(i)) SELECT IID, CAST(i AS INT) AS step, count(*) AS variants, round(sum(dosage * BETA) / (2 * count(*)), 10) + 0.0 AS score FROM dose JOIN target USING (SNPID) JOIN g ON P <= threshold GROUP BY IID, i""")
def prsice_run(spark, d):
    grid = spark.range(20).select(F.col("id").cast("int").alias("step"), (F.lit(0.00001) + F.lit(0.05) * F.col("id")).alias("threshold"))
    return rounded(prs.score(dosages(spark, d), view(spark, d, "target"), grid).join(F.broadcast(grid), "threshold").select("IID", "step", "variants", "score"), 10)


@query("plink_freq", f"WITH {_DOSE} SELECT SNPID, count(dosage) AS samples, round(avg(dosage) / 2, 8) AS freq, round(least(avg(dosage) / 2, 1 - avg(dosage) / 2), 8) AS maf FROM dose GROUP BY SNPID")
def plink_freq(spark, d):
    return rounded(prs.allele_frequency(dosages(spark, d)))


@query("plink_assoc", f"""WITH {_DOSE}, j AS (SELECT SNPID, CAST(dosage AS DOUBLE) AS x, PHENO - 1 AS y FROM dose JOIN samples USING (IID) WHERE PHENO > 0) SELECT SNPID, count(*) AS n, round(regr_slope(y, x), 10) + 0.0 AS beta, coalesce(sum(x) FILTER (WHERE y = 1), 0) AS case_alleles, coalesce(sum(x) FILTER (WHERE y = 0), 0) AS control_alleles FROM j GROUP BY SNPID HAVING count(*) > 5 AND var_samp(x) > 0""")
def plink_assoc(spark, d):
    y = view(spark, d, "samples").where("PHENO > 0").select("IID", (F.col("PHENO") - 1).alias("y"))
    return rounded(prs.association(dosages(spark, d), y).where("n > 5 and beta is not null").select("SNPID", "n", "beta", "case_alleles", "control_alleles"), 10)


_FISHER = f"""WITH {_DOSE}, j AS (SELECT SNPID, dosage, PHENO - 1 AS y FROM dose JOIN samples USING (IID) WHERE PHENO > 0),
 c AS (SELECT SNPID, CAST(coalesce(sum(dosage) FILTER (WHERE y = 1), 0) AS BIGINT) AS case_a1, CAST(coalesce(sum(2 - dosage) FILTER (WHERE y = 1), 0) AS BIGINT) AS case_a2, CAST(coalesce(sum(dosage) FILTER (WHERE y = 0), 0) AS BIGINT) AS control_a1, CAST(coalesce(sum(2 - dosage) FILTER (WHERE y = 0), 0) AS BIGINT) AS control_a2 FROM j GROUP BY SNPID),
 x AS (SELECT SNPID, case_a1, case_a1 + case_a2 AS r, case_a1 + control_a1 AS k, case_a1 + case_a2 + control_a1 + control_a2 AS n, unnest(range(greatest(0, case_a1 - control_a2), least(case_a1 + case_a2, case_a1 + control_a1) + 1)) AS i FROM c),
 f AS (SELECT list(s ORDER BY v) AS f FROM (SELECT v, sum(ln(greatest(v, 1))) OVER (ORDER BY v) AS s FROM range((SELECT max(n) + 1 FROM x)) g(v))),
 q AS (SELECT SNPID, i = case_a1 AS own, f[r + 1] - f[i + 1] - f[r - i + 1] + f[n - r + 1] - f[k - i + 1] - f[n - r - k + i + 1] - f[n + 1] + f[k + 1] + f[n - k + 1] AS l FROM x, f),
 t AS (SELECT SNPID, least(sum(exp(l)) FILTER (WHERE l <= o + 1e-7), 1.0) AS p FROM (SELECT SNPID, l, max(l) FILTER (WHERE own) OVER (PARTITION BY SNPID) AS o FROM q) GROUP BY SNPID)
SELECT SNPID, case_a1, case_a2, control_a1, control_a2, round(case_a1 / nullif(case_a1 + case_a2, 0), 8) AS f_a, round(control_a1 / nullif(control_a1 + control_a2, 0), 8) AS f_u,
 round(CAST(case_a1 AS DOUBLE) * control_a2 / nullif(case_a2 * control_a1, 0), 8) AS odds_ratio, CASE WHEN case_a1 + case_a2 > 0 AND control_a1 + control_a2 > 0 THEN round(p, 8) END AS p FROM c LEFT JOIN t USING (SNPID)"""


@query("plink_assoc_fisher", _FISHER)
def plink_assoc_fisher(spark, d):
    """Fisher's exact test of the alleles of cases and controls."""
    y = view(spark, d, "samples").where("PHENO > 0").select("IID", (F.col("PHENO") - 1).alias("y"))
    return rounded(allelic.association(dosages(spark, d), y))


@query("plink_extract", f"WITH {_DOSE} SELECT IID, count(*) AS kept FROM dose WHERE SNPID IN (SELECT SNPID FROM target WHERE MAF > 0.1) GROUP BY IID")
def plink_extract(spark, d):
    return dosages(spark, d).join(view(spark, d, "target").where("MAF > 0.1"), "SNPID", "left_semi").groupBy("IID").agg(F.count(F.lit(1)).alias("kept"))


_R2 = """pair AS (SELECT t.CHR, t.SNPID AS s1, u.SNPID AS s2, count(*) AS n, count(*) * sum(a.dosage * b.dosage) - sum(a.dosage) * sum(b.dosage) AS c, CAST(count(*) * sum(a.dosage * a.dosage) - sum(a.dosage) * sum(a.dosage) AS DOUBLE) * (count(*) * sum(b.dosage * b.dosage) - sum(b.dosage) * sum(b.dosage)) AS v
 FROM target t JOIN target u ON t.CHR = u.CHR AND abs(t.POS - u.POS) <= 200000 AND (t.POS < u.POS OR (t.POS = u.POS AND t.SNPID < u.SNPID)) JOIN dose a ON a.SNPID = t.SNPID JOIN dose b ON b.SNPID = u.SNPID AND a.IID = b.IID GROUP BY t.CHR, t.SNPID, u.SNPID)"""


def _places(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "target").select("SNPID", "CHR", "POS")


def _ld(spark: SparkSession, d: str) -> DataFrame:
    """What clumping asks for: pairs within 200,000 bases of r2 0.1 and more."""
    return ld.by_distance(dosages(spark, d), _places(spark, d), 200_000, 0.1)


@query("plink_ld", f"WITH {_DOSE}, {_R2} SELECT CHR, s1, s2, n, round(CASE WHEN v > 0 THEN CAST(c AS DOUBLE) * c / v END, 8) AS r2 FROM pair")
def plink_ld(spark, d):
    return rounded(ld.by_distance(dosages(spark, d), _places(spark, d), 200_000))


@query("plink_clump")
def plink_clump(spark, d):
    return ld.clump(view(spark, d, "target"), _ld(spark, d))


@query("plink_prune")
def plink_prune(spark, d):
    """Windows of 200 variants by 50, r2 0.25."""
    return ld.prune(dosages(spark, d), _places(spark, d))


@query("prsice_clumped")
def prsice_clumped(spark, d):
    """prsice_run over the index variants of clumping, with the threshold 1 that
    PRSice adds to its grid."""
    grid = spark.range(21).select(F.col("id").cast("int").alias("step"), F.when(F.col("id") == 20, 1.0).otherwise(F.lit(0.00001) + F.lit(0.05) * F.col("id")).alias("threshold"))
    t = view(spark, d, "target")
    index = materialise(ld.clump(t, _ld(spark, d)).select("SNPID"), "index")
    found = prs.score(dosages(spark, d), t.join(index, "SNPID", "left_semi"), grid)
    return rounded(found.join(F.broadcast(grid), "threshold").select("IID", "step", "variants", "score"), 10)


@query("clump_fallback", "SELECT SNPID FROM target WHERE MAF > 0.1 INTERSECT SELECT SNPID FROM target WHERE P < 0.5")
def clump_fallback(spark, d):
    t = view(spark, d, "target")
    return prs.or_fallback(t.where("P < 0").select("SNPID"), t.where("MAF > 0.1"), t.where("P < 0.5"))


@query("plink_pca")
def plink_pca(spark, d):
    """Six components of each sample, from the dosages, up to signs; 0 for
    samples without dosages."""
    s = view(spark, d, "samples").select("FID", "IID")
    found = prs.components(dosages(spark, d))
    return s.join(found, "IID", "left").fillna(0.0, found.columns[1:])


@query("auc", "WITH r AS (SELECT phenotype, target > 0.5 AS y, rank() OVER (PARTITION BY phenotype ORDER BY f_rate) + (count(*) OVER (PARTITION BY phenotype, f_rate) - 1) / 2.0 AS r FROM features) SELECT phenotype, round((sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0) / nullif(count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y), 0), 8) AS auc FROM r GROUP BY phenotype")
def auc(spark, d):
    return rounded(prs.auc(_f(spark, d).withColumn("y", (F.col("target") > 0.5).cast("int")), ["phenotype"], "y", "f_rate"))


@query("eval_fold")
def eval_fold(spark, d):
    """Five folds of the samples; scores of all variants at twenty thresholds;
    sex, age and six components as covariates."""
    s = view(spark, d, "samples").where("PHENO > 0").select("IID", F.pmod(F.col("IID").cast("int"), F.lit(5)).alias("fold"), (F.col("PHENO") - 1).alias("y"), F.col("SEX").cast("double").alias("SEX"), "AGE")
    grid, pcs = prs.thresholds(spark), prs.components(dosages(spark, d))
    s = s.join(pcs.hint("merge"), "IID", "left").fillna(0.0, pcs.columns[1:])
    with shuffles_dropped(spark):
        dose = materialise(dosages(spark, d), "dosages")
    found = fe.evaluate(s, prs.score(dose, view(spark, d, "target"), grid), ["SEX", "AGE", *pcs.columns[1:]])
    release(dose)
    return found.join(F.broadcast(grid), "threshold").drop("threshold")


_AVG = "a AS (SELECT job_index, label, pvalue, count(DISTINCT fold) AS folds, avg(train) AS train_mean, stddev_samp(train) AS train_sd, avg(test) AS test_mean, stddev_samp(test) AS test_sd FROM folds GROUP BY ALL)"


@query("agg_fold_average", f"WITH {_AVG} SELECT job_index, label, round(pvalue, 8) AS pvalue, folds, round(train_mean, 8) AS train_mean, round(train_sd, 8) AS train_sd, round(test_mean, 8) AS test_mean, round(test_sd, 8) AS test_sd, round(abs(train_mean - test_mean), 8) AS gap, round(train_mean + test_mean, 8) AS \"both\" FROM a")
def agg_fold_average(spark, d):
    return rounded(prs.fold_average(view(spark, d, "folds")))


@query("select_threshold", f"WITH {_AVG}, r AS (SELECT *, row_number() OVER (PARTITION BY job_index ORDER BY test_mean DESC, abs(train_mean - test_mean), label) AS r, row_number() OVER (PARTITION BY job_index ORDER BY train_mean DESC, abs(train_mean - test_mean), label) AS s FROM a) SELECT job_index, min(label) FILTER (WHERE r = 1) AS by_test, min(label) FILTER (WHERE s = 1) AS by_train FROM r GROUP BY job_index")
def select_threshold(spark, d):
    a = prs.fold_average(view(spark, d, "folds"))
    return prs.select_threshold(a).select("job_index", F.col("label").alias("by_test")).join(prs.select_threshold(a, "train_mean").select("job_index", F.col("label").alias("by_train")), "job_index")


@query("top1_global", "SELECT job_index, fold, label, round(test, 8) AS test FROM folds ORDER BY test DESC, job_index, fold, label, train LIMIT 1")
def top1_global(spark, d):
    return rounded(view(spark, d, "folds").orderBy(F.desc("test"), "job_index", "fold", "label", "train").limit(1).select("job_index", "fold", "label", "test"))


@query("join_design_cov_pca", "SELECT s.FID, s.IID, s.AGE, coalesce(c.x, 0.0) AS x, coalesce(p.y, 0.0) AS y FROM samples s LEFT JOIN (SELECT FID, IID, AGE * 2 AS x FROM samples WHERE PHENO > 0) c ON s.IID = c.IID LEFT JOIN (SELECT IID, AGE / 4.0 AS y FROM samples WHERE SEX = 1) p ON s.IID = p.IID")
def join_design_cov_pca(spark, d):
    s = view(spark, d, "samples").select("FID", "IID", "AGE", "SEX", "PHENO")
    return prs.design(s.select("FID", "IID", "AGE"), s.where("PHENO > 0").select("FID", "IID", (F.col("AGE") * 2).alias("x")), s.where("SEX = 1").select("FID", "IID", (F.col("AGE") / 4.0).alias("y")))


@query("join_design_score", f"WITH {_DOSE}, k AS (SELECT IID, sum(dosage * BETA) AS total FROM dose JOIN target USING (SNPID) GROUP BY IID) SELECT s.IID, s.PHENO, round(k.total, 8) + 0.0 AS total FROM samples s JOIN k ON s.IID = k.IID")
def join_design_score(spark, d):
    total = dosages(spark, d).join(view(spark, d, "target"), "SNPID").groupBy("IID").agg(F.sum(F.col("dosage") * F.col("BETA")).alias("total"))
    return rounded(view(spark, d, "samples").select("IID", "PHENO").join(total, "IID"))


@query("agg_fam_pheno", "SELECT count(*) FILTER (WHERE PHENO > 0) AS known, count(*) FILTER (WHERE PHENO = 2) AS cases, count(*) FILTER (WHERE PHENO = 1) AS controls, round(4.0 / (1.0 / count(*) FILTER (WHERE PHENO = 2) + 1.0 / count(*) FILTER (WHERE PHENO = 1)), 8) AS n_effective, 'binary' AS kind, count(*) FILTER (WHERE SEX = 1) AS men, count(*) FILTER (WHERE SEX = 2) AS women FROM samples")
def agg_fam_pheno(spark, d):
    from assocframe.functions import numeric as m

    x = F.when(~F.col("PHENO").isin(-9.0, 0.0), F.col("PHENO"))
    cases, controls = F.count_if(x == 2), F.count_if(x == 1)
    kind = F.when(F.count(x) == 0, "missing").when(F.bool_and(x.isin(1.0, 2.0)), "binary").otherwise("continuous")
    return rounded(view(spark, d, "samples").agg(F.count(x).alias("known"), cases.alias("cases"), controls.alias("controls"), m.effective_n(cases.cast("double"), controls.cast("double")).alias("n_effective"), kind.alias("kind"), F.count_if(F.col("SEX") == 1).alias("men"), F.count_if(F.col("SEX") == 2).alias("women")))


@query("agg_basic_target", "SELECT count(*) AS rows, count(DISTINCT SNPID) AS ids, count(DISTINCT CHR || ':' || CAST(POS AS VARCHAR)) AS places, round(100.0 * count(*) FILTER (WHERE A1 || A2 IN ('AT', 'TA', 'CG', 'GC')) / count(*), 8) AS palindromic_pct, round(median(MAF), 8) AS median_maf FROM target")
def agg_basic_target(spark, d):
    from assocframe.functions import genomic as g, numeric as m

    return rounded(view(spark, d, "target").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("SNPID").alias("ids"), F.count_distinct(F.concat_ws(":", "CHR", "POS")).alias("places"), m.rate(g.is_palindromic(F.col("A1"), F.col("A2"))).alias("palindromic_pct"), F.percentile("MAF", 0.5).alias("median_maf")))


@query("agg_basic_gwas", "SELECT job_index, count(*) AS rows, count(DISTINCT SNPID) AS ids, round(100.0 * count(SNPID) / count(*), 8) AS id_pct, round(median(least(EAF, 1 - EAF)), 8) AS median_maf FROM variants GROUP BY job_index")
def agg_basic_gwas(spark, d):
    return rounded(view(spark, d, "variants").groupBy("job_index").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("SNPID").alias("ids"), (100.0 * F.count("SNPID") / F.count(F.lit(1))).alias("id_pct"), F.percentile(F.least(F.col("EAF"), 1 - F.col("EAF")), 0.5).alias("median_maf")))


@query("agg_nh2", "SELECT job_index, round(median(N) * 0.25, 8) AS nh2, round(0.25 * 0.01 * 0.99 * 0.01 * 0.99 / (0.3 * 0.7 * 0.0007), 8) AS liability FROM variants GROUP BY job_index")
def agg_nh2(spark, d):
    """N times a given h2, and the liability form with prevalence 1 %, cases 30 %
    and the squared density at the threshold."""
    return rounded(view(spark, d, "variants").groupBy("job_index").agg((F.percentile("N", 0.5) * 0.25).alias("nh2"), F.max(F.lit(0.25) * 0.01 * 0.99 * 0.01 * 0.99 / (F.lit(0.3) * 0.7 * 0.0007)).alias("liability")))
