"""Queries of significance, lookups, quality control and builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from assocframe.functions import numeric as m, text as t
from assocframe.operators import heritability as hb, harmonise as h, tests_of_significance as ts
from assocframe.plans.base import query, rounded
from assocframe.plans.views import ordered, view
from assocframe.sources import plink


@query("t_test")
def t_test(spark, d):
    return ts.one_sample_t(view(spark, d, "folds").withColumn("gap", F.col("train") - F.col("test")), ["label"], "gap")


@query("wilcoxon")
def wilcoxon(spark, d):
    return ts.signed_ranks(view(spark, d, "folds").withColumn("gap", F.col("train") - F.col("test")), ["label"], "gap")


@query("fisher_p")
def fisher_p(spark, d):
    return ts.fisher(view(spark, d, "features"), ["phenotype"], "p_value")


@query("correlation_p")
def correlation_p(spark, d):
    out = view(spark, d, "features").groupBy("phenotype").agg(F.count("f_rate").alias("n"), m.pearson(F.col("f_rate"), F.col("target")).alias("r"))
    return out.withColumn("p", ts.correlation_p(F.col("r"), F.col("n")))


@query("agg_ldsc", """WITH v AS (SELECT job_index, Z * Z AS y, 1.0 + CAST(POS % 200 AS DOUBLE) AS x, N FROM variants WHERE Z IS NOT NULL), w AS (SELECT *, 1.0 / greatest(x, 1.0) AS w FROM v),
 s AS (SELECT job_index, count(*) AS variants, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, median(N) AS n FROM w GROUP BY job_index), r AS (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS slope FROM s)
 SELECT job_index, variants, round(slope, 6) + 0.0 AS slope, round((sy - slope * sx) / sw, 6) AS intercept, round(slope * variants / n, 6) + 0.0 AS h2 FROM r""")
def agg_ldsc(spark, d):
    v = view(spark, d, "variants").where("Z is not null").select("job_index", (F.col("Z") * F.col("Z")).alias("chi2"), (1.0 + (F.col("POS") % 200).cast("double")).alias("ld"), "N")
    return rounded(ts.ld_score_regression(v, ["job_index"]), 6)


_LDSC_RUNS = 50


def _ld_scores(spark, d):
    return ordered(spark, d, "variants").where("Z is not null").select("job_index", "CHR", "POS", "row_id", (F.col("Z") * F.col("Z")).alias("chi2"), (1.0 + (F.col("POS") % 200).cast("double")).alias("ld"), "N")


@query("agg_ldsc_jackknife", f"""WITH v AS (SELECT job_index, row_id, CHR, POS, Z * Z AS y, 1.0 + CAST(POS % 200 AS DOUBLE) AS l, N FROM variants WHERE Z IS NOT NULL),
 p AS (SELECT job_index, count(*) AS variants, avg(y) AS mean_chi2, median(y) AS my, median(N) AS mn, greatest(0.0, least(1.0, (avg(y) - 1) * count(*) / avg(N * l))) AS h FROM v GROUP BY job_index),
 r AS (SELECT job_index, y, N * l / variants AS x, 1.0 / (greatest(l, 1.0) * pow(1 + h * N * l / variants, 2)) AS w, (row_number() OVER (PARTITION BY job_index ORDER BY CASE CHR WHEN 'X' THEN 23 WHEN 'MT' THEN 25 ELSE CAST(CHR AS INT) END, POS, row_id) - 1) * {_LDSC_RUNS} // variants AS b FROM v JOIN p USING (job_index)),
 s AS (SELECT job_index, b, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM r GROUP BY job_index, b),
 o AS (SELECT a.job_index, a.b, sum(c.w) AS w, sum(c.x) AS x, sum(c.y) AS y, sum(c.xx) AS xx, sum(c.xy) AS xy FROM s a JOIN s c ON a.job_index = c.job_index AND a.b <> c.b GROUP BY ALL),
 j AS (SELECT job_index, count(*) AS n, var_samp((w * xy - x * y) / (w * xx - x * x)) AS vh, var_samp((y - (w * xy - x * y) / (w * xx - x * x) * x) / w) AS vi FROM o GROUP BY job_index),
 t AS (SELECT job_index, sum(w) AS w, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM s GROUP BY job_index),
 f AS (SELECT *, (w * xy - x * y) / (w * xx - x * x) AS h2, (y - (w * xy - x * y) / (w * xx - x * x) * x) / w AS i FROM t JOIN j USING (job_index) JOIN p USING (job_index))
 SELECT job_index, variants, round(h2, 6) + 0.0 AS h2, round((n - 1) * sqrt(vh / n), 6) AS h2_se, round(i, 6) AS intercept, round((n - 1) * sqrt(vi / n), 6) AS intercept_se, round((i - 1) / (mean_chi2 - 1), 6) + 0.0 AS ratio, round((n - 1) * sqrt(vi / n) / abs(mean_chi2 - 1), 6) AS ratio_se, round(mean_chi2, 6) AS mean_chi2, round(my / 0.454936423119572, 6) AS lambda_gc, round(mn * h2, 6) + 0.0 AS n_times_h2 FROM f""")
def agg_ldsc_jackknife(spark, d):
    return rounded(hb.ld_score_regression(_ld_scores(spark, d), ["job_index"], ["CHR", "POS", "row_id"], _LDSC_RUNS), 6)


@query("agg_h2_liability")
def agg_h2_liability(spark, d):
    """h2 on the scale of liability: each file's share of cases, and the prevalence
    among the samples."""
    found = hb.ld_score_regression(_ld_scores(spark, d), ["job_index"], ["CHR", "POS", "row_id"], _LDSC_RUNS)
    cases = view(spark, d, "variants").groupBy("job_index").agg((F.avg("N_CASES") / (F.avg("N_CASES") + F.avg("N_CONTROLS"))).alias("case_share"))
    everyone = view(spark, d, "samples").agg((F.count_if(F.col("PHENO") == 2) / F.count_if(F.col("PHENO") > 0)).alias("prevalence"))
    out = found.join(cases, "job_index").crossJoin(everyone)  # one row
    return out.select("job_index", "h2", "case_share", "prevalence", hb.liability(F.col("h2"), F.col("case_share"), F.col("prevalence")).alias("liability_h2"), hb.liability(F.col("h2_se"), F.col("case_share"), F.col("prevalence")).alias("liability_h2_se"))


_BLOCKS = [("1", 1, 20_000_000, "1", 1000), ("1", 20_000_000, 60_000_000, "1", -500), ("2", 1, 30_000_000, "3", 7)]


@query("liftover", "WITH b(CHR, s, e, to_chr, shift) AS (VALUES " + ", ".join(f"('{a}', {b}, {c}, '{e}', {f})" for a, b, c, e, f in _BLOCKS) + ") SELECT SNPID, to_chr, POS + shift AS to_pos FROM target t LEFT JOIN b ON t.CHR = b.CHR AND POS >= s AND POS < e")
def liftover(spark, d):
    blocks = spark.createDataFrame(_BLOCKS, "CHR string, start long, end long, to_chr string, shift long")
    return ts.lift(view(spark, d, "target").select("SNPID", "CHR", "POS"), blocks).select("SNPID", "to_chr", "to_pos")


@query("metadata_lookup", "SELECT j.job_index, p.perf IS NOT NULL AS found, round(p.perf, 8) AS perf FROM jobs j LEFT JOIN (SELECT accession, perf FROM jobs WHERE job_index % 2 = 0) p ON j.accession = p.accession")
def metadata_lookup(spark, d):
    j = view(spark, d, "jobs")
    meta = j.where("job_index % 2 = 0").select(F.concat(F.lit(" "), F.upper("accession")).alias("key"), "perf", "job_index")
    one = h.first_by(meta.select(F.lower(F.trim("key")).alias("k"), "perf", "job_index"), ["k"], "job_index").drop("job_index")
    return rounded(j.select("job_index", F.lower(F.trim("accession")).alias("k")).join(one, "k", "left").select("job_index", F.col("perf").isNotNull().alias("found"), "perf"))


@query("join_selected_pairs", "SELECT job_index, fold, label, round(test, 8) AS test FROM folds WHERE (job_index, label) IN (SELECT (job_index, min(label)) FROM folds GROUP BY job_index)")
def join_selected_pairs(spark, d):
    f = view(spark, d, "folds")
    return rounded(f.join(f.groupBy("job_index").agg(F.min("label").alias("label")), ["job_index", "label"], "left_semi").select("job_index", "fold", "label", "test"))


@query("join_ref_af", "WITH a AS (SELECT job_index, SNPID, arg_min(EAF, row_id) AS EAF FROM variants WHERE SNPID IS NOT NULL GROUP BY ALL) SELECT job_index, count(*) AS pairs, round(covar_samp(EAF, t.MAF) / (stddev_samp(EAF) * stddev_samp(t.MAF)), 8) AS r, round(100.0 * count(*) FILTER (WHERE abs(EAF - t.MAF) > 0.2) / count(*), 8) AS far_pct FROM a JOIN target t USING (SNPID) GROUP BY job_index")
def join_ref_af(spark, d):
    a = h.first_by(ordered(spark, d, "variants").where("SNPID is not null").select("job_index", "SNPID", "EAF", "row_id"), ["job_index", "SNPID"], "row_id")
    j = a.join(view(spark, d, "target").select("SNPID", F.col("MAF").alias("ref")), "SNPID")
    return rounded(j.groupBy("job_index").agg(F.count(F.lit(1)).alias("pairs"), m.pearson(F.col("EAF"), F.col("ref")).alias("r"), m.rate(F.abs(F.col("EAF") - F.col("ref")) > 0.2).alias("far_pct")))


@query("agg_qc_profile", """WITH k AS (SELECT *, SNPID IS NOT NULL AND CHR IS NOT NULL AND POS > 0 AND length(NEA) = 1 AND EA <> NEA AND P >= 0 AND P <= 1 AND SE > 0 AND EAF BETWEEN 0 AND 1 AS ok FROM variants), g AS (SELECT job_index, count(*) AS n FROM (SELECT DISTINCT job_index, CHR, POS, EA, NEA FROM k WHERE ok) GROUP BY job_index)
 SELECT k.job_index, count(*) AS loaded, count(*) FILTER (WHERE ok) AS valid, max(g.n) AS kept, round(100.0 * (count(*) - max(g.n)) / count(*), 8) AS removed_pct FROM k LEFT JOIN g ON k.job_index = g.job_index GROUP BY k.job_index""")
def agg_qc_profile(spark, d):
    """Our rules of quality control: known id and place, two single bases that
    differ, P and frequency in range, a positive error; then no repeats."""
    c = F.col
    ok = F.coalesce(c("SNPID").isNotNull() & c("CHR").isNotNull() & (c("POS") > 0) & c("EA").rlike("^[ACGT]$") & c("NEA").rlike("^[ACGT]$") & (c("EA") != c("NEA")) & c("P").between(0, 1) & (c("SE") > 0) & c("EAF").between(0, 1), F.lit(False))
    v = view(spark, d, "variants").withColumn("ok", ok)
    key = F.when(c("ok"), F.struct("CHR", "POS", "EA", "NEA"))
    return rounded(v.groupBy("job_index").agg(F.count(F.lit(1)).alias("loaded"), F.count_if("ok").alias("valid"), F.count_distinct(key).alias("kept")).withColumn("removed_pct", 100.0 * (c("loaded") - c("kept")) / c("loaded")))


@query("harmonised_hint", "SELECT page_id, CASE WHEN contains(lower(url), 'a') THEN 'harmonised' ELSE 'raw' END AS hint FROM pages")
def harmonised_hint(spark, d):
    name = F.concat(F.when(F.contains(F.lower("url"), F.lit("a")), F.lit("x.h.tsv.gz")).otherwise(F.lit("x.tsv.gz")))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.when(name.rlike(r"(?i)harmoni[sz]ed|\.h\.tsv"), "harmonised").otherwise("raw").alias("hint"))


@query("clump_input", "SELECT job_index, count(DISTINCT SNPID) AS variants, round(min(P), 8) AS best FROM variants WHERE SNPID LIKE 'rs%' AND P > 0 AND P <= 1 GROUP BY job_index")
def clump_input(spark, d):
    v = view(spark, d, "variants").where(F.col("SNPID").rlike("(?i)^rs[0-9]+$") & (F.col("P") > 0) & (F.col("P") <= 1))
    return rounded(v.groupBy("job_index").agg(F.count_distinct("SNPID").alias("variants"), F.min("P").alias("best")))


@query("scan_prune", "SELECT count(*) AS rows FROM target WHERE MAF > 0.1")
def scan_prune(spark, d):
    return view(spark, d, "target").where("MAF > 0.1").select("SNPID").agg(F.count(F.lit(1)).alias("rows"))


@query("scan_reference_table", "SELECT count(DISTINCT SNPID) AS ids, count(DISTINCT CHR || ':' || CAST(POS AS VARCHAR)) AS places FROM target")
def scan_reference_table(spark, d):
    r = view(spark, d, "target")
    return r.agg(F.count_distinct(F.lower("SNPID")).alias("ids"), F.count_distinct(F.concat_ws(":", "CHR", "POS")).alias("places"))


@query("scan_reference_bim", "SELECT CHR, count(*) AS rows FROM target GROUP BY CHR")
def scan_reference_bim(spark, d):
    lines = view(spark, d, "target").select(F.concat_ws("\t", "CHR", "SNPID", F.lit("0"), "POS", "A1", "A2").alias("value"))
    return plink.bim(lines).groupBy("CHR").agg(F.count(F.lit(1)).alias("rows"))


@query("scan_sumstats_minimal", "SELECT job_index, CHR, POS, EA, NEA, min(P) AS P FROM variants WHERE P > 0 AND P <= 1 AND length(NEA) = 1 GROUP BY ALL")
def scan_sumstats_minimal(spark, d):
    from assocframe.operators.concordance import minimal

    return minimal(ordered(spark, d, "variants")).select("job_index", "CHR", "POS", "EA", "NEA", "P")


@query("high_rate", "SELECT job_index, round(100.0 * count(*) FILTER (WHERE \"OR\" <= 0) / count(*), 8) AS bad_pct FROM variants GROUP BY job_index HAVING 100.0 * count(*) FILTER (WHERE \"OR\" <= 0) / count(*) >= 5")
def high_rate(spark, d):
    return rounded(view(spark, d, "variants").groupBy("job_index").agg(m.rate(F.col("OR") <= 0).alias("bad_pct")).where("bad_pct >= 5"))
