"""Queries of joins, set operations, deduplication and concordance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assocframe.functions import genomic as g
from assocframe.operators import compat as c, concordance as cc, harmonise as h
from assocframe.plans.base import query, rounded
from assocframe.plans.views import ordered, view

_COMP = "translate({0}, 'ACGT', 'TGCA')"


def status(ea: str, nea: str, a1: str, a2: str) -> str:
    """The allele status as SQL; a comparison with an allele that has no
    complement is false."""
    ce = f"CASE WHEN length({ea}) = 1 THEN translate({ea}, 'ACGT', 'TGCA') END"
    cn = f"CASE WHEN length({nea}) = 1 THEN translate({nea}, 'ACGT', 'TGCA') END"
    return f"""CASE WHEN {ea} IS NULL OR {nea} IS NULL OR {a1} IS NULL OR {a2} IS NULL THEN 'missing_allele'
 WHEN {ea} || '/' || {nea} IN ('A/T', 'T/A', 'C/G', 'G/C') AND least({ea}, {nea}) || greatest({ea}, {nea}) = least({a1}, {a2}) || greatest({a1}, {a2}) THEN 'palindromic_ambiguous'
 WHEN {ea} = {a1} AND {nea} = {a2} THEN 'direct_match' WHEN {ea} = {a2} AND {nea} = {a1} THEN 'flip_match'
 WHEN {ce} = {a1} AND {cn} = {a2} THEN 'strand_match' WHEN {ce} = {a2} AND {cn} = {a1} THEN 'strand_flip_match' ELSE 'mismatch' END"""


_STATUS_COUNTS = "count(*) AS matched, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in c.STATUSES)


def _vt(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return ordered(spark, d, "variants"), view(spark, d, "target")


@query("join_rsid_allele", f"""WITH a AS (SELECT job_index, SNPID, arg_min(EA, row_id) AS EA, arg_min(NEA, row_id) AS NEA FROM variants WHERE SNPID IS NOT NULL GROUP BY job_index, SNPID),
 b AS (SELECT a.*, t.A1, t.A2 FROM a JOIN target t ON a.SNPID = t.SNPID), s AS (SELECT job_index, {status('EA', 'NEA', 'A1', 'A2')} AS status FROM b) SELECT job_index, {_STATUS_COUNTS} FROM s GROUP BY job_index""")
def join_rsid_allele(spark: SparkSession, d: str) -> DataFrame:
    return c.allele_join(*_vt(spark, d), ["SNPID"])


@query("join_chrpos_allele", f"""WITH a AS (SELECT job_index, CHR, POS, arg_min(EA, row_id) AS EA, arg_min(NEA, row_id) AS NEA FROM variants GROUP BY job_index, CHR, POS),
 t AS (SELECT CHR, POS, arg_min(A1, A1 || A2) AS A1, arg_min(A2, A1 || A2) AS A2 FROM target GROUP BY CHR, POS),
 s AS (SELECT a.job_index, {status('EA', 'NEA', 'A1', 'A2')} AS status FROM a JOIN t ON a.CHR = t.CHR AND a.POS = t.POS) SELECT job_index, {_STATUS_COUNTS} FROM s GROUP BY job_index""")
def join_chrpos_allele(spark: SparkSession, d: str) -> DataFrame:
    return c.allele_join(*_vt(spark, d), ["CHR", "POS"])


_MATCHED = f"""m AS (SELECT v.job_index, v.row_id, v.BETA, v.P, t.SNPID AS t_id, t.P AS t_p, t.BETA AS t_beta, 'id' AS how, {status('v.EA', 'v.NEA', 't.A1', 't.A2')} AS status FROM variants v JOIN target t ON v.SNPID = t.SNPID
 UNION ALL SELECT v.job_index, v.row_id, v.BETA, v.P, t.SNPID, t.P, t.BETA, 'coordinate', {status('v.EA', 'v.NEA', 't.A1', 't.A2')} FROM variants v JOIN target t ON v.CHR = t.CHR AND v.POS = t.POS WHERE v.SNPID IS NULL OR v.SNPID NOT IN (SELECT SNPID FROM target))"""


@query("join_id_then_coord", f"WITH {_MATCHED}, r AS (SELECT *, row_number() OVER (PARTITION BY job_index, row_id ORDER BY t_p, t_id) AS r FROM m WHERE status NOT IN ('mismatch', 'missing_allele')) SELECT job_index, row_id, t_id, round(t_p, 8) AS t_p, how, status FROM r WHERE r = 1")
def join_id_then_coord(spark: SparkSession, d: str) -> DataFrame:
    return rounded(c.id_then_coordinate(view(spark, d, "variants"), view(spark, d, "target")))


_CORR = "round(CASE WHEN count({0}) >= 3 THEN covar_samp({0}, {1}) / nullif(stddev_samp({0}) * stddev_samp({1}), 0) END, 8) + 0.0"


@query("join_target_assoc", f"""WITH v AS (SELECT v.job_index, v.BETA, v.P, t.BETA AS t_beta, t.P AS t_p, {status('v.EA', 'v.NEA', 't.A1', 't.A2')} AS status FROM variants v JOIN target t ON v.SNPID = t.SNPID),
 s AS (SELECT *, CASE WHEN status IN ('flip_match', 'strand_flip_match') THEN -t_beta ELSE t_beta END AS turned, abs(BETA) AS ab, abs(t_beta) AS tb, CASE WHEN P > 0 THEN -log10(P) END AS l1, CASE WHEN t_p > 0 THEN -log10(t_p) END AS l2 FROM v WHERE status NOT IN ('mismatch', 'missing_allele')),
 u AS (SELECT *, CASE WHEN l1 IS NOT NULL THEN l2 END AS m2 FROM s)
 SELECT job_index, count(*) AS pairs, count(*) FILTER (WHERE status IN ('flip_match', 'strand_flip_match')) AS flipped, {_CORR.format('BETA', 't_beta')} AS r_raw, {_CORR.format('BETA', 'turned')} AS r_signed, {_CORR.format('ab', 'tb')} AS r_abs,
 round(avg(abs(BETA - turned)), 8) AS mean_gap, round(median(abs(BETA - turned)), 8) AS median_gap, {_CORR.format('l1', 'm2')} AS r_logp FROM u GROUP BY job_index""")
def join_target_assoc(spark: SparkSession, d: str) -> DataFrame:
    v, t = _vt(spark, d)
    bim = t.select("SNPID", "A1", "A2", F.col("BETA").alias("t_beta"), F.col("P").alias("t_p"))
    mapped = v.join(bim, "SNPID").withColumn("status", g.match_status(*[F.col(x) for x in ("EA", "NEA", "A1", "A2")])).where("status not in ('mismatch', 'missing_allele')")
    return rounded(c.association_concordance(mapped))


@query("join_maf_rsid", f"""WITH a AS (SELECT job_index, SNPID, arg_min(EAF, row_id) AS EAF FROM variants WHERE SNPID IS NOT NULL GROUP BY job_index, SNPID), j AS (SELECT job_index, least(EAF, 1 - EAF) AS x, t.MAF AS y FROM a JOIN target t ON a.SNPID = t.SNPID)
 SELECT job_index, count(*) AS pairs, {_CORR.format('x', 'y')} AS r, round(avg(abs(x - y)), 8) AS mean_gap, round(median(abs(x - y)), 8) AS median_gap FROM j GROUP BY job_index""")
def join_maf_rsid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(c.frequency_concordance(*_vt(spark, d), ["SNPID"]))


@query("join_maf_chrpos_alleles", f"""WITH k AS (SELECT job_index, CHR, POS, least(EA, NEA) || '/' || greatest(EA, NEA) AS pair, EAF, row_id FROM variants), a AS (SELECT job_index, CHR, POS, pair, arg_min(EAF, row_id) AS EAF FROM k GROUP BY ALL),
 t AS (SELECT CHR, POS, least(A1, A2) || '/' || greatest(A1, A2) AS pair, min(MAF) AS MAF FROM target GROUP BY ALL), j AS (SELECT job_index, least(EAF, 1 - EAF) AS x, MAF AS y FROM a JOIN t USING (CHR, POS, pair))
 SELECT job_index, count(*) AS pairs, {_CORR.format('x', 'y')} AS r, round(avg(abs(x - y)), 8) AS mean_gap, round(median(abs(x - y)), 8) AS median_gap FROM j GROUP BY job_index""")
def join_maf_chrpos_alleles(spark: SparkSession, d: str) -> DataFrame:
    v, t = _vt(spark, d)
    return rounded(c.frequency_concordance(v.withColumn("pair", g.sorted_pair(F.col("EA"), F.col("NEA"))), t.withColumn("pair", g.sorted_pair(F.col("A1"), F.col("A2"))), ["CHR", "POS", "pair"]))


def _overlap_sql(keys: str, where: str = "true") -> str:
    return f"""WITH a AS (SELECT DISTINCT job_index, {keys} FROM variants WHERE {where}), t AS (SELECT DISTINCT {keys}, 1 AS hit FROM target)
 SELECT job_index, count(*) AS file_keys, (SELECT count(*) FROM t) AS target_keys, count(hit) AS shared, round(100.0 * count(hit) / count(*), 8) AS file_pct, round(100.0 * count(hit) / (SELECT count(*) FROM t), 8) AS target_pct FROM a LEFT JOIN t USING ({keys}) GROUP BY job_index"""


@query("set_overlap", _overlap_sql("SNPID", "SNPID IS NOT NULL"))
def set_overlap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(c.overlap(*_vt(spark, d), ["SNPID"]))


@query("set_overlap_chrpos", _overlap_sql("CHR, POS"))
def set_overlap_chrpos(spark: SparkSession, d: str) -> DataFrame:
    return rounded(c.overlap(*_vt(spark, d), ["CHR", "POS"]))


@query("set_difference", """WITH a AS (SELECT DISTINCT SNPID FROM variants WHERE SNPID IS NOT NULL), b AS (SELECT DISTINCT SNPID FROM target)
 SELECT 'files_only' AS side, count(*) AS keys, min(SNPID) AS first_key FROM a WHERE SNPID NOT IN (SELECT SNPID FROM b) UNION ALL SELECT 'target_only', count(*), min(SNPID) FROM b WHERE SNPID NOT IN (SELECT SNPID FROM a) HAVING count(*) > 0
 UNION ALL SELECT 'both', count(*), min(SNPID) FROM a WHERE SNPID IN (SELECT SNPID FROM b)""")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return c.difference(*_vt(spark, d))


@query("usable_keys_union", f"""WITH {_MATCHED.replace("WHERE v.SNPID IS NULL OR v.SNPID NOT IN (SELECT SNPID FROM target)", "")} SELECT job_index, count(DISTINCT t_id) AS usable FROM m WHERE status IN ('direct_match', 'flip_match', 'strand_match', 'strand_flip_match') GROUP BY job_index""")
def usable_keys_union(spark: SparkSession, d: str) -> DataFrame:
    return c.usable_keys(*_vt(spark, d))


@query("agg_final_usable", f"""WITH {_MATCHED.replace("WHERE v.SNPID IS NULL OR v.SNPID NOT IN (SELECT SNPID FROM target)", "")} SELECT job_index, count(DISTINCT t_id) AS usable, round(100.0 * count(DISTINCT t_id) / (SELECT count(DISTINCT SNPID) FROM target), 8) AS target_pct FROM m WHERE status IN ('direct_match', 'flip_match', 'strand_match', 'strand_flip_match') GROUP BY job_index""")
def agg_final_usable(spark: SparkSession, d: str) -> DataFrame:
    v, t = _vt(spark, d)
    total = t.agg(F.count_distinct("SNPID").alias("n"))
    return rounded(c.usable_keys(v, t).join(F.broadcast(total), F.lit(True)).select("job_index", "usable", (100.0 * F.col("usable") / F.col("n")).alias("target_pct")))


@query("build_detect_overlap", """WITH o AS (SELECT DISTINCT job_index, CHR, POS FROM variants), t AS (SELECT DISTINCT CHR, POS, 1 AS h FROM target), u AS (SELECT DISTINCT CHR, POS + 1 AS POS, 1 AS k FROM target),
 b AS (SELECT job_index, count(h) AS hits_19, count(k) AS hits_38 FROM o LEFT JOIN t USING (CHR, POS) LEFT JOIN u USING (CHR, POS) GROUP BY job_index)
 SELECT *, CASE WHEN hits_19 > hits_38 THEN 'hg19' WHEN hits_38 > hits_19 THEN 'hg38' ELSE 'tie' END AS build, round(coalesce(CAST(least(hits_19, hits_38) AS DOUBLE) / nullif(greatest(hits_19, hits_38), 0), 0), 8) AS minor_major_ratio FROM b""")
def build_detect_overlap(spark: SparkSession, d: str) -> DataFrame:
    v, t = _vt(spark, d)
    return rounded(c.build_by_overlap(v, t, t.withColumn("POS", F.col("POS") + 1)))


@query("hapmap_overlap", """WITH a AS (SELECT DISTINCT job_index, SNPID FROM variants WHERE SNPID IS NOT NULL), t AS (SELECT DISTINCT SNPID, 1 AS h FROM target), i AS (SELECT job_index, count(*) AS k, count(h) AS s FROM a LEFT JOIN t USING (SNPID) GROUP BY job_index),
 p AS (SELECT DISTINCT job_index, CHR, POS FROM variants), u AS (SELECT DISTINCT CHR, POS, 1 AS h FROM target), q AS (SELECT job_index, count(*) AS k, count(h) AS s FROM p LEFT JOIN u USING (CHR, POS) GROUP BY job_index)
 SELECT q.job_index, CASE WHEN i.k > 100 AND (SELECT count(*) FROM t) > 100 THEN 'rsid' ELSE 'chrpos' END AS method, CASE WHEN i.k > 100 AND (SELECT count(*) FROM t) > 100 THEN i.s ELSE q.s END AS shared,
 round(CASE WHEN i.k > 100 AND (SELECT count(*) FROM t) > 100 THEN 100.0 * i.s / i.k ELSE 100.0 * q.s / q.k END, 8) AS pct FROM q LEFT JOIN i USING (job_index)""")
def hapmap_overlap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(c.reference_overlap(*_vt(spark, d)))


@query("selected_ref_overlaps", """WITH r AS (SELECT 'even' AS ref, SNPID FROM target WHERE POS % 2 = 0 UNION ALL SELECT 'all', SNPID FROM target), a AS (SELECT DISTINCT job_index, SNPID FROM variants WHERE SNPID IS NOT NULL)
 SELECT job_index, ref, count(*) AS shared FROM a JOIN (SELECT DISTINCT ref, SNPID FROM r) USING (SNPID) GROUP BY ALL""")
def selected_ref_overlaps(spark: SparkSession, d: str) -> DataFrame:
    v, t = _vt(spark, d)
    refs = t.where("POS % 2 = 0").select(F.lit("even").alias("ref"), "SNPID").unionByName(t.select(F.lit("all").alias("ref"), "SNPID")).distinct()
    return v.where("SNPID is not null").select("job_index", "SNPID").distinct().join(refs, "SNPID").groupBy("job_index", "ref").agg(F.count(F.lit(1)).alias("shared"))


@query("agg_prs_readiness", """SELECT job_index, count(SNPID) AS with_id, count(*) FILTER (WHERE P > 0 AND P <= 1) AS with_p, count(*) FILTER (WHERE SNPID IS NOT NULL AND P > 0 AND P <= 1) AS clump_ready, count(SNPID) AS score_ready,
 count(*) FILTER (WHERE P > 0 AND P <= 1 AND SNPID IN (SELECT SNPID FROM target)) AS full_ready FROM variants GROUP BY job_index""")
def agg_prs_readiness(spark: SparkSession, d: str) -> DataFrame:
    return c.readiness(*_vt(spark, d))


@query("dedup_best_p", "SELECT job_index, SNPID, row_id, round(P, 8) AS P FROM (SELECT *, row_number() OVER (PARTITION BY job_index, SNPID ORDER BY P ASC NULLS LAST, row_id) AS r FROM variants WHERE SNPID IS NOT NULL) WHERE r = 1")
def dedup_best_p(spark: SparkSession, d: str) -> DataFrame:
    return rounded(h.dedup_best_p(view(spark, d, "variants").where("SNPID is not null").select("job_index", "SNPID", "row_id", "P"), ["job_index", "SNPID"]))


@query("dedup_keys_first", "SELECT CHR, POS, min(row_id) AS row_id, arg_min(EA, row_id) AS EA FROM variants GROUP BY CHR, POS")
def dedup_keys_first(spark: SparkSession, d: str) -> DataFrame:
    return h.first_by(view(spark, d, "variants").select("CHR", "POS", "row_id", "EA"), ["CHR", "POS"], "row_id")


@query("dedup_catalog", "SELECT s_nationkey, s_suppkey, s_name FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r = 1")
def dedup_catalog(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/supplier.parquet")
    return h.first_by(rows, ["s_nationkey"], -F.col("s_acctbal"), "s_suppkey").select("s_nationkey", "s_suppkey", "s_name")


@query("ldsc_clean", """WITH ok AS (SELECT * FROM variants WHERE SNPID LIKE 'rs%' AND CHR NOT IN ('X', 'MT') AND length(NEA) = 1 AND EA <> NEA AND SE > 0 AND P > 0 AND P < 1),
 a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_index, SNPID ORDER BY P, row_id) AS r FROM ok) WHERE r = 1),
 b AS (SELECT *, row_number() OVER (PARTITION BY job_index, CHR, POS, EA, NEA ORDER BY P, row_id) AS r2 FROM a) SELECT job_index, SNPID, row_id FROM b WHERE r2 = 1""")
def ldsc_clean(spark: SparkSession, d: str) -> DataFrame:
    return h.ldsc_clean(view(spark, d, "variants")).select("job_index", "SNPID", "row_id")


@query("valid_prs_row", """SELECT job_index, count(*) FILTER (WHERE SNPID IS NOT NULL AND P > 0 AND P <= 1) AS plink, count(*) FILTER (WHERE SNPID IS NOT NULL AND P > 0 AND P <= 1 AND length(NEA) = 1 AND EA <> NEA AND "OR" > 0) AS prsice FROM variants GROUP BY job_index""")
def valid_prs_row(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "variants").groupBy("job_index").agg(F.count_if(h.valid_prs_row()).alias("plink"), F.count_if(h.valid_prs_row("prsice")).alias("prsice"))


@query("semi_anti", "SELECT job_index, count(*) FILTER (WHERE SNPID IN (SELECT SNPID FROM target)) AS inside, count(*) FILTER (WHERE SNPID IS NULL OR SNPID NOT IN (SELECT SNPID FROM target)) AS outside FROM variants GROUP BY job_index")
def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    v, t = _vt(spark, d)
    inside = v.join(t, "SNPID", "left_semi").groupBy("job_index").agg(F.count(F.lit(1)).alias("inside"))
    return v.join(t, "SNPID", "left_anti").groupBy("job_index").agg(F.count(F.lit(1)).alias("outside")).join(inside, "job_index", "left").select("job_index", F.coalesce("inside", F.lit(0)).alias("inside"), "outside")


_PAIRS = """k AS (SELECT v.*, phenotype, row_number() OVER (PARTITION BY v.job_index, CHR, POS, EA, NEA ORDER BY P, row_id) AS r FROM variants v JOIN jobs j ON v.job_index = j.job_index WHERE P > 0 AND P <= 1 AND length(NEA) = 1), m AS (SELECT * FROM k WHERE r = 1),
 s AS (SELECT phenotype, job_index, CHR, POS, EA, NEA, BETA, P, EAF, 0 AS turned FROM m UNION ALL SELECT phenotype, job_index, CHR, POS, NEA, EA, -BETA, P, 1 - EAF, 1 FROM m),
 p AS (SELECT a.phenotype, a.job_index AS file1, b.job_index AS file2, a.CHR, a.POS, a.EA, a.NEA, a.BETA AS b1, b.BETA AS b2, a.P AS p1, b.P AS p2, a.EAF AS f1, b.EAF AS f2, b.turned, row_number() OVER (PARTITION BY a.phenotype, a.job_index, b.job_index, a.CHR, a.POS, a.EA, a.NEA ORDER BY b.turned) AS w
  FROM m a JOIN s b ON a.phenotype = b.phenotype AND a.CHR = b.CHR AND a.POS = b.POS AND a.EA = b.EA AND a.NEA = b.NEA AND a.job_index < b.job_index), q AS (SELECT *, abs(b1) AS a1, abs(b2) AS a2, -log10(p1) AS l1, -log10(p2) AS l2 FROM p WHERE w = 1)"""


@query("join_harmonised", f"WITH {_PAIRS} SELECT file1, file2, count(*) AS shared, CAST(sum(turned) AS BIGINT) AS turned, round(sum(b1 * b2), 8) + 0.0 AS product FROM q GROUP BY file1, file2")
def join_harmonised(spark: SparkSession, d: str) -> DataFrame:
    rows = cc.harmonised_pairs(ordered(spark, d, "variants"), view(spark, d, "jobs"))
    return rounded(rows.groupBy("file1", "file2").agg(F.count(F.lit(1)).alias("shared"), F.sum("turned").alias("turned"), F.sum(F.col("b1") * F.col("b2")).alias("product")))


@query("join_pairwise", f"""WITH {_PAIRS} SELECT phenotype, file1, file2, count(*) AS shared, CAST(sum(turned) AS BIGINT) AS turned, {_CORR.format('b1', 'b2')} AS beta_r, {_CORR.format('a1', 'a2')} AS abs_beta_r, {_CORR.format('l1', 'l2')} AS logp_r, {_CORR.format('f1', 'f2')} AS eaf_r,
 round(100.0 * count(*) FILTER (WHERE sign(b1) = sign(b2)) / count(*), 8) AS same_sign_pct FROM q GROUP BY phenotype, file1, file2""")
def join_pairwise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cc.pairwise(cc.harmonised_pairs(ordered(spark, d, "variants"), view(spark, d, "jobs"))))


_RANKS = ", ".join(f"rank() OVER (PARTITION BY file1, file2 ORDER BY {c}) + (count(*) OVER (PARTITION BY file1, file2, {c}) - 1) / 2.0 AS r_{c}" for c in ("b1", "b2", "p1", "p2"))
_SIDE = lambda c, how: c if how == "pearson" else f"-r_p{c[1]}" if c[0] == "l" else f"r_{c}"
_COMPARED = ", ".join(f"count(*) AS {k}_{how}_n, {_CORR.format(_SIDE(x, how), _SIDE(y, how))} AS {k}_{how}_r" for k, (x, y) in cc.COMPARISONS.items() for how in ("pearson", "spearman"))


@query("join_pairwise_full", f"WITH {_PAIRS}, z AS (SELECT *, {_RANKS} FROM q) SELECT phenotype, file1, file2, count(*) AS n_common_snps, count(*) FILTER (WHERE turned = 0) AS n_direct_allele_match, count(*) FILTER (WHERE turned = 1) AS n_flipped_allele_match, {_COMPARED} FROM z GROUP BY phenotype, file1, file2")
def join_pairwise_full(spark: SparkSession, d: str) -> DataFrame:
    """All seven comparisons by both methods; p has no SQL (join_pairwise_p)."""
    found = cc.correlations(cc.harmonised_pairs(ordered(spark, d, "variants"), view(spark, d, "jobs")))
    return rounded(found.drop(*[c for c in found.columns if c.endswith("_p")]))


@query("join_pairwise_p")
def join_pairwise_p(spark: SparkSession, d: str) -> DataFrame:
    found = cc.correlations(cc.harmonised_pairs(ordered(spark, d, "variants"), view(spark, d, "jobs")))
    return found.select("phenotype", "file1", "file2", *[c for c in found.columns if c.endswith("_p")])


_PAIRWISE = f"WITH {_PAIRS}, w AS (SELECT phenotype, file1, file2, count(*) AS shared, {_CORR.format('b1', 'b2')} AS beta_r, {_CORR.format('f1', 'f2')} AS eaf_r FROM q GROUP BY phenotype, file1, file2)"


@query("agg_concordance_summary", f"""{_PAIRWISE}, u AS (SELECT 'beta_r' AS metric, beta_r AS v FROM w UNION ALL SELECT 'eaf_r', eaf_r FROM w) SELECT metric, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(min(v), 6) AS min, round(max(v), 6) AS max,
 count(*) FILTER (WHERE v > 0) AS positive, count(*) FILTER (WHERE v < 0) AS negative, count(*) FILTER (WHERE abs(v) >= 0.1) AS abs_1, count(*) FILTER (WHERE abs(v) >= 0.2) AS abs_2, count(*) FILTER (WHERE abs(v) >= 0.5) AS abs_5 FROM u WHERE v IS NOT NULL GROUP BY metric""")
def agg_concordance_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cc.summary(rounded(cc.pairwise(cc.harmonised_pairs(ordered(spark, d, "variants"), view(spark, d, "jobs")))), ["beta_r", "eaf_r"]), 6)


@query("agg_concordance_tables", f"""{_PAIRWISE} SELECT phenotype, count(*) AS pairs, (SELECT CAST(count(DISTINCT f) AS INT) FROM (SELECT phenotype AS p, file1 AS f FROM w UNION ALL SELECT phenotype, file2 FROM w) WHERE p = w.phenotype) AS files, round(quantile_cont(beta_r, 0.25), 6) AS q25, round(quantile_cont(beta_r, 0.5), 6) AS median, round(quantile_cont(beta_r, 0.75), 6) AS q75,
 round(min(beta_r), 6) AS min, round(max(beta_r), 6) AS max FROM w GROUP BY phenotype""")
def agg_concordance_tables(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cc.tables(rounded(cc.pairwise(cc.harmonised_pairs(ordered(spark, d, "variants"), view(spark, d, "jobs")))), "beta_r"), 6)


@query("agg_target_compat", """WITH j AS (SELECT v.job_index, v.EAF, t.MAF, CASE WHEN EA = A1 AND NEA = A2 THEN 'same' WHEN EA = A2 AND NEA = A1 THEN 'flipped' ELSE 'mismatch' END AS o FROM variants v JOIN target t ON v.CHR = t.CHR AND v.POS = t.POS)
 SELECT job_index, count(*) AS joined, count(*) FILTER (WHERE o = 'same') AS same, count(*) FILTER (WHERE o = 'flipped') AS flipped, count(*) FILTER (WHERE o = 'mismatch') AS mismatch, round(avg(abs(least(EAF, 1 - EAF) - MAF)), 8) AS maf_gap FROM j GROUP BY job_index""")
def agg_target_compat(spark: SparkSession, d: str) -> DataFrame:
    v, t = _vt(spark, d)
    j = v.drop("MAF").join(t.select("CHR", "POS", "A1", "A2", "MAF"), ["CHR", "POS"]).withColumn("o", g.orientation(*[F.col(x) for x in ("EA", "NEA", "A1", "A2")]))
    maf = F.least(F.col("EAF"), 1 - F.col("EAF"))
    return rounded(j.groupBy("job_index").agg(F.count(F.lit(1)).alias("joined"), *[F.count_if(F.col("o") == s).alias(s) for s in ("same", "flipped", "mismatch")], F.avg(F.abs(maf - F.col("MAF"))).alias("maf_gap")))


@query("fill_rsid_reference", """WITH f AS (SELECT CHR, POS, A1 AS EA, A2 AS NEA, min(SNPID) AS i FROM target GROUP BY ALL), p AS (SELECT CHR, POS, min(SNPID) AS i FROM target GROUP BY ALL)
 SELECT v.job_index, count(*) AS rows, count(v.SNPID) AS had, count(coalesce(v.SNPID, f.i, s.i, p.i)) AS filled, count(*) FILTER (WHERE v.SNPID IS NULL AND f.i IS NULL AND s.i IS NOT NULL) AS by_swap FROM variants v LEFT JOIN f ON v.CHR = f.CHR AND v.POS = f.POS AND v.EA = f.EA AND v.NEA = f.NEA
 LEFT JOIN f s ON v.CHR = s.CHR AND v.POS = s.POS AND v.EA = s.NEA AND v.NEA = s.EA LEFT JOIN p ON v.CHR = p.CHR AND v.POS = p.POS GROUP BY v.job_index""")
def fill_rsid_reference(spark: SparkSession, d: str) -> DataFrame:
    v, t = _vt(spark, d)
    ref = t.select("CHR", "POS", F.col("A1").alias("EA"), F.col("A2").alias("NEA"), F.col("SNPID").alias("ref_id"))
    out = h.matched(v, ref)
    filled = F.coalesce("SNPID", "by_alleles", "by_swap", "by_place")
    return out.groupBy("job_index").agg(F.count(F.lit(1)).alias("rows"), F.count("SNPID").alias("had"), F.count(filled).alias("filled"), F.count_if(F.col("SNPID").isNull() & F.col("by_alleles").isNull() & F.col("by_swap").isNotNull()).alias("by_swap"))


@query("locus_greedy")
def locus_greedy(spark: SparkSession, d: str) -> DataFrame:
    return c.loci(view(spark, d, "variants"))
