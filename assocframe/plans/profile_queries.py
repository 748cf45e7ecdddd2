"""Queries of the per-file profiles, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assocframe.operators import profile as p
from assocframe.plans.base import query, rounded
from assocframe.plans.views import view


def pct(part: str, among: str = "true") -> str:
    return f"round(coalesce(100.0 * count(*) FILTER (WHERE ({among}) AND ({part})) / nullif(count(*) FILTER (WHERE {among}), 0), 0), 8)"


def _v(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "variants")


def _grouped(name: str, exprs, sql: str) -> None:
    @query(name, f"SELECT job_index, {sql} FROM variants GROUP BY job_index")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(p.profile(_v(spark, d), exprs()))

    run.__name__ = name


_grouped("agg_pvalues", p.pvalues, f"""{pct('P IS NOT NULL')} AS p_numeric_pct, {pct('P < 0 OR P > 1', 'P IS NOT NULL')} AS p_out_of_range_pct,
 count(*) FILTER (WHERE P = 0) AS p_zero, count(*) FILTER (WHERE P = 1) AS p_one, round(min(P), 8) AS min_p, round(median(P), 8) AS median_p,
 count(*) FILTER (WHERE P < 5e-8) AS genome_wide, {pct('P < 5e-8', 'P IS NOT NULL')} AS genome_wide_pct, count(*) FILTER (WHERE P < 1e-5) AS suggestive,
 {pct('P < 1e-5', 'P IS NOT NULL')} AS suggestive_pct, {pct("P > 0 AND P < 0.001", 'P IS NOT NULL')} AS p_scientific_pct""")
_grouped("agg_sample_size", p.sample_size, f"""{pct('N IS NULL')} AS n_missing_pct, round(median(N), 8) AS median_n, round(min(N), 8) AS min_n, round(max(N), 8) AS max_n,
 round((max(N) - min(N)) / max(N), 8) AS n_spread, CASE WHEN (max(N) - min(N)) / max(N) < 0.001 THEN 'constant' ELSE 'variable' END AS n_kind,
 round(4.0 / (1.0 / median(N_CASES) + 1.0 / median(N_CONTROLS)), 8) AS n_effective""")
_grouped("agg_variant_ids", p.variant_ids, f"""{pct('SNPID IS NULL')} AS id_missing_pct, count(DISTINCT SNPID) AS ids_unique, {pct("SNPID LIKE 'rs%'", 'SNPID IS NOT NULL')} AS rsid_pct,
 {pct("SNPID LIKE 'chr%'", 'SNPID IS NOT NULL')} AS chrpos_pct, 0.0 AS chrpos_allele_pct,
 CASE WHEN avg(CASE WHEN SNPID LIKE 'rs%' THEN 1.0 ELSE 0.0 END) FILTER (WHERE SNPID IS NOT NULL) >= 0.8 THEN 'rsID' ELSE 'mixed_or_other' END AS id_format""")
_grouped("agg_alleles", p.alleles, f"""0.0 AS non_acgt_pct, round(100.0 * count(*) FILTER (WHERE length(NEA) > 1) / (count(EA) + count(NEA)), 8) AS multi_character_pct,
 {pct('length(EA) <> length(NEA)')} AS indel_pct, {pct('length(NEA) = 1')} AS single_base_pct, {pct("EA || NEA IN ('AT', 'TA', 'CG', 'GC')", 'length(NEA) = 1')} AS palindromic_pct,
 {pct("EA || NEA IN ('AT', 'TA', 'CG', 'GC')")} AS ambiguous_pct, false AS case_mixed""")
_grouped("agg_frequency", p.frequency, f"""{pct('EAF IS NULL')} AS eaf_missing_pct, {pct('MAF IS NULL')} AS maf_missing_pct, 'range_0_1' AS eaf_range, 'range_0_0_5' AS maf_range,
 round(median(EAF), 8) AS median_eaf, round(median(MAF), 8) AS median_maf, {pct('MAF < 0.01', 'MAF IS NOT NULL')} AS rare_pct, {pct('MAF >= 0.01 AND MAF < 0.05', 'MAF IS NOT NULL')} AS low_pct, {pct('MAF >= 0.05', 'MAF IS NOT NULL')} AS common_pct""")
_grouped("agg_info", p.info, f"""{pct('INFO IS NULL')} AS info_missing_pct, CASE WHEN max(INFO) <= 1 THEN 'range_0_1' WHEN min(INFO) > 1 THEN 'outside_expected_range' ELSE 'mixed_with_out_of_range' END AS info_range,
 {pct('INFO > 1')} AS info_out_of_range_pct, round(median(INFO) FILTER (WHERE INFO <= 1), 8) AS median_info, {pct('INFO < 0.3', 'INFO <= 1')} AS info_below_03_pct, {pct('INFO < 0.8', 'INFO <= 1')} AS info_below_08_pct""")
_grouped("agg_info_by_maf", p.info_by_maf, f"""round(avg(INFO) FILTER (WHERE least(EAF, 1 - EAF) < 0.05), 8) AS info_mean_rare, {pct('INFO < 0.8', 'least(EAF, 1 - EAF) < 0.05')} AS info_low_pct_rare,
 round(avg(INFO) FILTER (WHERE least(EAF, 1 - EAF) >= 0.05), 8) AS info_mean_common, {pct('INFO < 0.8', 'least(EAF, 1 - EAF) >= 0.05')} AS info_low_pct_common""")
_grouped("agg_chromosome", p.chromosomes, f"""count(*) FILTER (WHERE CHR NOT IN ('X', 'MT')) AS autosomal, count(*) FILTER (WHERE CHR = 'X') AS chr_x, 0 AS chr_y, count(*) FILTER (WHERE CHR = 'MT') AS chr_mt,
 0.0 AS invalid_chr_pct, {pct("CHR IN ('X', 'MT')")} AS non_autosomal_pct, 22 - count(DISTINCT CHR) FILTER (WHERE CHR NOT IN ('X', 'MT')) AS missing_autosomes""")

@query("agg_effect_consistency", f"""SELECT job_index, {pct('"OR" <= 0')} AS or_nonpositive_pct, {pct('"OR" > 100 OR "OR" < 0.01')} AS or_extreme_pct, {pct('abs(BETA) > 10')} AS beta_extreme_pct,
 round(CASE WHEN count(Z) >= 3 THEN covar_samp(Z, b) / nullif(stddev_samp(Z) * stddev_samp(b), 0) END, 8) AS z_correlation, {pct('abs(Z - b) <= 0.01', 'Z IS NOT NULL')} AS z_concordance_pct FROM (SELECT *, CASE WHEN Z IS NOT NULL THEN BETA / SE END AS b FROM variants) GROUP BY job_index""")
def agg_effect_consistency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(p.profile(_v(spark, d), p.effects()[:5]))


@query("agg_p_consistency")
def agg_p_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Of P with Z: rows only, as DuckDB has no complementary error function."""
    return rounded(p.profile(_v(spark, d), p.effects()[5:]), 5)


@query("agg_effect_type", "SELECT job_index, CASE WHEN count(BETA) > 0 THEN 'BETA' WHEN count(\"OR\") > 0 THEN 'OR_requires_log_conversion' WHEN count(Z) > 0 THEN 'Z' ELSE 'missing_effect_column' END AS effect_type FROM variants GROUP BY job_index")
def agg_effect_type(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.count("BETA") > 0, "BETA").when(F.count("OR") > 0, "OR_requires_log_conversion").when(F.count("Z") > 0, "Z").otherwise("missing_effect_column")
    return _v(spark, d).groupBy("job_index").agg(kind.alias("effect_type"))


_grouped("agg_format_classify", p.formats, """CASE WHEN avg(CASE WHEN CHR IN ('X', 'MT') THEN 0.0 ELSE 1.0 END) >= 0.8 THEN 'numeric' ELSE 'mixed_or_other' END AS chr_format,
 CASE WHEN avg(CASE WHEN SNPID LIKE 'rs%' THEN 1.0 ELSE 0.0 END) FILTER (WHERE SNPID IS NOT NULL) >= 0.8 THEN 'rsID' ELSE 'mixed_or_other' END AS snp_format,
 'integer' AS bp_format, 'single_base_upper' AS allele_format, 'decimal_0_1' AS p_format""")
_grouped("agg_invalid_ambiguous_alleles", lambda: [*p.invalid_alleles(), p.alleles()[5]], f"""count(*) FILTER (WHERE length(NEA) > 1) AS invalid_alleles, round(100.0 * count(*) FILTER (WHERE length(NEA) > 1) / (count(EA) + count(NEA)), 8) AS invalid_alleles_pct,
 {pct("EA || NEA IN ('AT', 'TA', 'CG', 'GC')")} AS ambiguous_pct""")
_grouped("agg_n_eff", lambda: [p.sample_size()[6], F.count_if(F.col("N_CASES") > 0).alias("with_cases")], "round(4.0 / (1.0 / median(N_CASES) + 1.0 / median(N_CONTROLS)), 8) AS n_effective, count(*) FILTER (WHERE N_CASES > 0) AS with_cases")
_SKEW = "CASE WHEN stddev_samp(BETA) > 0 THEN round(skewness(BETA), 8) END"
_KURT = "CASE WHEN stddev_samp(BETA) > 0 THEN round(kurtosis(BETA), 8) END"
_grouped("agg_beta_dist", p.beta_distribution, f"""round(avg(BETA), 8) + 0.0 AS beta_mean, round(stddev_samp(BETA), 8) AS beta_sd, {_SKEW} + 0.0 AS beta_skew, {_KURT} + 0.0 AS beta_kurtosis, round(quantile_cont(abs(BETA), 0.95), 8) AS beta_p95,
 round(quantile_cont(abs(BETA), 0.99), 8) AS beta_p99, {pct('abs(Z) > 5', 'Z IS NOT NULL')} AS z_over_5_pct, {pct('abs(Z) > 10', 'Z IS NOT NULL')} AS z_over_10_pct""")
_grouped("agg_se_dist", p.se_distribution, """round(median(SE), 8) AS se_median, round(min(SE), 8) AS se_min, round(max(SE), 8) AS se_max, round(stddev_samp(SE) / avg(SE), 8) AS se_cv, count(*) FILTER (WHERE SE = 0) AS se_zero,
 count(*) FILTER (WHERE SE < 0) AS se_negative, quantile_cont(SE, 0.75) / quantile_cont(SE, 0.25) > 5 AS se_spread""")
_grouped("agg_effect_distribution", p.effect_distribution, f"""count(BETA) AS effects, round(avg(BETA), 8) + 0.0 AS mean, round(stddev_samp(BETA), 8) AS sd, round(min(BETA), 8) AS min, round(max(BETA), 8) AS max, round(median(BETA), 8) + 0.0 AS median,
 round(quantile_cont(abs(BETA), 0.9), 8) AS abs_q9, round(quantile_cont(abs(BETA), 0.95), 8) AS abs_q95, round(quantile_cont(abs(BETA), 0.99), 8) AS abs_q99, round(quantile_cont(abs(BETA), 0.999), 8) AS abs_q999,
 {_SKEW} + 0.0 AS skew, {_KURT} + 0.0 AS kurtosis, 0 AS abs_over_1, 0 AS abs_over_2, 0 AS abs_over_5, 0 AS or_over_10, count(*) FILTER (WHERE "OR" < 0.1) AS or_under_01,
 round(avg(SE), 8) AS se_mean, round(median(SE), 8) AS se_median, round(avg(abs(Z)), 8) AS abs_z_mean, round(median(abs(Z)), 8) AS abs_z_median, {pct('BETA > 0')} AS positive_pct""")
_T = "(CASE WHEN P > 0 AND P <= 1 THEN P END)"
_grouped("agg_pvalue_distribution", p.pvalue_distribution, f"""count({_T}) AS valid, count(P) - count({_T}) AS invalid, count(*) FILTER (WHERE P = 0) AS zero, """ + ", ".join(f"round(quantile_cont({_T}, {q}), 8) AS q{int(q * 100):02d}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95))
    + f", round(avg(-log10({_T})), 8) AS log_mean, round(max(-log10({_T})), 8) AS log_max, " + ", ".join(f"count(*) FILTER (WHERE {_T} <= {v}) AS under_{k}, {pct(f'P <= {v}', 'P > 0 AND P <= 1')} AS under_{k}_pct" for k, v in enumerate(p.THRESHOLDS)))


@query("agg_chromosome_signature", "SELECT job_index, string_agg(CHR || ':' || CAST(n AS VARCHAR), ';' ORDER BY CHR || ':' || CAST(n AS VARCHAR)) AS signature FROM (SELECT job_index, CHR, count(*) AS n FROM variants GROUP BY job_index, CHR) GROUP BY job_index")
def agg_chromosome_signature(spark: SparkSession, d: str) -> DataFrame:
    return p.chromosome_signature(_v(spark, d))


@query("agg_lambda_gc", f"""SELECT job_index, round(median(Z * Z) / {p.CHI2_MEDIAN}, 8) AS lambda_gc, round(avg(Z * Z), 8) AS mean_chi2, {pct('abs(Z - BETA / SE) > 0.1', 'Z IS NOT NULL')} AS z_inconsistent_pct,
 {pct('abs(Z - BETA / SE) > 0.1', 'Z IS NOT NULL')} > 10 AS z_inconsistent FROM variants GROUP BY job_index""")
def agg_lambda_gc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(p.inflation(p.chi_square(_v(spark, d))))


@query("agg_tail_lambda", f"""WITH r AS (SELECT job_index, Z * Z AS chi2, row_number() OVER (PARTITION BY job_index ORDER BY Z * Z DESC, row_id) AS r, count(*) OVER (PARTITION BY job_index) AS n FROM variants WHERE Z IS NOT NULL)
 SELECT job_index, round(median(chi2) / {p.CHI2_MEDIAN}, 8) AS lambda_tail, count(*) AS tail_rows FROM r WHERE r <= greatest(1, floor(n * 0.01)) GROUP BY job_index""")
def agg_tail_lambda(spark: SparkSession, d: str) -> DataFrame:
    return rounded(p.tail_inflation(p.chi_square(_v(spark, d))))


@query("agg_qq", """WITH r AS (SELECT job_index, -log10(P) AS seen, row_number() OVER (PARTITION BY job_index ORDER BY P, row_id) AS r, count(*) OVER (PARTITION BY job_index) AS n FROM variants WHERE P > 0 AND P <= 1),
 q AS (SELECT *, -log10((r - 0.5) / n) AS due FROM r WHERE n >= 100),
 t AS (SELECT job_index, median(seen) FILTER (WHERE r <= greatest(1, floor(n * 0.05))) / median(due) FILTER (WHERE r <= greatest(1, floor(n * 0.05))) AS tail_5, median(seen) FILTER (WHERE r <= greatest(1, floor(n * 0.01))) / median(due) FILTER (WHERE r <= greatest(1, floor(n * 0.01))) AS tail_1 FROM q GROUP BY job_index)
 SELECT job_index, round(tail_5, 8) AS tail_5, round(tail_1, 8) AS tail_1, CASE WHEN tail_5 > 1.2 THEN 'inflated' WHEN tail_1 > 1.2 THEN 'tail_enriched' WHEN tail_5 < 0.8 THEN 'deflated' ELSE 'near_expected' END AS pattern FROM t""")
def agg_qq(spark: SparkSession, d: str) -> DataFrame:
    return rounded(p.quantile_tails(_v(spark, d)))


_DIM = ", ".join(f"('{i + 1}', {n})" for i, n in enumerate(p.HG19))


@query("agg_chr_coverage", f"""WITH dim(c, length) AS (VALUES {_DIM}), f AS (SELECT job_index, CHR, count(*) AS variants, count(DISTINCT floor((POS - 1) / 1e6)) AS bins FROM variants WHERE POS > 0 GROUP BY job_index, CHR),
 e AS (SELECT job_index, c, length FROM (SELECT DISTINCT job_index FROM variants), dim)
 SELECT e.job_index, c AS CHR, coalesce(f.variants, 0) AS variants, round(coalesce(f.variants, 0) / (length / 1e6), 8) AS per_mb, round(100 - 100.0 * coalesce(bins, 0) / ceil(length / 1e6), 8) AS empty_bins_pct FROM e LEFT JOIN f ON f.job_index = e.job_index AND f.CHR = e.c""")
def agg_chr_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(p.coverage(_v(spark, d)))


_RHO = "round(CASE WHEN count(*) >= 3 THEN covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) END, 8)"


def ranks(x: str, key: str) -> str:
    return f"rank() OVER (PARTITION BY {key} ORDER BY {x}) + (count(*) OVER (PARTITION BY {key}, {x}) - 1) / 2.0"


@query("agg_spearman_beta_maf", f"""WITH v AS (SELECT job_index, abs(BETA) AS x, EAF AS y FROM variants WHERE BETA IS NOT NULL AND EAF > 0), r AS (SELECT job_index, {ranks('x', 'job_index')} AS a, {ranks('y', 'job_index')} AS b FROM v)
 SELECT job_index, count(*) AS pairs, {_RHO} AS rho FROM r GROUP BY job_index""")
def agg_spearman_beta_maf(spark: SparkSession, d: str) -> DataFrame:
    v = _v(spark, d).select("job_index", F.abs("BETA").alias("x"), F.when(F.col("EAF") > 0, F.col("EAF")).alias("y"))
    return rounded(p.spearman(v, ["job_index"], "x", "y", least=3))


@query("dup_members", "WITH g AS (SELECT job_index, SNPID, count(*) AS n FROM variants WHERE SNPID IS NOT NULL GROUP BY job_index, SNPID) SELECT job_index, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS members FROM g GROUP BY job_index")
def dup_members(spark: SparkSession, d: str) -> DataFrame:
    return p.duplicates(_v(spark, d), ["SNPID"]).select("job_index", "rows", "members")


@query("dup_extras", "WITH g AS (SELECT job_index, CHR, POS, EA, NEA, count(*) AS n FROM variants GROUP BY ALL) SELECT job_index, CAST(sum(n - 1) AS BIGINT) AS extras, count(*) AS \"distinct\" FROM g GROUP BY job_index")
def dup_extras(spark: SparkSession, d: str) -> DataFrame:
    return p.duplicates(_v(spark, d), ["CHR", "POS", "EA", "NEA"]).select("job_index", "extras", "distinct")


@query("agg_retention", """SELECT job_index, count(*) AS rows_in, count(*) FILTER (WHERE SNPID LIKE 'rs%' AND length(NEA) = 1 AND EA <> NEA AND P > 0 AND P < 1 AND SE > 0 AND CHR NOT IN ('X', 'MT')) AS kept,
 round(100.0 * count(*) FILTER (WHERE SNPID LIKE 'rs%' AND length(NEA) = 1 AND EA <> NEA AND P > 0 AND P < 1 AND SE > 0 AND CHR NOT IN ('X', 'MT')) / count(*), 8) AS kept_pct FROM variants GROUP BY job_index""")
def agg_retention(spark: SparkSession, d: str) -> DataFrame:
    from assocframe.operators.harmonise import ldsc_condition

    v = _v(spark, d)
    ok = F.coalesce(ldsc_condition(), F.lit(False))
    return rounded(v.groupBy("job_index").agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(ok).alias("kept"), (100.0 * F.count_if(ok) / F.count(F.lit(1))).alias("kept_pct")))


@query("flagship", """WITH f AS (SELECT job_index, count(*) FILTER (WHERE P < 0.01) AS significant, count(DISTINCT SNPID) AS ids_unique, median(N) AS median_n FROM variants GROUP BY job_index)
 SELECT phenotype, accession, job_index, significant, ids_unique, round(median_n, 8) AS median_n, CAST(rank() OVER (PARTITION BY phenotype ORDER BY significant DESC NULLS LAST) AS INT) AS place FROM jobs LEFT JOIN f USING (job_index)""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Each phenotype's files by their number of significant variants: one
    grouped pass over the variants, a join of files, a rank per phenotype."""
    from pyspark.sql import Window

    found = _v(spark, d).groupBy("job_index").agg(F.count_if(F.col("P") < 0.01).alias("significant"), p.variant_ids()[1], p.sample_size()[1])
    order = Window.partitionBy("phenotype").orderBy(F.col("significant").desc_nulls_last())
    return rounded(view(spark, d, "jobs").join(found, "job_index", "left").select("phenotype", "accession", "job_index", "significant", "ids_unique", "median_n", F.rank().over(order).alias("place")))
