"""Queries of scalar functions, column mapping, derived columns, sources, models
and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assocframe.functions import genomic as g, numeric as m, stats as st, text as t
from assocframe.operators import harmonise as h, ml
from assocframe.plans.base import query, rounded
from assocframe.plans.views import view
from assocframe.runtime import materialise
from assocframe.sources import catalog, plink, sniff
from assocframe.streaming import incremental


def _v(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "variants")


# genomic scalars

@query("normalise_keys", """SELECT row_id, job_index, CASE WHEN lower(SNPID) LIKE 'rs%' THEN lower(SNPID) END AS rsid, CHR || ':' || CAST(POS AS VARCHAR) AS chrpos,
 CASE WHEN length(NEA) = 1 THEN least(least(EA, NEA) || '/' || greatest(EA, NEA), least(translate(EA, 'ACGT', 'TGCA'), translate(NEA, 'ACGT', 'TGCA')) || '/' || greatest(translate(EA, 'ACGT', 'TGCA'), translate(NEA, 'ACGT', 'TGCA'))) ELSE least(EA, NEA) || '/' || greatest(EA, NEA) END AS pair,
 coalesce(EA || '/' || NEA IN ('A/T', 'T/A', 'C/G', 'G/C'), false) AS palindromic FROM variants""")
def normalise_keys(spark, d):
    return h.variant_keys(_v(spark, d)).select("row_id", "job_index", "rsid", "chrpos", "pair", "palindromic")


@query("complement_palindromic", "SELECT DISTINCT EA, NEA, translate(EA, 'ACGT', 'TGCA') AS complement, EA || '/' || NEA IN ('A/T', 'T/A', 'C/G', 'G/C') AS palindromic FROM variants")
def complement_palindromic(spark, d):
    return _v(spark, d).select("EA", "NEA").distinct().select("EA", "NEA", g.complement(F.col("EA")).alias("complement"), g.is_palindromic(F.col("EA"), F.col("NEA")).alias("palindromic"))


# text scalars

@query("clean_text", "SELECT n_nationkey, trim(n_name) AS name FROM nation")
def clean_text(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", t.clean(F.concat(F.lit("  "), "n_name", F.lit(" "))).alias("name"))


@query("is_missing", "SELECT job_index, count(*) FILTER (WHERE SNPID IS NULL) AS missing, round(100.0 * count(*) FILTER (WHERE SNPID IS NULL) / count(*), 8) AS missing_pct FROM variants GROUP BY job_index")
def is_missing(spark, d):
    raw = F.when(F.col("SNPID").isNull() & (F.col("POS") % 2 == 0), F.lit(" NA ")).otherwise(F.col("SNPID"))
    gone = t.is_missing(raw)
    return rounded(_v(spark, d).groupBy("job_index").agg(F.count_if(gone).alias("missing"), m.rate(gone).alias("missing_pct")))


@query("normalise_header", "SELECT c_custkey, replace(replace(lower(c_name), '#', '#'), ' ', '_') AS header FROM customer")
def normalise_header(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", t.normal_header(F.concat(F.lit("["), "c_name", F.lit("]"))).alias("header"))


@query("safe_name", "SELECT o_orderpriority AS raw, regexp_replace(o_orderpriority, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe, count(*) AS n FROM orders GROUP BY ALL")
def safe_name(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("raw"), t.safe_name(F.col("o_orderpriority")).alias("safe")).agg(F.count(F.lit(1)).alias("n"))


@query("normalise_url", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(url), '^(ftp|http)://', 'https://'), '/+$', ''), '([^:])/{2,}', '\\1/', 'g') AS url FROM pages")
def normalise_url(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", t.normal_url(F.col("url")).alias("url"))


@query("word_boundary", "SELECT p_partkey, regexp_matches(lower(p_name), '\\bring\\b') AS hit FROM part")
def word_boundary(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", t.has_phrase(F.col("p_name"), "Ring").alias("hit"))


@query("token_sort_distance", "SELECT p_partkey, round(100.0 * (1 - CAST(levenshtein(s, 'ring small') AS DOUBLE) / greatest(length(s), 10)), 8) AS similarity FROM (SELECT p_partkey, array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS s FROM part)")
def token_sort_distance(spark, d):
    return rounded(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", t.token_sort_distance(F.col("p_name"), "small ring").alias("similarity")))


@query("token_sort_ratio")
def token_sort_ratio(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", t.token_sort_ratio(F.col("p_name"), "small ring").alias("ratio"))


@query("scalar_math", "SELECT row_id, round(abs(BETA), 8) AS a, CAST(sign(BETA) AS DOUBLE) + 0.0 AS s, round(exp(BETA), 8) AS e, round(CASE WHEN \"OR\" > 0 THEN ln(\"OR\") END, 8) + 0.0 AS l, round(CASE WHEN P > 0 THEN -log10(P) END, 8) AS p FROM variants")
def scalar_math(spark, d):
    return rounded(_v(spark, d).select("row_id", F.abs("BETA").alias("a"), F.signum("BETA").alias("s"), F.exp("BETA").alias("e"), F.when(F.col("OR") > 0, F.log("OR")).alias("l"), m.neg_log10(F.col("P")).alias("p")))


@query("safe_corr", """SELECT job_index, round(CASE WHEN count(Z) >= 3 THEN covar_samp(Z, b) / nullif(stddev_samp(Z) * stddev_samp(b), 0) END, 8) AS r FROM (SELECT job_index, Z, CASE WHEN Z IS NOT NULL THEN BETA END AS b FROM variants) GROUP BY job_index""")
def safe_corr(spark, d):
    return rounded(_v(spark, d).groupBy("job_index").agg(m.pearson(F.col("Z"), F.col("BETA")).alias("r")))


@query("quantile", "SELECT job_index, round(quantile_cont(EAF, 0.9), 8) AS q90, round(median(EAF), 8) AS q50 FROM variants GROUP BY job_index")
def quantile(spark, d):
    return rounded(_v(spark, d).groupBy("job_index").agg(m.quantile(F.col("EAF"), 0.9).alias("q90"), m.median(F.col("EAF")).alias("q50")))


# derived columns

@query("derive_beta_or", """SELECT row_id, round(coalesce(b, CASE WHEN "OR" > 0 THEN ln("OR") END), 8) + 0.0 AS beta_final, CASE WHEN b IS NOT NULL THEN 'reported' WHEN "OR" > 0 THEN 'from_or' ELSE 'missing' END AS beta_source FROM (SELECT *, CASE WHEN POS % 3 = 0 THEN NULL ELSE BETA END AS b FROM variants)""")
def derive_beta_or(spark, d):
    v = _v(spark, d).withColumn("BETA", F.when(F.col("POS") % 3 != 0, F.col("BETA")))
    return rounded(h.derive_effects(v).select("row_id", "beta_final", "beta_source"))


@query("derive_se", "SELECT row_id, round(coalesce(CASE WHEN Z <> 0 THEN abs(BETA / Z) END, CASE WHEN Z <> 0 AND \"OR\" > 0 THEN abs(ln(\"OR\") / Z) END, CASE WHEN \"OR\" > 0 THEN (ln(\"OR\" * 1.2) - ln(\"OR\" / 1.2)) / 3.92 END), 8) + 0.0 AS se FROM variants")
def derive_se(spark, d):
    o = F.col("OR")
    return rounded(_v(spark, d).select("row_id", h.derive_se(F.col("BETA"), o, F.col("Z"), o * 1.2, o / 1.2).alias("se")))


@query("derive_signed_z")
def derive_signed_z(spark, d):
    return _v(spark, d).groupBy("job_index").agg(F.avg(h.derive_signed_z(F.col("P"), F.col("BETA"))).alias("mean_z"), F.max(F.abs(h.derive_signed_z(F.col("P"), F.col("BETA")))).alias("max_z"))


@query("build_snpid", "SELECT row_id, coalesce(SNPID, CHR || ':' || CAST(POS AS VARCHAR) || ':' || NEA || ':' || EA) AS built_id FROM variants")
def build_snpid(spark, d):
    return h.build_snpid(_v(spark, d)).select("row_id", "built_id")


@query("sanitise_snpid", "SELECT job_index, count(*) FILTER (WHERE SNPID LIKE 'rs%') AS kept, count(*) FILTER (WHERE SNPID IS NOT NULL AND SNPID NOT LIKE 'rs%') AS cleared FROM variants GROUP BY job_index")
def sanitise_snpid(spark, d):
    s = h.sanitise_snpid(F.col("SNPID"))
    return _v(spark, d).groupBy("job_index").agg(F.count(s).alias("kept"), F.count_if(F.col("SNPID").isNotNull() & s.isNull()).alias("cleared"))


@query("fill_sample_size", "SELECT v.job_index, round(sum(coalesce(CASE WHEN POS % 2 = 0 THEN N END, perf)), 4) AS total FROM variants v LEFT JOIN jobs j ON v.job_index = j.job_index GROUP BY v.job_index")
def fill_sample_size(spark, d):
    v = _v(spark, d).withColumn("N", F.when(F.col("POS") % 2 == 0, F.col("N")))
    out = h.fill_sample_size(v, view(spark, d, "jobs").select("job_index", F.col("perf").alias("meta_n")))
    return rounded(out.groupBy("job_index").agg(F.sum("n_final").alias("total")), 4)


@query("standardise_sumstats", "SELECT row_id, CHR, POS AS pos, EA, NEA FROM variants")
def standardise_sumstats(spark, d):
    raw = _v(spark, d).select(F.concat_ws(":", "CHR", "POS", "NEA", "EA").alias("MarkerName"), F.lower("EA").alias("effect_allele"), F.col("row_id").cast("string").alias("rid"))
    out = h.standardise(raw.withColumn("keep", F.col("rid")), {"SNPID": ["rsid"], "CHR": ["chrom"], "POS": ["bp"], "EA": ["effect_allele"], "NEA": ["other_allele"], "ROW": ["keep"]}, "MarkerName")
    return out.select(F.col("ROW").cast("long").alias("row_id"), "CHR", F.col("POS").cast("long").alias("pos"), "EA", "NEA")


@query("alias_first_match", "SELECT 'l_partkey' AS found, count(*) AS rows FROM lineitem")
def alias_first_match(spark, d):
    df = spark.read.parquet(f"{d}/lineitem.parquet")
    return df.agg(F.lit(h.alias_first(df, ["snp", "L_PARTKEY", "l_orderkey"])).alias("found"), F.count(F.lit(1)).alias("rows"))


# filters of the catalog

@query("has_sumstats", "SELECT count(*) AS kept FROM orders WHERE o_orderstatus <> 'F'")
def has_sumstats(spark, d):
    s = spark.read.parquet(f"{d}/orders.parquet").select(F.when(F.col("o_orderstatus") == "F", F.lit(" N/A ")).otherwise(F.lit("https://x")).alias("summaryStatistics"))
    return catalog.with_sumstats(s).agg(F.count(F.lit(1)).alias("kept"))


@query("population_filter", "SELECT r_name AS name FROM region WHERE lower(r_name) LIKE '%asia%'")
def population_filter(spark, d):
    return catalog.in_population(spark.read.parquet(f"{d}/region.parquet"), "asia", "r_name").select(F.col("r_name").alias("name"))


@query("fuzzy_threshold")
def fuzzy_threshold(spark, d):
    return catalog.matching(spark.read.parquet(f"{d}/part.parquet"), "small ring", "p_name").select("p_partkey", "similarity")


@query("scan_catalog_tsv", "SELECT CAST(s_suppkey AS VARCHAR) AS accessionId, s_name AS reportedTrait, '' AS efoTraits FROM supplier")
def scan_catalog_tsv(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("STUDY ACCESSION"), F.concat(F.lit(" "), "s_name").alias("DISEASE/TRAIT"))
    return catalog.canonical(s).select("accessionId", "reportedTrait", "efoTraits")


@query("running_rank_id", "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_nationkey DESC, CAST(s_suppkey AS VARCHAR)) AS INT) AS rank FROM supplier")
def running_rank_id(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("accessionId"), F.col("s_name").alias("reportedTrait"), F.col("s_acctbal").alias("cases"), F.col("s_nationkey").alias("samples"), "s_suppkey")
    return catalog.ranked(s).select("s_suppkey", "rank")


@query("choose_best_candidate", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_partkey % 3 = 0 THEN 130 WHEN p_partkey % 3 = 1 THEN 30 ELSE -50 END DESC, p_size DESC, CASE p_partkey % 3 WHEN 0 THEN 'harmonised_' WHEN 1 THEN 'raw_' ELSE 'readme_' END || CAST(p_partkey AS VARCHAR) || '.tsv.gz') AS r FROM part) WHERE r = 1")
def choose_best_candidate(spark, d):
    k = F.col("p_partkey") % 3
    name = F.concat(F.when(k == 0, "harmonised_").when(k == 1, "raw_").otherwise("readme_"), F.col("p_partkey").cast("string"), F.when(k == 2, "").otherwise(".tsv.gz"))
    c = spark.read.parquet(f"{d}/part.parquet").select("p_brand", "p_partkey", name.alias("candidate_name"), F.col("p_size").alias("candidate_size"))
    return sniff.best_candidate(c, ["p_brand"]).select("p_brand", "p_partkey")


# sources, over lines made of the tables

@query("scan_bim", "SELECT SNPID, CHR, POS, A1, A2 FROM target")
def scan_bim(spark, d):
    lines = view(spark, d, "target").select(F.concat_ws("  ", F.concat(F.lit("chr"), "CHR"), "SNPID", F.lit("0"), "POS", F.lower("A1"), "A2").alias("value"))
    return plink.bim(lines).select("SNPID", "CHR", "POS", "A1", "A2")


@query("scan_fam", "SELECT FID, IID, SEX, CASE WHEN PHENO > 0 THEN PHENO END AS PHENO FROM samples")
def scan_fam(spark, d):
    s = view(spark, d, "samples")
    return plink.fam(s.select(F.concat_ws(" ", "FID", "IID", F.lit("0"), F.lit("0"), "SEX", F.col("PHENO").cast("int")).alias("value")))


@query("scan_frq", "SELECT SNPID, round(MAF, 8) AS MAF, least(A1, A2) || '/' || greatest(A1, A2) AS pair FROM target")
def scan_frq(spark, d):
    v = view(spark, d, "target")
    lines = v.select(F.concat_ws(" ", "CHR", "SNPID", "A1", "A2", "MAF", F.lit("200")).alias("value")).unionByName(spark.createDataFrame([("CHR SNP A1 A2 MAF NCHROBS",)], "value string"))
    return rounded(plink.frq(lines).select("SNPID", "MAF", "pair"))


@query("scan_assoc", "SELECT SNPID, CHR, A1, A2, round(BETA, 6) + 0.0 AS BETA FROM target")
def scan_assoc(spark, d):
    t_ = view(spark, d, "target")
    raw = t_.select(F.col("SNPID").alias("SNP"), F.exp("BETA").alias("OR"), "P", F.col("A1"))
    return rounded(plink.assoc(raw, t_).select("SNPID", "CHR", "A1", "A2", "BETA"), 6)


@query("scan_clumped", "SELECT count(*) AS clumps, round(min(P), 8) AS min_p, round(median(P), 8) AS median_p, CAST(sum(POS % 4) AS BIGINT) AS members, CAST(max(POS % 4) AS INT) AS largest FROM target")
def scan_clumped(spark, d):
    sp2 = F.when(F.col("POS") % 4 == 0, "NONE").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), (F.col("POS") % 4).cast("int")), lambda i: F.concat(F.lit("rs"), i.cast("string"))), ","))
    return rounded(plink.clump_summary(view(spark, d, "target").select("CHR", "P", F.when(F.col("POS") % 4 == 0, "NONE").otherwise(sp2).alias("SP2"))))


@query("scan_all_score", "SELECT IID, label, round(CASE label WHEN 'Pt_0.05' THEN 0.05 ELSE 0.5 END, 8) AS pvalue, round(CASE label WHEN 'Pt_0.05' THEN AGE ELSE AGE * 2 END, 8) AS score FROM samples, (VALUES ('Pt_0.05'), ('Pt_0.5')) t(label)")
def scan_all_score(spark, d):
    wide = view(spark, d, "samples").select("FID", "IID", F.col("AGE").alias("Pt_0.05"), (F.col("AGE") * 2).alias("Pt_0.5"))
    return rounded(plink.all_scores(wide).select("IID", "label", "pvalue", "score"))


@query("scan_profile", "SELECT IID, AGE AS score FROM samples")
def scan_profile(spark, d):
    return plink.profile_scores(view(spark, d, "samples").select("FID", "IID", F.col("AGE").alias("SCORE"))).select("IID", "score")


@query("scan_cov", "SELECT IID, AGE FROM samples")
def scan_cov(spark, d):
    s = view(spark, d, "samples").select("FID", "IID", F.col("AGE").cast("string").alias("AGE"), F.lit("site").alias("note"))
    return plink.numeric_columns(s).drop("FID")


@query("scan_reference_vcf", "SELECT CHR, POS, SNPID FROM target")
def scan_reference_vcf(spark, d):
    lines = view(spark, d, "target").select(F.concat_ws("\t", "CHR", "POS", "SNPID", F.lit("A")).alias("value")).unionByName(spark.createDataFrame([("#CHROM\tPOS\tID",)], "value string"))
    return plink.vcf_places(lines)


@query("detect_compression")
def detect_compression(spark, d):
    return sniff.compression(spark, f"{d}/region.parquet").select("length", "extension", "magic", "compression", "mismatch")


@query("file_hash")
def file_hash(spark, d):
    return sniff.file_hash(spark, f"{d}/nation.parquet").select("length", "sha256")


@query("list_files")
def list_files(spark, d):
    files = spark.read.format("binaryFile").load(f"{d}/*.parquet").select("path", "length")
    return sniff.manifest(files, pattern=r"(?i)\.parquet$", skip="(?i)documents").select("job_index", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


# models and streams

def _lopo(spark, d, kind, **options):
    f = view(spark, d, "features")
    return ml.evaluate(ml.hold_one_out(f, ["f_size", "f_rate", "f_const"], "target", "phenotype", kind, **options), "target", "phenotype", "job_index")


@query("lopo_cv")
def lopo_cv(spark, d):
    return _lopo(spark, d, "ridge")


@query("lopo_lasso")
def lopo_lasso(spark, d):
    return _lopo(spark, d, "lasso")


@query("lopo_elastic_net")
def lopo_elastic_net(spark, d):
    return _lopo(spark, d, "elastic_net")


@query("lopo_forest")
def lopo_forest(spark, d):
    return _lopo(spark, d, "forest")


@query("lopo_boosting")
def lopo_boosting(spark, d):
    return _lopo(spark, d, "boosting")


@query("lopo_extra_trees")
def lopo_extra_trees(spark, d):
    return _lopo(spark, d, "extra_trees")


@query("lopo_hist_boosting")
def lopo_hist_boosting(spark, d):
    """With 30 rounds: at a pass for each level of each tree, the 300 of the learner take
    minutes for these few files."""
    return _lopo(spark, d, "hist_boosting", trees=30)


@query("native_importance")
def native_importance(spark, d):
    names = ["f_size", "f_rate", "f_const"]
    model = ml.pipeline(names, "target").fit(view(spark, d, "features"))
    return spark.createDataFrame(ml.importances(model, names), "feature string, importance double")


@query("final_fit_rank")
def final_fit_rank(spark, d):
    return ml.final_rank(view(spark, d, "features"), ["f_size", "f_rate"], "target", "phenotype", "job_index").select("job_index", "phenotype", "fitted", "place")


@query("best_model_select", "SELECT phenotype, label, round(test, 8) AS test FROM (SELECT phenotype, label, test, row_number() OVER (PARTITION BY phenotype ORDER BY test DESC, label) AS r FROM (SELECT phenotype, label, avg(test) AS test FROM folds JOIN jobs USING (job_index) GROUP BY ALL)) WHERE r = 1")
def best_model_select(spark, d):
    a = view(spark, d, "folds").join(view(spark, d, "jobs"), "job_index").groupBy("phenotype", "label").agg(F.avg("test").alias("test"))
    return rounded(ml.best_model(a, ["phenotype"], "test", "label"))


@query("baseline_delta", "SELECT label, round(avg(test) - 0.6, 8) AS delta FROM folds GROUP BY label")
def baseline_delta(spark, d):
    return rounded(view(spark, d, "folds").groupBy("label").agg((F.avg("test") - 0.6).alias("delta")))


@query("stream_counts", "SELECT job_index, count(*) AS rows, count(P) AS with_p, count(*) FILTER (WHERE P < 5e-8) AS genome_wide, count(*) FILTER (WHERE P < 1e-5) AS suggestive, sum(N) AS sum_n FROM variants GROUP BY job_index")
def stream_counts(spark, d):
    """The running counts of a stream, over a table: the same Columns."""
    return incremental.counts(_v(spark, d))


@query("stream_windows", "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    return rounded(incremental.windowed(spark.read.parquet(f"{d}/events.parquet")), 6)


@query("skip_if_exists", "SELECT count(*) AS rows FROM nation")
def skip_if_exists(spark, d):
    """A table that is written once and read again."""
    from assocframe.runtime import shared_dir
    from assocframe.sources import sinks

    path = f"{shared_dir(spark)}/nation-once"
    sinks.write(spark.read.parquet(f"{d}/nation.parquet"), path, "csv")
    return materialise(spark.read.option("header", True).csv(path), "nation").agg(F.count(F.lit(1)).alias("rows"))
