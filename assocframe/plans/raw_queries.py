"""Queries over raw texts: headers, ids, chromosomes, positions, sizes and numbers as
files spell them. Each spelling is made from the rows of a table by expressions that
both engines read, and what it must be read as is known from the row that it was made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assocframe.functions import genomic as g, numeric as m, stats as st, text as t
from assocframe.operators import dataset as ds, harmonise as h, prs
from assocframe.plans.base import query, rounded
from assocframe.plans.views import view
from assocframe.sources import catalog, plink, sniff

_ROW = {"o": "l_orderkey", "l": "l_linenumber"}


def _text(x: str) -> str:
    return f"CAST({x} AS VARCHAR(30))"


def _choose(by: str, *what: str) -> str:
    """what[by % len(what)]"""
    whens = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(what))
    return f"CASE CAST({by} % {len(what)} AS INT) {whens} END"


def made(spark: SparkSession, d: str, table: str, columns: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet").selectExpr(*[f"{e} AS {k}" for k, e in columns.items()])


def told(table: str, columns: dict[str, str]) -> str:
    return f"SELECT {', '.join(f'{e} AS {k}' for k, e in columns.items())} FROM {table}"


# chromosomes, positions, alleles, builds and ids

_N = "l_partkey % 25 + 1"
_CHR = _ROW | {"raw": _choose("l_orderkey", f"'chr' || {_text(_N)}", f"' ' || {_text(_N)} || ' '", f"'CHR' || {_text(_N)}", _text(_N), "'chrM'")}


@query("normalise_chr", told("lineitem", _CHR | {"chr": f"CASE WHEN l_orderkey % 5 = 4 OR {_N} = 25 THEN 'MT' WHEN {_N} = 24 THEN 'Y' WHEN {_N} = 23 THEN 'X' ELSE {_text(_N)} END"}))
def normalise_chr(spark, d):
    return made(spark, d, "lineitem", _CHR).withColumn("chr", g.normal_chr(F.col("raw")))


_P = "CAST(l_partkey * 7919 + 1000 AS BIGINT)"
_POS = _ROW | {"raw": _choose("l_orderkey", f"{_text(f'CAST(floor({_P} / 1000) AS BIGINT)')} || ',' || lpad({_text(f'{_P} % 1000')}, 3, '0')", f"{_text(_P)} || '.0'", f"'-' || {_text(_P)}", f"'x' || {_text(_P)}", _text(_P))}


@query("normalise_pos", told("lineitem", _POS | {"pos": f"CASE WHEN l_orderkey % 5 NOT IN (2, 3) THEN {_P} END"}))
def normalise_pos(spark, d):
    return made(spark, d, "lineitem", _POS).withColumn("pos", g.normal_pos(F.col("raw")))


_A1, _A2 = "substring('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1)", "substring('ACGT', CAST((l_partkey + 1 + l_suppkey % 3) % 4 AS INT) + 1, 1)"
_C1, _C2 = f"translate({_A1}, 'ACGT', 'TGCA')", f"translate({_A2}, 'ACGT', 'TGCA')"
_ALLELES = _ROW | {"a1": _A1, "a2": _A2, "ea": _choose("l_orderkey", f"lower({_A1})", _A2, _C1, _C2, "'-'", _A1), "nea": _choose("l_orderkey", _A2, f"' ' || {_A1}", _C2, _C1, _A2, f"CASE WHEN l_linenumber > 3 THEN 'N/A' ELSE {_A1} END")}
_AMBIGUOUS = f"{_A1} || {_A2} IN ('AT', 'TA', 'CG', 'GC')"
_STATUS = _choose("l_orderkey", "'direct_match'", "'flip_match'", "'strand_match'", "'strand_flip_match'", "'missing_allele'", "CASE WHEN l_linenumber > 3 THEN 'missing_allele' ELSE 'mismatch' END")


@query("allele_match_status", told("lineitem", _ALLELES | {"status": f"CASE WHEN {_AMBIGUOUS} AND l_orderkey % 6 < 4 THEN 'palindromic_ambiguous' ELSE {_STATUS} END"}))
def allele_match_status(spark, d):
    return made(spark, d, "lineitem", _ALLELES).withColumn("status", g.match_status(*[g.normal_allele(F.col(c)) for c in ("ea", "nea", "a1", "a2")]))


_BUILD = {"o": "o_orderkey", "raw": _choose("o_orderkey", "'GRCh37.p' || o_orderstatus", "'hg38'", "' build37'", "'b38'", "lower(o_orderpriority)", "'NCBI 37'")}


@query("build_normalise", told("orders", _BUILD | {"build": _choose("o_orderkey", "'hg19'", "'hg38'", "'hg19'", "'hg38'", "'unknown'", "'hg19'")}))
def build_normalise(spark, d):
    return made(spark, d, "orders", _BUILD).withColumn("build", g.build_name(F.col("raw")))


_ID = _ROW | {"id": _choose("l_orderkey", f"'chr' || {_text('l_partkey % 22 + 1')} || ':' || {_text(_P)} || ':' || {_A1} || ':' || {_A2}", f"'rs' || {_text('l_partkey')}", f"'X_' || {_text(_P)}")}
_PARSED = {
    "id_chr": _choose("l_orderkey", _text("l_partkey % 22 + 1"), "NULL", "'X'"),
    "id_pos": f"CASE WHEN l_orderkey % 3 <> 1 THEN {_P} END",
    "id_nea": f"CASE WHEN l_orderkey % 3 = 0 THEN {_A1} END",
    "id_ea": f"CASE WHEN l_orderkey % 3 = 0 THEN {_A2} END",
    "id_rs": f"CASE WHEN l_orderkey % 3 = 1 THEN 'rs' || {_text('l_partkey')} END",
}


@query("parse_compound_id", told("lineitem", _ID | _PARSED))
def parse_compound_id(spark, d):
    df = made(spark, d, "lineitem", _ID)
    return df.select("o", "l", "id", *[c.alias(k) for k, c in h.parse_compound(F.col("id")).items()])


# numbers, sizes and descriptions

_Q = "CAST(l_quantity AS BIGINT)"
_NUMBER = _ROW | {"raw": _choose("l_orderkey", f"{_text(_Q)} || ',' || lpad({_text('l_linenumber')}, 3, '0')", f"{_text(_Q)} || '%'", "'Yes'", "' false'", "'nan'", f"{_text(_Q)} || 'e-3'", "''", "'inf'", f"{_text(_Q)} || '.5d'")}


@query("clean_numeric", told("lineitem", _NUMBER | {"value": _choose("l_orderkey", f"CAST({_Q} * 1000 + l_linenumber AS DOUBLE)", f"CAST({_Q} AS DOUBLE)", "1.0", "0.0", "NULL", f"round({_Q} / 1000.0, 6)", "NULL", "NULL", "NULL")}))
def clean_numeric(spark, d):
    return rounded(made(spark, d, "lineitem", _NUMBER).withColumn("value", m.clean_number(F.col("raw"))), 6)


_SIZE = _ROW | {"raw": _choose("l_orderkey", f"{_text(_Q)} || 'K'", f"{_text(_Q)} || '.5M'", f"' ' || {_text(_Q)} || 'g'", _text(_Q), "'-'")}


@query("parse_size", told("lineitem", _SIZE | {"bytes": _choose("l_orderkey", f"{_Q} * 1024", f"{_Q} * 1048576 + 524288", f"{_Q} * 1073741824", _Q, "NULL")}))
def parse_size(spark, d):
    return made(spark, d, "lineitem", _SIZE).withColumn("bytes", t.parse_size(F.col("raw")))


_CASES, _CONTROLS = "CAST(1000 + o_custkey % 9000 AS BIGINT)", "CAST(1000 + o_orderkey % 8000 AS BIGINT)"
_WITH_COMMA = lambda x: f"{_text(f'CAST(floor({x} / 1000) AS BIGINT)')} || ',' || lpad({_text(f'{x} % 1000')}, 3, '0')"
_SAMPLE = {"o": "o_orderkey", "description": _choose("o_orderkey", f"{_WITH_COMMA(_CASES)} || ' European ancestry cases, ' || {_text(_CONTROLS)} || ' European ancestry controls'", f"'up to ' || {_WITH_COMMA(_CASES)} || ' individuals'", "o_orderpriority")}


@query("extract_samples", told("orders", _SAMPLE | {"cases": f"CASE WHEN o_orderkey % 3 = 0 THEN {_CASES} END", "controls": f"CASE WHEN o_orderkey % 3 = 0 THEN {_CONTROLS} END", "samples": f"CASE WHEN o_orderkey % 3 = 0 THEN {_CASES} + {_CONTROLS} WHEN o_orderkey % 3 = 1 THEN {_CASES} END"}))
def extract_samples(spark, d):
    return catalog.counted(made(spark, d, "orders", _SAMPLE), "description")


_LABEL = {"p": "p_partkey", "label": _choose("p_partkey", f"'Pt_0.' || lpad({_text('p_size')}, 3, '0')", f"'Pt_' || {_text('p_size')} || 'e-05'", f"'p_' || {_text('p_size')}")}


@query("prsice_label_to_pvalue", told("part", _LABEL | {"pvalue": _choose("p_partkey", "round(p_size / 1000.0, 8)", "round(p_size / 100000.0, 8)", "NULL")}))
def prsice_label_to_pvalue(spark, d):
    return rounded(made(spark, d, "part", _LABEL).withColumn("pvalue", plink.threshold_of(F.col("label"))))


_TOKEN = {"v": _choose("o_orderkey", "' '", "'N/A'", "o_orderpriority", "'null'", "NULL", "' None '")}


@query("missing_tokens", "SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 6 <> 2) AS missing FROM orders")
def missing_tokens(spark, d):
    return made(spark, d, "orders", _TOKEN).agg(F.count(F.lit(1)).alias("rows"), F.count_if(t.is_missing(F.col("v"))).alias("missing"))


# headers: a file for each order, with more or fewer columns

_SPELT = (("SNP", "rsID"), ("BP", "base pair location"), ("A1", "Effect_Allele"), ("A2", "other.allele"), ("P", "P-value"), ("BETA", "beta"), ("SE", "Standard.Error"), ("N", "Sample Size"), ("EAF", "[eaf]"), ("UNMAPPED", "clerk"), ("CHR", "Chrom"))
_WIDTH = "(o_orderkey % 11 + 1)"


def _headers(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(b) for _, b in _SPELT])
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("file"), F.explode(F.slice(names, 1, F.expr(f"int{_WIDTH}"))).alias("raw_header"))


_HEADERS = "c(i, standard, raw_header) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_SPELT)) + f"), r AS (SELECT o_orderkey AS file, standard, raw_header FROM orders JOIN c ON i < {_WIDTH})"
_HAVE = "s AS (SELECT file, count(*) AS columns, count(*) FILTER (WHERE standard <> 'UNMAPPED') AS mapped, list_sort(list(standard) FILTER (WHERE standard <> 'UNMAPPED')) AS h FROM r GROUP BY file)"


@query("map_headers", f"WITH {_HEADERS} SELECT raw_header, standard, count(*) AS files FROM r GROUP BY ALL")
def map_headers(spark, d):
    return h.map_headers(_headers(spark, d)).groupBy("raw_header", "standard").agg(F.count(F.lit(1)).alias("files"))


@query("coverage_flags", f"""WITH {_HEADERS}, {_HAVE}, f AS (SELECT *, list_contains(h, 'BETA') AS e FROM s)
 SELECT file, columns, mapped, columns - mapped AS unmapped, e AS has_effect, e AND list_contains(h, 'SNP') AND list_has_all(h, ['A1', 'P']) AS prs_minimum, list_has_all(h, ['SNP', 'A1', 'A2', 'N', 'P']) AS ldsc_minimum FROM f""")
def coverage_flags(spark, d):
    return h.coverage_flags(h.map_headers(_headers(spark, d)), ["file"]).drop("signature")


@query("agg_header_profile", f"WITH {_HEADERS}, {_HAVE} SELECT file, columns, mapped, sha1(array_to_string(h, '|')) AS signature FROM s")
def agg_header_profile(spark, d):
    return h.coverage_flags(h.map_headers(_headers(spark, d)), ["file"]).select("file", "columns", "mapped", "signature")


@query("header_hash", "SELECT o_orderkey AS file, sha1(lower(o_orderstatus || '|' || o_orderpriority || '|clerk')) AS signature, sha256(lower(o_orderpriority)) AS name FROM orders")
def header_hash(spark, d):
    names = F.array(*[t.normal_header(c) for c in (F.col("o_orderstatus"), F.lit("[clerk]"))])
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("file"), names.alias("n"), F.lower("o_orderpriority").alias("p"))
    return o.select("file", F.sha1(F.concat_ws("|", F.get("n", F.lit(0)), "p", F.get("n", F.lit(1))).cast("binary")).alias("signature"), F.sha2(F.col("p").cast("binary"), 256).alias("name"))


# lines of files: one for each customer

_SEPARATED = (("tab", "\t"), ("comma", ","), ("semicolon", ";"), ("pipe", "|"), ("space", " "))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Comments, a header for two files of three, and three rows, with the delimiter by
    the customer's key."""
    key = F.col("c_custkey")
    by = F.element_at(F.array(*[F.lit(x) for _, x in _SEPARATED]), (key % 5).cast("int") + 1)
    head = F.when(key % 3 != 0, F.concat_ws("", F.lit("SNP"), by, F.lit("CHR"), by, F.lit("P")))
    rows = [F.concat_ws("", (key + i).cast("string"), by, F.lit("7"), by, F.lit("0.5")) for i in range(3)]
    every = F.filter(F.concat(F.when(key % 2 == 0, F.array(F.lit("# note"), F.lit("# more"))).otherwise(F.array().cast("array<string>")), F.array(head, *rows)), lambda x: x.isNotNull())
    return spark.read.parquet(f"{d}/customer.parquet").select(key.alias("file"), F.posexplode(every).alias("n", "line"))


@query("detect_delimiter", f"SELECT c_custkey AS file, {_choose('c_custkey', *[chr(39) + n + chr(39) for n, _ in _SEPARATED])} AS delimiter, 3 AS fields FROM customer")
def detect_delimiter(spark, d):
    return sniff.delimiter(_lines(spark, d), ["file"])


@query("detect_header", "SELECT c_custkey AS file, c_custkey % 3 <> 0 AS has_header, CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END END AS header_line, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS comments FROM customer")
def detect_header(spark, d):
    return sniff.header(_lines(spark, d), ["file"], "n").drop("header")


# features and statistics

_FEATURE = {"feature": "replace(lower(p_type), ' ', '_') || " + _choose("p_partkey", "'_rate'", "'_Test_AUC'", "'_best_model'", "'_n'", "'_gap'")}


@query("leakage_audit", f"WITH n AS (SELECT DISTINCT feature FROM ({told('part', _FEATURE)})) SELECT feature, " + " OR ".join(f"contains(lower(feature), '{x}')" for x in ds.LEAKY) + " AS leaky, array_to_string(list_filter([" + ", ".join(f"'{x}'" for x in ds.LEAKY) + "], lambda x: contains(lower(feature), x)), ',') AS why FROM n")
def leakage_audit(spark, d):
    return ds.leakage(made(spark, d, "part", _FEATURE).distinct())


@query("agg_family_dtype", f"SELECT split_part(feature, '_', 1) AS family, count(*) AS columns FROM (SELECT DISTINCT feature FROM ({told('part', _FEATURE)})) GROUP BY 1")
def agg_family_dtype(spark, d):
    return ds.families(made(spark, d, "part", _FEATURE).distinct(), "feature")


@query("logspace_thresholds", "WITH g AS (SELECT i, pow(10.0, -10 + 10 * i / 19.0) AS threshold FROM range(20) t(i)) SELECT CAST(i AS INT) AS step, round(log10(threshold), 8) + 0.0 AS log_threshold, count(P) AS variants FROM g LEFT JOIN variants ON P <= threshold * (1 + 1e-12) GROUP BY i, threshold")
def logspace_thresholds(spark, d):
    """How many variants each step of the grid takes: counts by first step, summed."""
    grid = prs.thresholds(spark)
    first = F.ceil((F.log10("P") + 10) * 19 / 10 - 1e-9)
    by = view(spark, d, "variants").where("P is not null").groupBy(F.greatest(F.coalesce(first, F.lit(0)), F.lit(0)).cast("int").alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    out = grid.join(F.broadcast(by), F.col("_s") <= F.col("step"), "left")  # twenty rows and twenty
    return rounded(out.groupBy("step", F.log10("threshold").alias("log_threshold")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("variants")))


@query("skew_kurtosis", "SELECT job_index, round(skewness(BETA), 6) + 0.0 AS skew, round(kurtosis(BETA), 6) + 0.0 AS kurtosis FROM variants GROUP BY job_index")
def skew_kurtosis(spark, d):
    return rounded(view(spark, d, "variants").groupBy("job_index").agg(m.skewness(F.col("BETA")).alias("skew"), m.kurtosis(F.col("BETA")).alias("kurtosis")), 6)


@query("normal_quantile")
def normal_quantile(spark, d):
    """Of each variant's P: z, and chi-squared with one degree."""
    return view(spark, d, "variants").where("P > 0 and P < 1").select("row_id", "P", st.normal_quantile(F.col("P")).alias("z"), st.chi2_quantile_1(F.col("P")).alias("chi2"))


@query("erfc")
def erfc(spark, d):
    """Two-sided p of each variant's Z."""
    return view(spark, d, "variants").where("Z is not null").select("row_id", "Z", st.erfc(F.abs("Z") / F.sqrt(F.lit(2.0))).alias("p"))
