"""Profiles of a collection of association files: one aggregate row per file.

Each operator is a list of aggregate Columns, so that any number of them, over
all files, run in one grouped pass: profile(variants, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assocframe.functions import genomic as g, numeric as m, stats as s, text as t
from assocframe.operators import order

KEY = "job_index"
#: Lengths of the autosomes in base pairs of hg19 (fixed values).
HG19 = (249250621, 243199373, 198022430, 191154276, 180915260, 171115067, 159138663, 146364022, 141213431, 135534747, 135006516, 133851895, 115169878, 107349540, 102531392, 90354753, 81195210, 78077248, 59128983, 63025520, 48129895, 51304566)
AUTOSOMES = tuple(str(i) for i in range(1, 23))
CHI2_MEDIAN = 0.454936423119572
THRESHOLDS = (5e-8, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 0.05, 0.5)


def profile(variants: DataFrame, *groups: list[Column]) -> DataFrame:
    """One row per file with all the given aggregates, in one shuffle."""
    return variants.groupBy(KEY).agg(*[c for group in groups for c in group])


def inside(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when((c >= low) & (c <= high), c)


def pvalues(p: str = "P") -> list[Column]:
    x, raw = F.col(p).cast("double"), F.col(p).cast("string")
    ok = inside(x)
    return [
        m.rate(x.isNotNull()).alias("p_numeric_pct"),
        m.rate((x < 0) | (x > 1), x.isNotNull()).alias("p_out_of_range_pct"),
        F.count_if(ok == 0).alias("p_zero"),
        F.count_if(ok == 1).alias("p_one"),
        F.min(ok).alias("min_p"),
        m.median(ok).alias("median_p"),
        F.count_if(ok < 5e-8).alias("genome_wide"),
        m.rate(ok < 5e-8, ok.isNotNull()).alias("genome_wide_pct"),
        F.count_if(ok < 1e-5).alias("suggestive"),
        m.rate(ok < 1e-5, ok.isNotNull()).alias("suggestive_pct"),
        m.rate(raw.rlike("(?i)e[-+]?[0-9]+"), raw.isNotNull()).alias("p_scientific_pct"),
    ]


def sample_size(n: str = "N", cases: str = "N_CASES", controls: str = "N_CONTROLS") -> list[Column]:
    x = F.col(n)
    spread = F.try_divide(F.max(x) - F.min(x), F.max(x))
    return [
        m.rate(x.isNull()).alias("n_missing_pct"),
        m.median(x).alias("median_n"),
        F.min(x).alias("min_n"),
        F.max(x).alias("max_n"),
        spread.alias("n_spread"),
        F.when(spread < 0.001, "constant").when(spread.isNotNull(), "variable").otherwise("not_available").alias("n_kind"),
        m.effective_n(m.median(F.col(cases)), m.median(F.col(controls))).alias("n_effective"),
    ]


def variant_ids(snp: str = "SNPID") -> list[Column]:
    x = F.when(~t.is_missing(F.col(snp)), F.col(snp))
    part = lambda r: F.avg(x.rlike(r).cast("double"))
    rs, pair, four = part(r"(?i)^rs[0-9]+$"), part(r"^(chr)?[0-9XYMTxy]+[:_][0-9]+$"), part(r"^(chr)?[0-9XYMTxy]+[:_][0-9]+[:_][ACGTacgt]+[:_][ACGTacgt]+$")
    return [
        m.rate(x.isNull()).alias("id_missing_pct"),
        F.count_distinct(x).alias("ids_unique"),
        (100 * rs).alias("rsid_pct"),
        (100 * pair).alias("chrpos_pct"),
        (100 * four).alias("chrpos_allele_pct"),
        F.when(F.count(x) == 0, "not_available").when(rs >= 0.8, "rsID").when(four >= 0.8, "chr_pos_alleles").when(pair >= 0.8, "chr_pos").otherwise("mixed_or_other").alias("id_format"),
    ]


def alleles(ea: str = "EA", nea: str = "NEA") -> list[Column]:
    a, b = (F.when(~t.is_missing(F.col(c)), F.upper(F.trim(F.col(c)))) for c in (ea, nea))
    both, single = a.isNotNull() & b.isNotNull(), a.rlike("^[ACGT]$") & b.rlike("^[ACGT]$")
    n = F.count(a) + F.count(b)
    over = lambda f: m.pct(F.count_if(f(a)) + F.count_if(f(b)), n)
    symbolic = a.rlike("INS|DEL|-") | b.rlike("INS|DEL|-")
    lower, upper = F.col(ea).rlike("[a-z]") | F.col(nea).rlike("[a-z]"), F.col(ea).rlike("[A-Z]") | F.col(nea).rlike("[A-Z]")
    return [
        over(lambda x: ~x.rlike("^[ACGT]+$")).alias("non_acgt_pct"),
        over(lambda x: F.length(x) > 1).alias("multi_character_pct"),
        m.rate(symbolic | (F.length(a) != F.length(b)), both).alias("indel_pct"),
        m.rate(single, both).alias("single_base_pct"),
        m.rate(g.is_palindromic(a, b), both & single).alias("palindromic_pct"),
        m.rate(g.is_palindromic(a, b), both).alias("ambiguous_pct"),
        (F.coalesce(F.bool_or(lower), F.lit(False)) & F.coalesce(F.bool_or(upper), F.lit(False))).alias("case_mixed"),
    ]


def _range(x: Column, high: float, label: str) -> Column:
    n, ok = F.count(x), F.count(inside(x, 0, high))
    return F.when(n == 0, "not_available").when(ok == 0, "outside_expected_range").when(ok == n, label).otherwise("mixed_with_out_of_range")


def frequency(eaf: str = "EAF", maf: str = "MAF") -> list[Column]:
    """A MAF column, where it has values in range, counts before the effect
    allele's frequency."""
    e, f = F.col(eaf), F.col(maf)
    ok = inside(e)
    derived, given = F.least(ok, 1 - ok), inside(f, 0, 0.5)
    bands = (("rare", lambda x: x < 0.01), ("low", lambda x: (x >= 0.01) & (x < 0.05)), ("common", lambda x: x >= 0.05))
    return [
        m.rate(e.isNull()).alias("eaf_missing_pct"),
        m.rate(f.isNull()).alias("maf_missing_pct"),
        _range(e, 1.0, "range_0_1").alias("eaf_range"),
        _range(f, 0.5, "range_0_0_5").alias("maf_range"),
        m.median(ok).alias("median_eaf"),
        m.median(given).alias("median_maf"),
        *[F.when(F.count(given) > 0, m.rate(test(given), given.isNotNull())).otherwise(m.rate(test(derived), derived.isNotNull())).alias(f"{name}_pct") for name, test in bands],
    ]


def info(c: str = "INFO") -> list[Column]:
    x = F.col(c)
    ok = inside(x)
    return [
        m.rate(x.isNull()).alias("info_missing_pct"),
        _range(x, 1.0, "range_0_1").alias("info_range"),
        m.rate((x < 0) | (x > 1), x.isNotNull()).alias("info_out_of_range_pct"),
        m.median(ok).alias("median_info"),
        m.rate(ok < 0.3, ok.isNotNull()).alias("info_below_03_pct"),
        m.rate(ok < 0.8, ok.isNotNull()).alias("info_below_08_pct"),
    ]


def info_by_maf(c: str = "INFO", maf: str = "EAF") -> list[Column]:
    x = F.least(F.col(maf), 1 - F.col(maf))
    out = []
    for name, band in (("rare", x < 0.05), ("common", x >= 0.05)):
        out += [F.avg(F.when(band, F.col(c))).alias(f"info_mean_{name}"), m.rate(F.col(c) < 0.8, band & F.col(c).isNotNull()).alias(f"info_low_pct_{name}")]
    return out


def chromosomes(c: str = "CHR") -> list[Column]:
    x = F.upper(F.regexp_replace(F.col(c), "(?i)^chr", ""))
    auto, known = x.isin(*AUTOSOMES), x.isin(*AUTOSOMES, "X", "Y", "XY", "M", "MT")
    return [
        F.count_if(auto).alias("autosomal"),
        F.count_if(x.isin("X", "XY")).alias("chr_x"),
        F.count_if(x == "Y").alias("chr_y"),
        F.count_if(x.isin("M", "MT")).alias("chr_mt"),
        m.rate(~known, x.isNotNull()).alias("invalid_chr_pct"),
        m.rate(~auto, x.isNotNull()).alias("non_autosomal_pct"),
        (22 - F.count_distinct(F.when(auto, x))).alias("missing_autosomes"),
    ]


def chromosome_signature(variants: DataFrame, c: str = "CHR") -> DataFrame:
    """job_index and `chr:count` of each chromosome, sorted as text."""
    x = F.upper(F.regexp_replace(F.col(c), "(?i)^chr", "")).alias("chr")
    counts = variants.where(F.col(c).isNotNull()).groupBy(KEY, x).count()
    return counts.groupBy(KEY).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "chr", F.col("count").cast("string")))), ";").alias("signature"))


def effects() -> list[Column]:
    o, b, z, se, p = (F.col(c) for c in ("OR", "BETA", "Z", "SE", "P"))
    made = F.when(se != 0, b / se)
    pair = z.isNotNull() & made.isNotNull()
    logp, from_z = m.neg_log10(p), m.neg_log10(s.two_sided_p(z))
    return [
        m.rate(o <= 0, o.isNotNull()).alias("or_nonpositive_pct"),
        m.rate((o > 100) | (o < 0.01), o.isNotNull()).alias("or_extreme_pct"),
        m.rate(F.abs(b) > 10, b.isNotNull()).alias("beta_extreme_pct"),
        m.pearson(z, made).alias("z_correlation"),
        m.rate(F.abs(z - made) <= 0.01, pair).alias("z_concordance_pct"),
        m.pearson(logp, from_z).alias("p_correlation"),
        m.rate(F.abs(logp - from_z) <= 0.05, logp.isNotNull() & from_z.isNotNull()).alias("p_concordance_pct"),
    ]


def chi_square(variants: DataFrame) -> DataFrame:
    """variants with chi2, from the first source that a file has at all: Z, then
    BETA and SE, then P. What a file has is a row for each file."""
    made = F.when((F.col("SE") > 0), F.col("BETA") / F.col("SE"))
    has = variants.groupBy(F.col(KEY).alias("_file")).agg((F.count("Z") > 0).alias("_has_z"), (F.count(made) > 0).alias("_has_b"))
    p = F.when((F.col("P") > 0) & (F.col("P") <= 1), F.col("P"))
    known = variants.join(has, F.col(KEY).eqNullSafe(F.col("_file")))
    return known.withColumn("chi2", F.when(F.col("_has_z"), F.col("Z") * F.col("Z")).when(F.col("_has_b"), made * made).otherwise(F.pow(s.z_from_p(p), F.lit(2.0)))).drop("_file", "_has_z", "_has_b")


def inflation(variants: DataFrame) -> DataFrame:
    """Per file the median and mean of chi2, and how often Z isn't BETA / SE."""
    made = F.col("BETA") / F.when(F.col("SE") > 0, F.col("SE"))
    off = F.abs(F.col("Z") - made) > 0.1
    share = m.rate(off, F.col("Z").isNotNull() & made.isNotNull())
    middle = order.quantiles(variants, [KEY], "chi2", {"_median": 0.5}).select(F.col(KEY).alias("_file"), "_median")
    out = profile(variants, [F.avg("chi2").alias("mean_chi2"), share.alias("z_inconsistent_pct"), (share > 10).alias("z_inconsistent")])
    return out.join(middle, F.col(KEY).eqNullSafe(F.col("_file")), "left").select(KEY, (F.col("_median") / CHI2_MEDIAN).alias("lambda_gc"), "mean_chi2", "z_inconsistent_pct", "z_inconsistent")


def tail_inflation(variants: DataFrame, share: float = 0.01) -> DataFrame:
    """Median chi2 of the top share (one row at least) over the median of the law."""
    top = lambda n: F.greatest(F.lit(1), F.floor(n * share))
    out = order.at_places(variants, [KEY], "chi2", {"_m": lambda n: n - top(n) + (top(n) - 1) / 2})
    return out.select(KEY, (F.col("_m") / CHI2_MEDIAN).alias("lambda_tail"), top(F.col("total")).alias("tail_rows"))


def quantile_tails(variants: DataFrame, p: str = "P") -> DataFrame:
    """Observed over expected -log10 P in the top 5 and 1 percent, for files of
    100 rows or more, and a label of the pattern."""
    ok = variants.where((F.col(p) > 0) & (F.col(p) <= 1))
    top = lambda n, share: F.greatest(F.lit(1), F.floor(n * share))
    middle = lambda n, share: (top(n, share) - 1) / 2
    shares = {"5": 0.05, "1": 0.01}
    seen = order.at_places(ok, [KEY], p, {f"_seen_{k}": (lambda n, q=q: middle(n, q)) for k, q in shares.items()}, lambda v: -F.log10(v)).where("total >= 100")
    n = F.col("total")
    due = lambda k: -F.log10((k + 0.5) / n)  # noqa: E731  of the k-th row from 0
    of = lambda q: (due(F.floor(middle(n, q))) + due(F.ceil(middle(n, q)))) / 2
    out = seen.select(KEY, *[(F.col(f"_seen_{k}") / of(q)).alias(f"tail_{k}") for k, q in shares.items()])
    return out.withColumn("pattern", F.when(F.col("tail_5") > 1.2, "inflated").when(F.col("tail_1") > 1.2, "tail_enriched").when(F.col("tail_5") < 0.8, "deflated").otherwise("near_expected"))


def beta_distribution(c: str = "BETA") -> list[Column]:
    x = F.col(c)
    return [F.avg(x).alias("beta_mean"), F.stddev_samp(x).alias("beta_sd"), m.skewness(x).alias("beta_skew"), m.kurtosis(x).alias("beta_kurtosis"), m.quantile(F.abs(x), 0.95).alias("beta_p95"), m.quantile(F.abs(x), 0.99).alias("beta_p99"), m.rate(F.abs(F.col("Z")) > 5, F.col("Z").isNotNull()).alias("z_over_5_pct"), m.rate(F.abs(F.col("Z")) > 10, F.col("Z").isNotNull()).alias("z_over_10_pct")]


def se_distribution(c: str = "SE") -> list[Column]:
    x = F.col(c)
    q1, q3 = m.quantile(x, 0.25), m.quantile(x, 0.75)
    return [m.median(x).alias("se_median"), F.min(x).alias("se_min"), F.max(x).alias("se_max"), F.try_divide(F.stddev_samp(x), F.avg(x)).alias("se_cv"), F.count_if(x == 0).alias("se_zero"), F.count_if(x < 0).alias("se_negative"), F.coalesce(F.try_divide(q3, q1) > 5, F.lit(False)).alias("se_spread")]


def coverage(variants: DataFrame, lengths: tuple[int, ...] = HG19) -> DataFrame:
    """Per file and autosome: variants, density per Mb, share of empty 1-Mb bins;
    chromosomes without variants are listed."""
    spark = variants.sparkSession
    dim = spark.createDataFrame([(str(i + 1), n) for i, n in enumerate(lengths)], "CHR string, length long")
    found = variants.where(F.col("POS") > 0).groupBy(KEY, "CHR").agg(F.count(F.lit(1)).alias("variants"), F.count_distinct(F.floor((F.col("POS") - 1) / 1e6)).alias("bins"))
    every = variants.select(KEY).distinct().withColumn("CHR", F.explode(F.array(*[F.lit(c) for c in AUTOSOMES])))
    out = every.join(found, [KEY, "CHR"], "left").join(F.broadcast(dim), "CHR")
    return out.select(KEY, "CHR", F.coalesce("variants", F.lit(0)).alias("variants"), (F.coalesce("variants", F.lit(0)) / (F.col("length") / 1e6)).alias("per_mb"), (100 - 100 * F.coalesce("bins", F.lit(0)) / F.ceil(F.col("length") / 1e6)).alias("empty_bins_pct"))


def average_ranks(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """df with r_<column>: ranks within the key, ties averaged."""
    for c in columns:
        w = Window.partitionBy(*key)
        df = df.withColumn(f"r_{c}", F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*key, c)) - 1) / 2.0)
    return df


def spearman(df: DataFrame, key: list[str], x: str, y: str, name: str = "rho", least: int = 3) -> DataFrame:
    """Spearman's rho per key over complete pairs."""
    ranked = order.average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), key, [x, y])
    return ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("pairs"), m.pearson(F.col(f"r_{x}"), F.col(f"r_{y}"), least).alias(name))


def effect_distribution() -> list[Column]:
    b, o, se, z = (F.col(c) for c in ("BETA", "OR", "SE", "Z"))
    a = F.abs(b)
    return [
        F.count(b).alias("effects"), F.avg(b).alias("mean"), F.stddev_samp(b).alias("sd"), F.min(b).alias("min"), F.max(b).alias("max"), m.median(b).alias("median"),
        *[m.quantile(a, q).alias(f"abs_q{str(q)[2:]}") for q in (0.9, 0.95, 0.99, 0.999)],
        m.skewness(b).alias("skew"), m.kurtosis(b).alias("kurtosis"),
        *[F.count_if(a > k).alias(f"abs_over_{k}") for k in (1, 2, 5)],
        F.count_if(o > 10).alias("or_over_10"), F.count_if(o < 0.1).alias("or_under_01"),
        F.avg(se).alias("se_mean"), m.median(se).alias("se_median"), F.avg(F.abs(z)).alias("abs_z_mean"), m.median(F.abs(z)).alias("abs_z_median"),
        m.rate(b > 0, b.isNotNull()).alias("positive_pct"),
    ]


def pvalue_distribution(p: str = "P") -> list[Column]:
    x = F.col(p)
    ok = F.when((x > 0) & (x <= 1), x)
    return [F.count(ok).alias("valid"), (F.count(x) - F.count(ok)).alias("invalid"), F.count_if(x == 0).alias("zero"), *[m.quantile(ok, q).alias(f"q{int(q * 100):02d}") for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95)], F.avg(-F.log10(ok)).alias("log_mean"), F.max(-F.log10(ok)).alias("log_max"), *[c for k, v in enumerate(THRESHOLDS) for c in (F.count_if(ok <= v).alias(f"under_{k}"), m.rate(ok <= v, ok.isNotNull()).alias(f"under_{k}_pct"))]]


def duplicates(variants: DataFrame, keys: list[str]) -> DataFrame:
    """Per file: rows whose key occurs twice or more (members), and those beyond
    each key's first (extras)."""
    groups = variants.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(KEY, *keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy(KEY).agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("members"), F.sum(F.col("n") - 1).alias("extras"), F.count(F.lit(1)).alias("distinct"))


def formats(chrom: str = "CHR", snp: str = "SNPID", pos: str = "POS", allele: str = "EA", p: str = "P") -> list[Column]:
    """Labels of the formats of columns, by the share of values of each form."""
    txt = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string")))
    share = lambda x, r: F.avg(x.rlike(r).cast("double"))
    c, i, b, a, q = (txt(x) for x in (chrom, snp, pos, allele, p))
    none = lambda x, label: F.when(F.count(x) == 0, "all_missing").otherwise(label)
    number = F.col(p).cast("double")
    scale = F.when(F.count(number) == 0, "non_numeric").when((F.min(number) >= 0) & (F.max(number) <= 1), F.when(share(q, "(?i)e[-+]?[0-9]+") >= 0.5, "scientific_notation_0_1").otherwise("decimal_0_1")).when(F.min(number) >= 0, "possible_neg_log10_p").otherwise("mixed_or_other")
    return [
        none(c, F.when(share(c, "^chr[0-9xyXYmMtT]+$") >= 0.8, "chr_prefix").when(share(c, "^[0-9]+$") >= 0.8, "numeric").when(share(c, "(?i)^(X|Y|XY|MT|M)$") >= 0.5, "special").otherwise("mixed_or_other")).alias("chr_format"),
        none(i, F.when(share(i, "(?i)^rs[0-9]+$") >= 0.8, "rsID").when(share(i, "(?i)^(chr)?[0-9XYMT]+[:_][0-9]+[:_][ACGT]+[:_][ACGT]+$") >= 0.8, "chr_pos_alleles").when(share(i, "^(chr)?[0-9XYMTxy]+[:_][0-9]+$") >= 0.8, "chr_pos").otherwise("mixed_or_other")).alias("snp_format"),
        none(b, F.when(share(b, "^[0-9]+$") >= 0.95, "integer").when(share(b, "^[0-9]+$") >= 0.5, "mostly_integer").otherwise("non_numeric")).alias("bp_format"),
        none(a, F.when(share(a, "^[ACGT]$") >= 0.8, "single_base_upper").when(share(a, "^[acgt]$") >= 0.8, "single_base_lower").when(share(a, "(?i)ins|del|-") >= 0.2, "contains_indels").when(share(a, "^[ACGTacgt]{2,}$") >= 0.2, "multi_character").otherwise("mixed_or_invalid")).alias("allele_format"),
        none(q, scale).alias("p_format"),
    ]


def invalid_alleles(ea: str = "EA", nea: str = "NEA") -> list[Column]:
    bad = lambda c: F.count_if(F.col(c).isNotNull() & ~F.upper(F.col(c)).rlike("^[ACGT]$"))
    return [(bad(ea) + bad(nea)).alias("invalid_alleles"), m.pct(bad(ea) + bad(nea), F.count(ea) + F.count(nea)).alias("invalid_alleles_pct")]
