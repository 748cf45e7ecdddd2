"""From raw rows to canonical variants: header mapping, derived columns,
filters and deduplication, all as Columns and windows with explicit ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assocframe.functions import genomic as g, numeric as m, stats as s, text as t

#: Header synonyms of the canonical columns; on shared ones the first counts
#: (fixed values).
SYNONYMS: dict[str, tuple[str, ...]] = {
    "CHR": ("chr", "chrom", "chromosome", "chromo", "chro", "ch", "#chrom", "chr_pos", "chr_position", "chromosome_name", "chromosome_id", "hg19chr"),
    "SNP": ("snp", "markername", "marker", "rs", "rsid", "snpid", "snp_id", "snpname", "rs_number", "rs_id", "rsnumber", "variant_id", "variantid", "var_id", "marker_id", "markerid", "locus_id", "vcf_ids", "id", "name", "var_name"),
    "BP": ("bp", "b", "pos", "position", "phys_pos", "bpos", "genpos", "base_pair_location", "base_pair_position", "base_pair", "snp_pos", "markername"),
    "A1": ("a1", "a_1", "allele1", "allele_1", "allelea", "effect_allele", "effectallele", "eff_allele", "ea", "e", "coded_allele", "tested_allele", "inc_allele", "minor_allele", "minorallele", "ref", "reference_allele", "ref_allele", "allele0", "a0"),
    "A2": ("a2", "a_2", "allele2", "allele_2", "alleleb", "other_allele", "otherallele", "other", "non_effect_allele", "noneffect_allele", "noncoded_allele", "dec_allele", "nea", "oa", "alt", "alt_allele", "alternate_allele", "alternative_allele", "majorallele"),
    "N": ("n", "n_total", "ntotal", "total_n", "total_sample_size", "totalsamplesize", "sample_size", "samplesize", "n_samples", "nsample", "n_obs", "weight", "n_effective", "effective_n", "effective_sample_size"),
    "N_CASES": ("ncase", "n_case", "n_cases", "cases_n", "cases_total", "n_cas", "num_cases", "sample_size_cases"),
    "N_CONTROLS": ("ncontrol", "n_control", "n_controls", "controls_n", "controls_total", "n_con", "num_controls"),
    "P": ("p", "pval", "p_value", "pvalue", "p_val", "hetpval", "score_pval", "p_score", "p_bolt_lmm", "frequentist_add_pvalue", "robust_pval", "neg_log_10_p_value", "mtag_pval"),
    "INFO": ("info", "info_score", "imputation", "imputation_quality", "imputationinfo", "impute_info", "imp_quality", "imp_rsqr", "median_info", "n_informative"),
    "EAF": ("eaf", "frq", "frq1", "freq", "freq1", "frequency", "effect_allele_frequency", "effectallelefreq", "effect_allele_freq", "effect_af", "eff_allele_freq", "coded_allele_freq", "a1freq", "a1_freq", "freq_a1", "af", "af1", "allelefreq", "ref_allele_frequency"),
    "MAF": ("maf", "minorallelefrequency", "minorallelefreq", "expected_minor_allele_freq"),
    "BETA": ("beta", "b", "effect", "effects", "effect1", "effect_size", "effectsize", "estimate", "maineffects", "frequentist_add_beta_1", "betazscale"),
    "SE": ("se", "stderr", "standard_error", "standarderror", "standard_error_of_beta", "sebeta", "se_beta", "beta_se", "serror", "stderrlogor", "logor_se", "or_se", "se1", "mtag_se", "robust_se", "odds_ratio_se", "frequentist_add_se_1"),
    "OR": ("or", "odds_ratio", "oddsratio", "oddsratiominorallele", "odds", "log_odds", "log_or", "logor"),
    "Z": ("z", "z_value", "zscore", "z_score", "z_stat", "zval", "mtag_z", "weighted_z"),
    "DIRECTION": ("direction", "direct", "dir", "effect_direction", "direction_effects_cohorts", "mantra_dir", "cohort_dir"),
}

#: What a header may have at its ends beside its column's name: cohorts, sexes,
#: programs, builds, models and numbers. A header that isn't known is looked up without.
QUALIFIER = "all|females?|males?|cases?|controls?|eur|eas|afr|amr|sas|global|ancestry|european|multiancestry|association|ukbb?|hapmap|1000g|hm|plink|saige|gc|meta|metal|new|build3[678]|b3[678]|grch3[78]|hg1[89]|hg38|fixed|random|fix|rand|fe|re|ff|het|residual|level|study|variant|site[0-9]+|[0-9]+"


def synonyms(spark: SparkSession, table: dict[str, tuple[str, ...]] = SYNONYMS) -> DataFrame:
    """(normal_header, standard), one row per header: the first standard column
    that lists it."""
    seen: dict[str, str] = {}
    for standard, names in table.items():
        for n in names:
            seen.setdefault(n, standard)
    return spark.createDataFrame(sorted(seen.items()), "normal_header string, standard string")


def map_headers(headers: DataFrame, header: str = "raw_header", table: dict[str, tuple[str, ...]] = SYNONYMS, qualifier: str | None = QUALIFIER) -> DataFrame:
    """headers with normal_header, standard (or UNMAPPED) and identified. What `table`
    doesn't list is looked up once more without qualifiers at its end, at its start and
    at both (the name of one standard column is kept from another: cases and controls
    are never N). `table` may be any other; without `qualifier` only it counts."""
    known = F.broadcast(synonyms(headers.sparkSession, table))  # the table's rows
    out = headers.withColumn("normal_header", t.normal_header(F.col(header)))
    full = F.col("normal_header")
    tail, head = (lambda c: F.regexp_replace(c, f"(_({qualifier}))+$", "")), (lambda c: F.regexp_replace(c, f"^(({qualifier})_)+", ""))
    ways = [full] if qualifier is None else [full, tail(full), head(full), head(tail(full))]
    for i, way in enumerate(ways):
        one = known.select(F.col("normal_header").alias(f"_n{i}"), F.col("standard").alias(f"_s{i}"))
        out = out.join(one, way == F.col(f"_n{i}"), "left")
    found = [F.col(f"_s{i}") if not i else F.when(~(F.col(f"_s{i}").isin("N") & full.rlike("case|control")), F.col(f"_s{i}")) for i in range(len(ways))]
    out = out.withColumn("standard", F.coalesce(*found)).drop(*[f"_{k}{i}" for k in "ns" for i in range(len(ways))])
    return out.withColumn("identified", F.col("standard").isNotNull()).withColumn("standard", F.coalesce("standard", F.lit("UNMAPPED")))


def coverage_flags(mapped: DataFrame, key: list[str]) -> DataFrame:
    """Per key which standard columns are there, and what they suffice for."""
    have = F.collect_set(F.when(F.col("identified"), F.col("standard")))
    out = mapped.groupBy(*key).agg(have.alias("have"), F.count(F.lit(1)).alias("columns"), F.count_if(F.col("identified")).alias("mapped"))
    has = lambda c: F.array_contains("have", c)
    effect, place = has("BETA") | has("OR") | has("Z"), has("CHR") & has("BP")
    minimum = (has("SNP") | place) & has("A1") & has("P") & effect
    return out.select(*key, "columns", "mapped", (F.col("columns") - F.col("mapped")).alias("unmapped"), effect.alias("has_effect"), minimum.alias("prs_minimum"), (has("SNP") & has("A1") & has("A2") & has("N") & (has("Z") | has("P") | (has("BETA") & has("SE")))).alias("ldsc_minimum"), F.sha1(F.array_join(F.array_sort("have"), "|").cast("binary")).alias("signature"))


def alias_first(df: DataFrame, names: list[str]) -> str | None:
    """The first of the names that df has, whatever its case."""
    lower = {c.lower(): c for c in df.columns}
    return next((lower[n.lower()] for n in names if n.lower() in lower), None)


COMPOUND = r"(?i)^(?:chr)?([0-9]{1,2}|X|Y|XY|MT?)[:_]([0-9]+)(?:[:_]([ACGT]+)[:_]([ACGT]+))?"


def parse_compound(c: Column) -> dict[str, Column]:
    """Chromosome, position, alleles and rs id inside a compound id."""
    part = lambda i: F.nullif(F.regexp_extract(c, COMPOUND, i), F.lit(""))
    return {"id_chr": F.upper(part(1)), "id_pos": part(2).try_cast("long"), "id_nea": F.upper(part(3)), "id_ea": F.upper(part(4)), "id_rs": F.nullif(F.regexp_extract(c, r"(?i)(rs[0-9]+)", 1), F.lit(""))}


#: Canonical columns that are measured, and those that count.
MEASURES = {"EAF", "MAF", "BETA", "SE", "OR", "OR_95U", "OR_95L", "Z", "P", "INFO"}
COUNTS = {"N", "N_CASES", "N_CONTROLS"}


def standardise(raw: DataFrame, names: dict[str, list[str]], snp: str | None = None) -> DataFrame:
    """raw by canonical names: the first alias that exists, and for what is
    missing what a compound id says. MEASURES are doubles and COUNTS whole
    numbers; any other column stays text, so that no id passes through a double."""
    chosen = {k: alias_first(raw, v) for k, v in names.items()}
    ids = parse_compound(F.col(snp or chosen.get("SNPID") or raw.columns[0]))
    fall = {"CHR": ids["id_chr"], "POS": ids["id_pos"].cast("string"), "EA": ids["id_ea"], "NEA": ids["id_nea"], "SNPID": ids["id_rs"]}
    col = lambda k: F.col(chosen[k]).cast("string") if chosen[k] else F.lit(None).cast("string")
    count = lambda c: F.coalesce(c.try_cast("long"), m.parse_number(c).try_cast("long"))
    out = {k: F.coalesce(col(k), fall[k]) if k in fall else m.parse_number(col(k)) if k in MEASURES else count(col(k)) if k in COUNTS else col(k) for k in names}
    for k in ("EA", "NEA"):
        if k in out:
            out[k] = F.upper(out[k])
    return raw.select(*[c.alias(k) for k, c in out.items()])


def derive_effects(df: DataFrame) -> DataFrame:
    """BETA and OR from one another, with where each came from."""
    beta = F.coalesce("BETA", F.when(F.col("OR") > 0, F.log("OR")))
    source = F.when(F.col("BETA").isNotNull(), "reported").when(F.col("OR") > 0, "from_or").otherwise("missing")
    return df.withColumns({"beta_final": beta, "or_final": F.coalesce(F.when(F.col("OR") > 0, F.col("OR")), F.exp(beta)), "beta_source": source})


def derive_se(beta: Column, odds: Column, z: Column, upper: Column, lower: Column) -> Column:
    """By |BETA / Z|, |ln OR / Z|, then the width of OR's interval over 3.92."""
    log_or, ok = F.when(odds > 0, F.log(odds)), z != 0
    return F.coalesce(F.when(ok, F.abs(beta / z)), F.when(ok, F.abs(log_or / z)), F.when((upper > 0) & (lower > 0), (F.log(upper) - F.log(lower)) / 3.92))


def derive_signed_z(p: Column, beta: Column) -> Column:
    return F.when((p > 0) & (p <= 1), s.z_from_p(p) * F.signum(beta))


def build_snpid(df: DataFrame) -> DataFrame:
    made = F.when(F.col("CHR").isNotNull() & F.col("POS").isNotNull() & F.col("EA").isNotNull() & F.col("NEA").isNotNull(), F.concat_ws(":", "CHR", "POS", "NEA", "EA"))
    return df.withColumn("built_id", F.coalesce("SNPID", made))


def sanitise_snpid(c: Column) -> Column:
    return F.when(c.rlike("(?i)^rs[0-9]+$"), c)


def fill_sample_size(variants: DataFrame, meta: DataFrame) -> DataFrame:
    """Null sizes of variants from (job_index, meta_n), one small row per file."""
    return variants.join(meta, "job_index", "left").withColumn("n_final", F.coalesce("N", "meta_n")).drop("meta_n")


def variant_keys(df: DataFrame) -> DataFrame:
    c, p = g.normal_chr(F.col("CHR")), g.normal_pos(F.col("POS"))
    a, b = g.normal_allele(F.col("EA")), g.normal_allele(F.col("NEA"))
    place, pair = g.chrpos(c, p.cast("string")), g.canonical_pair(a, b)
    return df.withColumns({"rsid": g.normal_rsid(F.col("SNPID")), "chrpos": place, "pair": pair, "chrpos_alleles": F.when(place.isNotNull() & pair.isNotNull(), F.concat_ws(":", place, pair)), "palindromic": F.coalesce(g.is_palindromic(a, b), F.lit(False))})


def ldsc_condition() -> Column:
    c = F.col
    return c("SNPID").rlike("(?i)^rs[0-9]+$") & c("CHR").isin(*[str(i) for i in range(1, 23)]) & (c("POS") > 0) & c("EA").rlike("^[ACGT]$") & c("NEA").rlike("^[ACGT]$") & (c("EA") != c("NEA")) & c("BETA").isNotNull() & (c("SE") > 0) & (c("P") > 0) & (c("P") < 1)


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key: the first in an explicit order. A grouped minimum of
    structs, so rows are combined before the shuffle and hot keys don't meet."""
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    best = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*").select(*df.columns)


def dedup_best_p(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the row with the least P; nulls last, ties by row_id."""
    return first_by(df, keys, F.col("P").isNull(), F.coalesce("P", F.lit(0.0)), "row_id")


def ldsc_clean(variants: DataFrame) -> DataFrame:
    once = dedup_best_p(variants.where(ldsc_condition()), ["job_index", "SNPID"])
    return dedup_best_p(once, ["job_index", "CHR", "POS", "EA", "NEA"])


def valid_prs_row(tool: str = "plink") -> Column:
    c = F.col
    ok = (c("SNPID") != "") & c("EA").rlike("^[ACGT]$") & (c("P") > 0) & (c("P") <= 1)
    return ok & c("BETA").isNotNull() if tool == "plink" else ok & c("NEA").rlike("^[ACGT]$") & (c("EA") != c("NEA")) & (c("OR") > 0)


def fill_rsid(variants: DataFrame, reference: DataFrame) -> DataFrame:
    """Ids for rows without one, from (CHR, POS, EA, NEA, ref_id): the same
    alleles, then swapped ones, then the position. The reference has one row per
    key before it is joined, so no row multiplies. Rows that have an id aren't joined."""
    return matched(variants, reference).withColumn("filled_id", F.coalesce("SNPID", "by_alleles", "by_swap", "by_place")).drop("by_alleles", "by_swap", "by_place")


def matched(variants: DataFrame, reference: DataFrame) -> DataFrame:
    """variants with by_alleles, by_swap and by_place: the ids that a reference (CHR, POS,
    EA, NEA, ref_id) has for those that have none; null for the others."""
    four = first_by(reference.select("CHR", "POS", "EA", "NEA", "ref_id"), ["CHR", "POS", "EA", "NEA"], "ref_id")
    place = reference.groupBy("CHR", "POS").agg(F.min("ref_id").alias("by_place"))
    swap = four.select("CHR", "POS", F.col("NEA").alias("EA"), F.col("EA").alias("NEA"), F.col("ref_id").alias("by_swap"))
    found = variants.where("SNPID is null").join(four.withColumnRenamed("ref_id", "by_alleles"), ["CHR", "POS", "EA", "NEA"], "left").join(swap, ["CHR", "POS", "EA", "NEA"], "left").join(place, ["CHR", "POS"], "left")
    none = [F.lit(None).cast(dict(found.dtypes)[c]).alias(c) for c in ("by_alleles", "by_swap", "by_place")]
    return variants.where("SNPID is not null").select(*found.columns[:-3], *none).unionByName(found)


