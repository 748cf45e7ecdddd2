"""Overlaps and allele-aware joins between files, a target and references.

Joins are equi-joins on ids or coordinates; both sides have one row per key
first, so nothing fans out unless an operator says so. Target and reference
tables grow with their data and are not broadcast by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assocframe.functions import genomic as g, numeric as m
from assocframe.operators.harmonise import first_by
from assocframe.operators.profile import KEY

STATUSES = ("direct_match", "flip_match", "strand_match", "strand_flip_match", "palindromic_ambiguous", "mismatch", "missing_allele")


def overlap(variants: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Per file: distinct keys of the file, of the target, in both, and shares."""
    present = " and ".join(f"{k} is not null" for k in keys)
    ours = variants.where(present).select(KEY, *keys).distinct()
    theirs = target.where(present).select(*keys).distinct()
    total = theirs.agg(F.count(F.lit(1)).alias("target_keys"))
    both = ours.join(theirs.withColumn("_hit", F.lit(1)), keys, "left").groupBy(KEY).agg(F.count(F.lit(1)).alias("file_keys"), F.count("_hit").alias("shared"))
    return both.join(F.broadcast(total), F.lit(True)).select(KEY, "file_keys", "target_keys", "shared", m.pct(F.col("shared"), F.col("file_keys")).alias("file_pct"), m.pct(F.col("shared"), F.col("target_keys")).alias("target_pct"))


def difference(variants: DataFrame, target: DataFrame, key: str = "SNPID") -> DataFrame:
    """Distinct keys only in files, only in the target, and in both."""
    a = variants.where(f"{key} is not null").select(key).distinct().withColumn("_a", F.lit(True))
    b = target.where(f"{key} is not null").select(key).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_a").isNull(), "target_only").when(F.col("_b").isNull(), "files_only").otherwise("both")
    return a.join(b, key, "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("keys"), F.min(key).alias("first_key"))


def _counts(joined: DataFrame, status: Column) -> DataFrame:
    out = joined.withColumn("status", status).groupBy(KEY)
    return out.agg(F.count(F.lit(1)).alias("matched"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def allele_join(variants: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Per file the counts of allele statuses over rows that match by key; both
    sides keep the first row of a key."""
    present = " and ".join(f"{k} is not null" for k in keys)
    ours = first_by(variants.where(present).select(KEY, *keys, "EA", "NEA", "row_id"), [KEY, *keys], "row_id")
    theirs = first_by(target.where(present).select(*keys, "A1", "A2"), keys, "A1", "A2")
    return _counts(ours.join(theirs, keys), g.match_status(*[F.col(c) for c in ("EA", "NEA", "A1", "A2")]))


def id_then_coordinate(variants: DataFrame, target: DataFrame) -> DataFrame:
    """Rows matched by id, or else by coordinate, whose alleles are compatible;
    per row one target, the one with the least P, then id."""
    bim = target.select(F.col("SNPID").alias("t_id"), F.col("CHR").alias("t_chr"), F.col("POS").alias("t_pos"), "A1", "A2", F.col("P").alias("t_p"))
    by_id = variants.join(bim, variants.SNPID == bim.t_id).withColumn("how", F.lit("id"))
    rest = variants.join(target.select("SNPID"), "SNPID", "left_anti").select(*variants.columns)
    by_place = rest.join(bim, (rest.CHR == bim.t_chr) & (rest.POS == bim.t_pos)).withColumn("how", F.lit("coordinate"))
    both = by_id.unionByName(by_place).withColumn("status", g.match_status(*[F.col(c) for c in ("EA", "NEA", "A1", "A2")])).where(~F.col("status").isin("mismatch", "missing_allele"))
    return first_by(both.select(KEY, "row_id", "t_id", "t_p", "how", "status"), [KEY, "row_id"], "t_p", "t_id")


def usable_keys(variants: DataFrame, target: DataFrame) -> DataFrame:
    """Per file: distinct target variants matched by id or by coordinate with
    compatible alleles."""
    ok = ("direct_match", "flip_match", "strand_match", "strand_flip_match")
    bim = target.select(F.col("SNPID").alias("t_id"), F.col("CHR").alias("t_chr"), F.col("POS").alias("t_pos"), "A1", "A2")
    status = g.match_status(*[F.col(c) for c in ("EA", "NEA", "A1", "A2")])
    a = variants.join(bim, F.col("SNPID") == F.col("t_id")).where(status.isin(*ok)).select(KEY, "t_id")
    b = variants.join(bim, (F.col("CHR") == F.col("t_chr")) & (F.col("POS") == F.col("t_pos"))).where(status.isin(*ok)).select(KEY, "t_id")
    return a.union(b).distinct().groupBy(KEY).agg(F.count(F.lit(1)).alias("usable"))


def frequency_concordance(variants: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation and distance of minor allele frequencies over matched rows."""
    ours = first_by(variants.where(" and ".join(f"{k} is not null" for k in keys)).select(KEY, *keys, "EAF", "row_id"), [KEY, *keys], "row_id")
    theirs = first_by(target.select(*keys, F.col("MAF").alias("ref")), keys, "ref")
    x, y = F.least(F.col("EAF"), 1 - F.col("EAF")), F.col("ref")
    return ours.join(theirs, keys).groupBy(KEY).agg(F.count(F.lit(1)).alias("pairs"), m.pearson(x, y).alias("r"), F.avg(F.abs(x - y)).alias("mean_gap"), m.median(F.abs(x - y)).alias("median_gap"))


def association_concordance(mapped: DataFrame) -> DataFrame:
    """Per file, of rows with both effects: correlations of raw, signed (turned
    where alleles are flipped) and absolute effects, and of -log10 P."""
    flip = F.col("status").isin("flip_match", "strand_flip_match")
    a, b = F.col("BETA"), F.col("t_beta")
    turned = F.when(flip, -b).otherwise(b)
    return mapped.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(flip).alias("flipped"), m.pearson(a, b).alias("r_raw"), m.pearson(a, turned).alias("r_signed"), m.pearson(F.abs(a), F.abs(b)).alias("r_abs"),
        F.avg(F.abs(a - turned)).alias("mean_gap"), m.median(F.abs(a - turned)).alias("median_gap"), m.pearson(m.neg_log10(F.col("P")), m.neg_log10(F.col("t_p"))).alias("r_logp"),
    )


def build_by_overlap(variants: DataFrame, hg19: DataFrame, hg38: DataFrame) -> DataFrame:
    """Per file the build whose positions it shares more of; `tie` if neither."""
    ours = variants.select(KEY, "CHR", "POS").distinct()
    tag = lambda d, n: d.select("CHR", "POS").distinct().withColumn(n, F.lit(1))
    both = ours.join(tag(hg19, "_19"), ["CHR", "POS"], "left").join(tag(hg38, "_38"), ["CHR", "POS"], "left").groupBy(KEY).agg(F.count("_19").alias("hits_19"), F.count("_38").alias("hits_38"))
    return both.withColumn("build", F.when(F.col("hits_19") > F.col("hits_38"), "hg19").when(F.col("hits_38") > F.col("hits_19"), "hg38").otherwise("tie")).withColumn("minor_major_ratio", F.coalesce(F.try_divide(F.least("hits_19", "hits_38"), F.greatest("hits_19", "hits_38")), F.lit(0.0)))


def reference_overlap(variants: DataFrame, reference: DataFrame, least: int = 100) -> DataFrame:
    """Overlap by id where both sides have more than `least` of them, else by
    coordinate; with the way that was taken."""
    ids, places = overlap(variants, reference, ["SNPID"]), overlap(variants, reference, ["CHR", "POS"])
    joined = places.alias("p").join(ids.select(KEY, F.struct("file_keys", "target_keys", "shared", "file_pct").alias("i")), KEY, "left")
    use = F.coalesce((F.col("i.file_keys") > least) & (F.col("i.target_keys") > least), F.lit(False))
    return joined.select(KEY, F.when(use, "rsid").otherwise("chrpos").alias("method"), F.when(use, F.col("i.shared")).otherwise(F.col("shared")).alias("shared"), F.when(use, F.col("i.file_pct")).otherwise(F.col("file_pct")).alias("pct"))


def readiness(variants: DataFrame, target: DataFrame) -> DataFrame:
    """Per file: rows with what clumping and scoring need, and rows that are in
    the target too."""
    seen = target.select("SNPID").where("SNPID is not null").distinct().withColumn("_in", F.lit(True))
    v = variants.join(seen, "SNPID", "left")
    has_p, has_e, has_a = (F.col("P") > 0) & (F.col("P") <= 1), F.col("BETA").isNotNull(), F.col("EA").isNotNull()
    clump, score = F.col("SNPID").isNotNull() & has_p, F.col("SNPID").isNotNull() & has_e & has_a
    return v.groupBy(KEY).agg(F.count_if(F.col("SNPID").isNotNull()).alias("with_id"), F.count_if(has_p).alias("with_p"), F.count_if(clump).alias("clump_ready"), F.count_if(score).alias("score_ready"), F.count_if(clump & score & F.col("_in")).alias("full_ready"))


def loci(variants: DataFrame, window: int = 500_000, p: float = 0.001) -> DataFrame:
    """Leads: in order of P, a variant leads unless a lead of its chromosome is
    within the window. Order-dependent, so each file's chromosome, of which only
    rows under the threshold matter, goes to one function."""
    import pandas as pd

    def greedy(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["P", "row_id"])
        taken: list[int] = []
        keep = []
        for pos in df["POS"]:
            ok = all(abs(pos - t) > window for t in taken)
            keep.append(ok)
            if ok:
                taken.append(pos)
        return df[keep]

    rows = variants.where((F.col("P") < p) & F.col("POS").isNotNull()).select(KEY, "CHR", "POS", "P", "row_id")
    return rows.groupBy(KEY, "CHR").applyInPandas(greedy, rows.schema)


