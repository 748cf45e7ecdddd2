"""Readers of white-space tables: variants, samples, frequencies, associations,
clumps, profiles and covariates, from lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assocframe.functions import genomic as g, numeric as m
from assocframe.operators.harmonise import alias_first

BIM = ("CHR", "SNPID", "CM", "POS", "A1", "A2")
FAM = ("FID", "IID", "PAT", "MAT", "SEX", "PHENO")


def fields(lines: DataFrame, names: tuple[str, ...] | list[str], line: str = "value") -> DataFrame:
    f = F.split(F.trim(line), r"\s+")
    return lines.where(F.trim(line) != "").select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)])


def bim(lines: DataFrame) -> DataFrame:
    d = fields(lines, BIM)
    return d.select(g.normal_chr(F.col("CHR")).alias("CHR"), "SNPID", m.parse_number(F.col("CM")).alias("CM"), g.normal_pos(F.col("POS")).alias("POS"), g.normal_allele(F.col("A1")).alias("A1"), g.normal_allele(F.col("A2")).alias("A2"))


def fam(lines: DataFrame, missing: tuple[float, ...] = (-9.0, 0.0)) -> DataFrame:
    d = fields(lines, FAM)
    x = m.parse_number(F.col("PHENO"))
    return d.select("FID", "IID", F.col("SEX").try_cast("int").alias("SEX"), F.when(~x.isin(*missing), x).alias("PHENO"))


def with_header(lines: DataFrame, names: list[str]) -> DataFrame:
    """Rows under a header line: what doesn't repeat the header."""
    return fields(lines, names).where(F.col(names[0]) != names[0])


def frq(lines: DataFrame) -> DataFrame:
    d = with_header(lines, ["CHR", "SNPID", "A1", "A2", "MAF", "NCHROBS"])
    return d.select(g.normal_chr(F.col("CHR")).alias("CHR"), "SNPID", "A1", "A2", m.parse_number(F.col("MAF")).alias("MAF"), F.col("NCHROBS").try_cast("long").alias("NCHROBS"), g.sorted_pair(F.col("A1"), F.col("A2")).alias("pair"))


def assoc(raw: DataFrame, target: DataFrame) -> DataFrame:
    """SNPID, BETA (of OR its logarithm) and P, with alleles and place of the
    target where the file has none."""
    pick = lambda names: F.col(c) if (c := alias_first(raw, names)) else F.lit(None)
    odds, beta = m.parse_number(pick(["OR"])), m.parse_number(pick(["BETA", "B"]))
    d = raw.select(pick(["SNP", "SNPID", "ID"]).cast("string").alias("SNPID"), F.coalesce(beta, F.when(odds > 0, F.log(odds))).alias("BETA"), m.parse_number(pick(["P", "PVAL"])).alias("P"), pick(["A1"]).cast("string").alias("_a1"), pick(["A2"]).cast("string").alias("_a2"))
    t = target.select("SNPID", "CHR", "POS", F.col("A1").alias("t1"), F.col("A2").alias("t2"))
    other = F.when(F.col("_a1") == F.col("t1"), F.col("t2")).when(F.col("_a1") == F.col("t2"), F.col("t1"))
    return d.join(t, "SNPID", "left").select("SNPID", "CHR", "POS", F.coalesce("_a1", "t1").alias("A1"), F.coalesce(F.col("_a2"), other, F.col("t2")).alias("A2"), "BETA", "P")


def clumped(rows: DataFrame, members: str = "SP2") -> DataFrame:
    """Clumps with the number of their members; NONE has none."""
    listed = F.filter(F.split(members, ","), lambda x: (F.trim(x) != "") & (F.upper(F.trim(x)) != "NONE"))
    return rows.where(F.col("CHR").cast("string").rlike("^[0-9XYMT]+$")).withColumn("members", F.size(listed))


def clump_summary(rows: DataFrame) -> DataFrame:
    c = clumped(rows)
    return c.agg(F.count(F.lit(1)).alias("clumps"), F.min("P").alias("min_p"), F.percentile("P", 0.5).alias("median_p"), F.sum("members").alias("members"), F.max("members").alias("largest"))


def profile_scores(df: DataFrame) -> DataFrame:
    """FID, IID and a score: a known name, or else the last column."""
    name = alias_first(df, ["SCORE", "SCORESUM", "PRS"]) or df.columns[-1]
    return df.select("FID", "IID", F.col(name).cast("double").alias("score"))


def all_scores(df: DataFrame) -> DataFrame:
    """Wide Pt_* columns as (FID, IID, pvalue, score)."""
    cols = [c for c in df.columns if c.startswith("Pt_")]
    return df.unpivot(["FID", "IID"], [F.col(f"`{c}`") for c in cols], "label", "score").withColumn("pvalue", threshold_of(F.col("label")))


def threshold_of(label: Column) -> Column:
    return F.when(label.startswith("Pt_"), F.substring(label, F.lit(4), F.length(label)).try_cast("double"))


def numeric_columns(df: DataFrame, keys: tuple[str, ...] = ("FID", "IID")) -> DataFrame:
    """Keys and the columns that have a number at all: one pass over all."""
    rest = [c for c in df.columns if c not in keys]
    found = df.agg(*[F.count(m.parse_number(F.col(c))).alias(c) for c in rest]).first()
    return df.select(*keys, *[m.parse_number(F.col(c)).alias(c) for c in rest if found[c]])


def vcf_places(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    return lines.where(~F.col("value").startswith("#")).select(g.normal_chr(F.get(f, F.lit(0))).alias("CHR"), g.normal_pos(F.get(f, F.lit(1))).alias("POS"), g.normal_rsid(F.get(f, F.lit(2))).alias("SNPID"))


def text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
