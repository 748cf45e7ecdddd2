"""The study catalog: canonical columns, counts out of descriptions, filters and
ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from assocframe.functions import text as t

#: Catalog headers and the columns they become (fixed values).
COLUMNS = {
    "PUBMED ID": "pubmedId",
    "FIRST AUTHOR": "firstAuthor",
    "DISEASE/TRAIT": "reportedTrait",
    "MAPPED_TRAIT": "efoTraits",
    "INITIAL SAMPLE SIZE": "initialSampleDescription",
    "STUDY ACCESSION": "accessionId",
    "FULL SUMMARY STATISTICS": "fullSummaryStats",
    "SUMMARY STATS LOCATION": "summaryStatistics",
}


def canonical(raw: DataFrame) -> DataFrame:
    """raw by canonical names; what is missing is the empty text."""
    return raw.select(*[t.clean(F.col(f"`{k}`")).alias(v) if k in raw.columns else F.lit("").alias(v) for k, v in COLUMNS.items()])


def counted(df: DataFrame, description: str = "initialSampleDescription") -> DataFrame:
    """Cases, controls and samples; where both are known, samples are their sum."""
    c = F.col(description)
    cases, controls, people = t.count_before(c, "cases"), t.count_before(c, "controls"), t.count_before(c, "individuals|participants|samples|people")
    return df.withColumns({"cases": cases, "controls": controls, "samples": F.coalesce(cases + controls, people, cases, controls)})


def with_sumstats(df: DataFrame, column: str = "summaryStatistics") -> DataFrame:
    return df.where(~t.is_missing(F.col(column), t.NO_SUMSTATS))


def in_population(df: DataFrame, population: str, description: str = "initialSampleDescription") -> DataFrame:
    d = F.lower(F.col(description))
    return df.where(d.contains("european") | d.rlike(r"\beur\b") if population.lower() in ("european", "eur") else d.contains(population.lower()))


def matching(df: DataFrame, phrase: str, column: str, least: float = 50.0) -> DataFrame:
    """Studies whose trait is similar to a phrase; similarity `least` or more."""
    return df.withColumn("similarity", t.token_sort_ratio(F.col(column), phrase)).where(F.col("similarity") >= least)


def ranked(df: DataFrame) -> DataFrame:
    """Rank 1..n: larger cases, then samples, then accession; equal studies once."""
    w = Window.partitionBy(*[F.lower(F.trim(F.col(c))) for c in ("accessionId", "reportedTrait")]).orderBy(F.desc_nulls_last("cases"), F.desc_nulls_last("samples"))
    once = df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return once.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("cases"), F.desc_nulls_last("samples"), "accessionId")))
