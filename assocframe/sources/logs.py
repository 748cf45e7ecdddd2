"""What programs say in their logs: patterns over whole files, several matches a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A guess of a file's format: its place, its name, a remark in brackets, its score (fixed form).
FORMATS = r"(\d+)\.\s+([^\s\[]+)(?:\s+\[[^\]]+\])?\s+\(score:\s*([\d.]+)\)"
#: How many variants fit a build (fixed form).
BUILDS = r"Matching variants for (hg19|hg38):\s*num_(?:hg19|hg38)\s*=\s*([\d,]+)"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): all lines of all logs, split among tasks."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def matches(logs: DataFrame, pattern: str, groups: dict[str, int], line: str = "value") -> DataFrame:
    """A row for each match of the pattern in each line: logs' other columns, and the
    groups by name. All matches of a line are read, and lines without one skipped."""
    found = F.arrays_zip(*[F.regexp_extract_all(line, F.lit(pattern), F.lit(i)).alias(name) for name, i in groups.items()])
    rest = [c for c in logs.columns if c != line]
    out = logs.where(F.col(line).rlike(pattern)).select(*rest, F.explode(found).alias("_m"))
    return out.select(*rest, *[F.col(f"_m.{name}").alias(name) for name in groups])


def whole(x: Column) -> Column:
    return F.regexp_replace(x, ",", "").try_cast("long")


def inferred_formats(logs: DataFrame) -> DataFrame:
    """(..., rank, name, score) of each format that a log names."""
    out = matches(logs, FORMATS, {"rank": 1, "name": 2, "score": 3})
    return out.withColumn("rank", whole(F.col("rank"))).withColumn("score", F.col("score").try_cast("double"))


def build_matches(logs: DataFrame, key: list[str]) -> DataFrame:
    """Per key the variants that fit each build (the most that the log names), their
    ratio (the lesser over the greater, 1 at least), and the build of more."""
    found = matches(logs, BUILDS, {"build": 1, "n": 2}).withColumn("n", whole(F.col("n")))
    of = lambda b: F.max(F.when(F.col("build") == b, F.col("n")))
    out = found.groupBy(*key).agg(of("hg19").alias("hg19"), of("hg38").alias("hg38"))
    a, b = F.col("hg19"), F.col("hg38")
    ratio = F.when(a.isNotNull() & b.isNotNull(), F.round(F.least(a, b) / F.greatest(a, b, F.lit(1)), 6))
    return out.withColumn("ratio", ratio).withColumn("build", F.when(a > b, "hg19").when(b > a, "hg38"))
