"""Descriptions of columns as tables: value counts, quantiles, booleans, bands
and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assocframe.functions import numeric as m


def categorical(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    n = F.sum("count").over(Window.partitionBy(F.lit(0)))
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias("value")).count()
    return counts.select("value", F.col("count"), (100.0 * F.col("count") / n).alias("pct")).orderBy(F.desc("count"), "value").limit(top)


def numeric(df: DataFrame, columns: list[str], key: list[str] | None = None) -> DataFrame:
    x = F.col("value")
    long = df.select(*(key or []), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(key or [], columns, "metric", "value")
    q = F.percentile(x, F.array(*[F.lit(v) for v in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    out = long.groupBy(*(key or []), "metric").agg(F.count(x).alias("n"), m.rate(x.isNull()).alias("missing_pct"), F.min(x).alias("min"), q.alias("q"), F.avg(x).alias("mean"), F.max(x).alias("max"), F.stddev_samp(x).alias("sd"))
    return out.select(*(key or []), "metric", "n", "missing_pct", "min", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((5, 25, 50, 75, 95))], "mean", "max", "sd")


def boolean(df: DataFrame, column: str) -> DataFrame:
    t = F.lower(F.trim(F.col(column).cast("string")))
    kind = F.when(t.isin("true", "yes", "1"), "true").when(t.isin("false", "no", "0"), "false").when(t.isNull(), "missing").otherwise("other")
    return df.groupBy(kind.alias("value")).count()


def zero_nonzero(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column) == 0).alias("zero"), F.count_if(F.col(column) != 0).alias("nonzero"), F.count_if(F.col(column).isNull()).alias("missing"))


def bands(df: DataFrame, column: str, edges: list[float], key: list[str] | None = None) -> DataFrame:
    """Counts of rows between edges: each band holds its lower edge."""
    x = F.col(column)
    label: Column = F.when(x.isNull(), "missing").when(x < edges[0], f"< {edges[0]:g}")
    for a, b in zip(edges, edges[1:], strict=False):
        label = label.when((x >= a) & (x < b), f"{a:g} - {b:g}")
    return df.groupBy(*(key or []), label.otherwise(f">= {edges[-1]:g}").alias("band")).agg(F.count(F.lit(1)).alias("rows"))


def describe_auto(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column whether its values are boolean, numeric or text, decided by one
    pass over all of them."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    t = F.lower(F.trim(F.col("value")))
    kinds = long.groupBy("column").agg(F.count("value").alias("present"), F.coalesce(F.bool_and(t.isin("true", "false", "yes", "no", "0", "1")), F.lit(False)).alias("b"), (F.count(m.parse_number(F.col("value"))) == F.count("value")).alias("n"), F.count_distinct("value").alias("distinct"))
    return kinds.select("column", "present", "distinct", F.when(F.col("present") == 0, "empty").when(F.col("b"), "boolean").when(F.col("n"), "numeric").otherwise("categorical").alias("kind"))


def by_group(df: DataFrame, key: list[str], column: str) -> DataFrame:
    x = F.col(column)
    return df.groupBy(*key).agg(F.count(x).alias("n"), F.min(x).alias("min"), m.median(x).alias("median"), F.max(x).alias("max"))


def list_counts(df: DataFrame, column: str, separator: str, top: int = 20) -> DataFrame:
    """The most frequent items of a separated list."""
    items = df.select(F.explode(F.split(column, separator)).alias("item")).where("trim(item) != ''")
    return items.groupBy(F.trim("item").alias("item")).count().orderBy(F.desc("count"), "item").limit(top)


def completeness(have: DataFrame, expected: DataFrame, parts: list[str]) -> DataFrame:
    """Per phenotype: files with all parts, and those without some. have:
    (job_index, part); expected: (job_index, phenotype)."""
    flags = have.groupBy("job_index").pivot("part", parts).agg(F.count(F.lit(1)))
    full = expected.join(flags, "job_index", "left").withColumn("_ok", sum((F.coalesce((F.col(p) > 0).cast("int"), F.lit(0)) for p in parts[1:]), F.coalesce((F.col(parts[0]) > 0).cast("int"), F.lit(0))) == len(parts))
    return full.groupBy("phenotype").agg(F.count_if("_ok").alias("complete"), F.count_if(~F.col("_ok")).alias("incomplete"))
