"""From per-file features to a model's table: merges, screening, leakage audits
and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from assocframe.runtime import sized_join

#: Parts of names that give a feature away as derived from the target (fixed values).
LEAKY = ("prs", "auc", "r2", "gap", "target", "performance", "train_", "test_", "best_model", "null_model", "f1")


def merge_features(base: DataFrame, groups: dict[str, DataFrame], key: str = "job_index") -> DataFrame:
    """base with each group's columns, prefixed, and a status per group. A
    group's first row per key counts; a file's row that is missing keeps nulls."""
    out = base
    for name, df in groups.items():
        one = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in df.columns if c != key]))).where("_r = 1").drop("_r")
        named = one.select(key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key], F.lit("present").alias(f"{name}_status"))
        out = sized_join(out, named, [key], "left").withColumn(f"{name}_status", F.coalesce(f"{name}_status", F.lit("missing_job_row")))
    return out


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join, after a check that keys are unique on both sides."""
    for side, df in (("left", left), ("right", right)):
        if df.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"keys {keys} repeat on the {side}")
    return left.join(right, keys)


def screen(df: DataFrame, features: list[str], least: int = 10, missing: float = 0.5, unique: int = 2) -> DataFrame:
    """Per feature: counts, and whether it is kept or why not."""
    long = df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], features, "feature", "value")
    out = long.groupBy("feature").agg(F.count("value").alias("present"), F.count(F.lit(1)).alias("rows"), F.count_distinct("value").alias("distinct"))
    share = 1 - F.col("present") / F.col("rows")
    why = F.when(F.col("present") < least, "too_few_values").when(share > missing, "too_many_missing").when(F.col("distinct") < unique, "constant").otherwise("kept")
    return out.withColumn("missing_share", share).withColumn("decision", why)


def leakage(features: DataFrame, name: str = "feature") -> DataFrame:
    """Features whose name holds a leaky part."""
    hits = F.filter(F.array(*[F.lit(x) for x in LEAKY]), lambda x: F.contains(F.lower(F.col(name)), x))
    return features.withColumn("leaky", F.size(hits) > 0).withColumn("why", F.array_join(hits, ","))


def audit(features: DataFrame, name: str = "feature") -> DataFrame:
    """features, after a check that none is leaky."""
    bad = leakage(features, name).where("leaky").limit(20).collect()
    if bad:
        raise ValueError("leaky features: " + ", ".join(r[name] for r in bad))
    return features


def targets(df: DataFrame, train: str = "train", test: str = "test") -> DataFrame:
    gap = F.abs(F.col(train) - F.col(test))
    return df.withColumns({"gap_quality": -gap, "stability": F.col(test) - gap, "both": F.col(train) + F.col(test)})


def unique_schema(df: DataFrame) -> DataFrame:
    """Per column: values that aren't blank, distinct ones, the mode and its count."""
    cols = df.columns
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value").where("value is not null and trim(value) != ''")
    counts = long.groupBy("column", "value").count()
    top = counts.groupBy("column").agg(F.sum("count").alias("present"), F.count(F.lit(1)).alias("distinct"), F.min(F.struct((-F.col("count")).alias("n"), "value")).alias("t"))
    return top.select("column", "present", "distinct", F.col("t.value").alias("mode"), (-F.col("t.n")).alias("mode_count"))


def constant_columns(df: DataFrame) -> DataFrame:
    made = df.agg(*[F.count_distinct(c).alias(c) for c in df.columns])
    return made.unpivot([], made.columns, "column", "distinct").withColumn("constant", F.col("distinct") <= 1)


def duplicate_columns(df: DataFrame, key: str) -> DataFrame:
    """Groups of columns with the same content: an order-free sum of hashes of
    (key, value), so that no column is collected."""
    cols = [c for c in df.columns if c != key]
    long = df.select(F.col(key).alias("_k"), *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(["_k"], cols, "column", "value")
    prints = long.groupBy("column").agg(F.bit_xor(F.xxhash64("_k", "value")).alias("a"), F.bit_xor(F.xxhash64("value", "_k", F.lit(1))).alias("b"))
    return prints.groupBy("a", "b").agg(F.sort_array(F.collect_list("column")).alias("columns")).where(F.size("columns") > 1).select(F.array_join("columns", ",").alias("columns"))


def families(names: DataFrame, column: str = "column") -> DataFrame:
    """Counts of columns by the part of their name before the first underscore."""
    return names.groupBy(F.substring_index(column, "_", 1).alias("family")).agg(F.count(F.lit(1)).alias("columns"))


def in_every(rows: DataFrame, key: list[str], part: str) -> DataFrame:
    """Keys that every value of `part` has: the intersection of the parts' keys, by
    counts rather than by a join for each part."""
    parts = rows.agg(F.count_distinct(part).alias("_parts"))  # one row
    seen = rows.groupBy(*key).agg(F.count_distinct(part).alias("_seen"))
    return seen.join(F.broadcast(parts), F.col("_seen") == F.col("_parts")).select(*key)


def weights(rows: DataFrame, feature: str, weight: str) -> DataFrame:
    """Per feature of fitted weights: number, mean, mean size, deviation, and the
    share of the commoner sign."""
    w = F.col(weight)
    same = 100.0 * F.greatest(F.count_if(w > 0), F.count_if(w < 0)) / F.count(w)
    return rows.groupBy(feature).agg(F.count(w).alias("n"), F.avg(w).alias("mean"), F.avg(F.abs(w)).alias("mean_abs"), F.stddev_samp(w).alias("sd"), same.alias("same_sign_pct"))


def completeness(rows: DataFrame, key: list[str], columns: tuple[str, ...]) -> DataFrame:
    """(key, column_name, known, complete_pct) for each column; one that rows don't have
    is empty."""
    have = [F.count(c) if c in rows.columns else F.lit(0).cast("long") for c in columns]
    wide = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"), *[k.alias(f"_{c}") for c, k in zip(columns, have, strict=True)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{c}").alias("known")) for c in columns]))
    return wide.select(*key, "_rows", pairs.alias("_p")).select(*key, "_p.column_name", "_p.known", (100.0 * F.col("_p.known") / F.col("_rows")).alias("complete_pct"))


def head(rows: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key; tasks keep n of each before they shuffle."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
