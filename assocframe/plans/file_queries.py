"""Queries over real files: each writes a table's rows as files of some kind with
Spark's writers and reads them by the library's sources; and logs, and saved models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from assocframe.operators import ml
from assocframe.plans.base import query
from assocframe.plans.views import view
from assocframe.runtime import shared_dir
from assocframe.sources import logs, poke, sniff

_COLUMNS = ("s_suppkey", "s_name", "s_nationkey")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _supplier(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/supplier.parquet").select(*[F.col(c).cast("string").alias(c) for c in _COLUMNS])


@query("scan_poker", "SELECT how, CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier, (VALUES ('plain'), ('gzip')) k(how)")
def scan_poker(spark, d):
    """The same rows as plain text and as gzip, read without their names' help."""
    at = _folder(spark, "poke")
    rows = _supplier(spark, d).select(F.concat_ws(";", *_COLUMNS).alias("value"))
    rows.write.text(f"{at}/plain")
    rows.write.option("compression", "gzip").text(f"{at}/packed")
    cells = F.split("line", ";")
    return poke.poke(spark, f"{at}/*/part-*").select("how", F.get(cells, F.lit(0)).alias("id"), F.get(cells, F.lit(1)).alias("name"))


@query("read_complete", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def read_complete(spark, d):
    at = _folder(spark, "complete")
    _supplier(spark, d).write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(at)
    return sniff.read_complete(spark, at, "\t")


@query("count_rows", "SELECT count(*) AS rows FROM lineitem")
def count_rows(spark, d):
    at = _folder(spark, "rows")
    spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").cast("string")).write.text(at)
    return spark.range(1).select(F.lit(sniff.count_rows(spark, at)).cast("long").alias("rows"))


@query("scan_lines_sample", "SELECT 's_suppkey,s_name,s_nationkey' AS line, 1 AS line_no")
def scan_lines_sample(spark, d):
    """The first line of each file of a table."""
    at = _folder(spark, "lines")
    _supplier(spark, d).repartition(3, "s_suppkey").write.option("header", True).csv(at)
    return sniff.sample_lines(spark, f"{at}/part-*", 1).select("line", F.col("line_no").cast("int").alias("line_no")).distinct()


@query("scan_csv", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey > 3")
def scan_csv(spark, d):
    """Delimiter from the first lines, then all rows."""
    at = _folder(spark, "csv")
    _supplier(spark, d).write.option("header", True).option("sep", "|").csv(at)
    found = sniff.delimiter(sniff.sample_lines(spark, f"{at}/part-*", 20), ["path"]).select("delimiter").distinct().collect()
    (name,) = (r.delimiter for r in found)
    return sniff.read_complete(spark, at, dict(sniff.DELIMITERS)[name]).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name").where("s_suppkey > 3")


@query("scan_pca", "SELECT CAST(c_nationkey AS VARCHAR) AS FID, CAST(c_custkey AS VARCHAR) AS IID, c_custkey / 7.0 AS PC1, -c_nationkey / 3.0 AS PC2 FROM customer")
def scan_pca(spark, d):
    """Components as a file of white space without a header."""
    at = _folder(spark, "eigenvec")
    c = spark.read.parquet(f"{d}/customer.parquet")
    c.select(F.concat_ws(" ", "c_nationkey", "c_custkey", F.col("c_custkey") / F.lit(7.0), -F.col("c_nationkey") / F.lit(3.0)).alias("value")).write.text(at)
    cells = F.split(F.trim("value"), r"\s+")
    found = spark.read.text(at).select(cells.alias("c"))
    return found.select(F.get("c", F.lit(0)).alias("FID"), F.get("c", F.lit(1)).alias("IID"), *[F.get("c", F.lit(i + 1)).cast("double").alias(f"PC{i}") for i in (1, 2)])


# logs

_LOG = "CAST(o_orderkey % 9 + 1 AS VARCHAR(9)) || '. vcf [guess] (score: 0.' || CAST(o_custkey % 100 + 10 AS VARCHAR(9)) || ') ' || CAST(o_orderkey % 5 + 1 AS VARCHAR(9)) || '. plink  (score: ' || CAST(o_custkey % 7 AS VARCHAR(9)) || '.5)'"


@query("log_formats", """WITH r AS (SELECT CAST(o_custkey % 20 AS INT) AS job, o_orderkey AS o, o_custkey AS c FROM orders),
 f AS (SELECT job, o % 9 + 1 AS rank, 'vcf' AS name, CAST('0.' || CAST(c % 100 + 10 AS VARCHAR) AS DOUBLE) AS score FROM r UNION ALL SELECT job, o % 5 + 1, 'plink', c % 7 + 0.5 FROM r)
 SELECT job, CAST(rank AS BIGINT) AS rank, name, score, count(*) AS n FROM f GROUP BY ALL""")
def log_formats(spark, d):
    """Guesses of formats in the logs of twenty jobs, two in each line."""
    at = _folder(spark, "logs")
    rows = spark.read.parquet(f"{d}/orders.parquet").selectExpr("CAST(o_custkey % 20 AS INT) AS job", f"{_LOG} AS value")
    rows.write.partitionBy("job").text(at)
    found = logs.inferred_formats(spark.read.text(at).select("job", "value"))
    return found.groupBy("job", "rank", "name", "score").agg(F.count(F.lit(1)).alias("n"))


@query("log_builds", """WITH r AS (SELECT CAST(c_nationkey AS INT) AS job, max(c_custkey) AS a, max(c_custkey * 7 % 5000) AS b FROM customer GROUP BY 1)
 SELECT job, a AS hg19, b AS hg38, round(least(a, b) / greatest(a, b, 1), 6) AS ratio, CASE WHEN a > b THEN 'hg19' WHEN b > a THEN 'hg38' END AS build FROM r""")
def log_builds(spark, d):
    """Which build the variants of each job fit, from counts with commas."""
    at = _folder(spark, "builds")
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").cast("int").alias("job"), F.col("c_custkey").alias("a"), (F.col("c_custkey") * 7 % 5000).alias("b"))
    told = F.concat(F.lit("Matching variants for hg19: num_hg19 = "), F.format_number("a", 0), F.lit("; Matching variants for hg38:num_hg38="), F.format_number("b", 0))
    c.select("job", told.alias("value")).write.partitionBy("job").text(at)
    return logs.build_matches(spark.read.text(at).select("job", "value"), ["job"])


@query("model_dump")
def model_dump(spark, d):
    """Predictions of a model that was saved and loaded."""
    names, at = ["f_size", "f_rate"], _folder(spark, "model")
    f = view(spark, d, "features")
    ml.dump(ml.pipeline(names, "target").fit(f), at, names, "target", kind="ridge")
    model, _, label, _ = ml.load(at)
    return model.transform(f).select("job_index", label, F.col("prediction").alias("fitted"))
