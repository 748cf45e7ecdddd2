"""From documents to token ids: quality rules, exact dedup, near-duplicate
join, mixing and encoding. Each stage's rows are written as Parquet in the
shared folder and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assocframe.llm import bpe, exact_dedup, mixing, ngram_join, quality_rules
from assocframe.llm.queries import vocabulary_path
from assocframe.runtime import BROADCAST_ROWS, has_rows, materialise, release, ship, sized_join


def packed(docs: DataFrame) -> DataFrame:
    """docs with all columns in one, so that none clashes with an operator's."""
    return docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "lang", "source")


_read: list[DataFrame] = []


def over() -> None:
    """Delete the tables that the stage before has read: its rows are written by
    the time that the next one begins."""
    release(*_read)
    _read.clear()


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and are no outliers of their group."""
    over()
    counted = quality_rules.counted(packed(docs), carry=["_row"])
    _read.append(counted)
    return quality_rules.judge(counted, quality_rules.fit(counted)).where("kept").select("_row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    over()
    return exact_dedup.keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five words, 0.8), the one with the smallest doc_id. Rows
    that share a doc_id are judged each by its own text."""
    ship(spark)
    again = materialise(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "again")
    if has_rows(again):
        return _near_rows(docs, again)
    found = ngram_join.jaccard_components(docs, n=5, threshold=80)
    gone = materialise(found.where("doc_id != component_id").select("doc_id").distinct(), "gone")
    return sized_join(docs, gone, ["doc_id"], "left_anti", most=5 * BROADCAST_ROWS)


def _near_rows(docs: DataFrame, again: DataFrame) -> DataFrame:
    """near() where the ids in `again` are of several rows: these get an id from
    doc_id and text, below all others, and a component keeps its row of the smallest
    doc_id (of several such the one with the smallest of these ids)."""
    low = F.xxhash64("doc_id", "text").bitwiseOR(F.lit(-(1 << 63)))
    named = sized_join(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text"), again.withColumn("_again", F.lit(True)), ["doc_id"], "left", ["text"])
    rows = materialise(named.select("_row", F.col("doc_id").alias("_id"), F.when(F.col("_again"), low).otherwise(F.col("doc_id")).alias("doc_id"), "text"), "named")
    found = materialise(ngram_join.jaccard_components(rows.select("doc_id", "text"), n=5, threshold=80).where("doc_id is not null").distinct(), "found")
    own = rows.select("doc_id", "_id").where("doc_id is not null").distinct()
    first = found.join(own, "doc_id").groupBy("component_id").agg(F.min(F.struct("_id", "doc_id"))["doc_id"].alias("_stays"))
    gone = materialise(found.join(first, "component_id").where("doc_id != _stays").select("doc_id"), "gone")
    return sized_join(rows, gone, ["doc_id"], "left_anti", most=5 * BROADCAST_ROWS).select("_row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    found = mixing.mix(packed(docs), carry=["_row"]).where("copies > 0")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, with counts and digests of them and of the text that
    they give."""
    ship(spark)
    return bpe.digests(docs, vocabulary_path(), ids="ids")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mixed), ("BPE", encoded)]

#: SQL has no form of the estimates, the sketches and the merges; tests hold run() against a brute-force version.
ORACLE_SQL = None


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded corpus: what the last stage returns, a table in the shared
    folder."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            release(last)
        last = docs
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: counts and digests of the encoded corpus."""
    return corpus(spark, sf_dir).drop("ids")
