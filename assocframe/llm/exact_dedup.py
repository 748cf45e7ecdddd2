"""Exact dedup by progressive refinement.

Texts are equal when they are identical after A-Z have been lower-cased.
Rows are grouped by byte length; those of repeated lengths by a hash of a
prefix; and only rows whose length and prefix are repeated have their whole text
hashed (SHA-256). What is repeated is handed from one stage to the next as a
sieve: a bit for each hash of a repeated key, as a table of 64-bit words that
has a fixed bound (SIEVE_BITS) whatever the input, and so may be broadcast. A
key whose bit is set by another one only goes one stage further than it had to.
Texts are never shuffled. stages() counts the rows that reach each stage.

Of equal texts the row with the largest doc_id stays (a null doc_id is smaller
than any); of rows that also share it, one. Null counts as the empty text, and
empty texts are equal; a text of any length is hashed whole. An empty table
gives an empty result. dedup() reads doc_id and the text only and keep() packs
each row in one column, so names of other columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from assocframe.runtime import has_rows, materialise, release, sized_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX = 128
#: Bits of a sieve at most; a word of 64 of them is a row.
SIEVE_BITS = 1 << 24


def folded(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def _bits(keys: DataFrame, key: str) -> DataFrame:
    """(word, mask): a bit for each hash of the keys that occur twice or more."""
    at = F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS))
    twice = keys.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return twice.groupBy((at / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("mask"))


def _sifted(rows: DataFrame, bits: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a column that says whether the key's bit is set; false for null."""
    at = F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS))
    words = bits.select(F.col("word").alias("_word"), F.col("mask").alias("_mask"))
    out = rows.withColumn("_word", (at / 64).cast("int")).join(F.broadcast(words), "_word", "left")
    set_ = F.call_function("shiftright", F.coalesce("_mask", F.lit(0).cast("long")), (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return out.withColumn(name, F.col(key).isNotNull() & set_).drop("_word", "_mask")


@dataclass
class Sieve:
    """The repeated lengths of a table, and its repeated prefixes among them."""

    lengths: DataFrame
    prefixes: DataFrame

    def release(self) -> None:
        release(self.lengths, self.prefixes)


def _by_length(docs: DataFrame, text: str, lengths: DataFrame) -> DataFrame:
    """docs with _head, the hash of length and prefix of rows of repeated lengths."""
    rows = _sifted(docs.withColumn("_bytes", F.octet_length(_plain(text))), lengths, "_bytes", "_same_length")
    return rows.withColumn("_head", F.when(F.col("_same_length"), F.xxhash64("_bytes", folded(F.substring(_plain(text), 1, PREFIX)))))


def _plain(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def sieve(docs: DataFrame, text: str = "text") -> Sieve:
    lengths = materialise(_bits(docs.select(F.octet_length(_plain(text)).alias("_bytes")), "_bytes"), "lengths")
    heads = _by_length(docs.select(text), text, lengths).where("_same_length").select("_head")
    return Sieve(lengths, materialise(_bits(heads, "_head"), "prefixes"))


def survivors(docs: DataFrame, found: Sieve, text: str = "text") -> DataFrame:
    """docs and _print: the hash of the whole text for rows that get through the
    sieve, else null."""
    rows = _sifted(_by_length(docs, text, found.lengths), found.prefixes, "_head", "_same_head")
    return rows.withColumn("_print", F.when(F.col("_same_head"), digest(F.col(text)))).drop("_bytes", "_same_length", "_head", "_same_head")


def stages(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """How many rows there are, how many have their prefix hashed, and how many
    their whole text."""
    found = sieve(docs, text)
    rows = _sifted(_by_length(docs.select(text), text, found.lengths), found.prefixes, "_head", "_same_head")
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("_same_length").alias("prefix"), F.count_if("_same_head").alias("whole")).first().asDict()
    found.release()
    return counts


def _groups(scanned: DataFrame) -> DataFrame:
    """(_print, keep_id, group_size) of the groups of two rows or more."""
    groups = scanned.where("_print is not null").groupBy("_print").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return materialise(groups.where("group_size > 1"), "groups")


def _judged(scanned: DataFrame, groups: DataFrame, tie: Column | None = None) -> DataFrame:
    """scanned with keep_id, group_size and kept. Of rows that are equal and share
    the doc_id that stays, the first in the order of `tie` does."""
    joined = sized_join(scanned, groups, ["_print"], "left", ["doc_id"])
    alone = joined.where("group_size is null").withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long")).withColumn("kept", F.lit(True))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    others = joined.where(F.col("group_size").isNotNull() & ~stays).withColumn("kept", F.lit(False))
    first = F.row_number().over(Window.partitionBy("_print", "doc_id").orderBy(F.lit(0) if tie is None else tie)) == 1
    return alone.unionByName(others).unionByName(joined.where(F.col("group_size").isNotNull() & stays).withColumn("kept", first))


def dedup(docs: DataFrame, text: str = "text", columns: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size and kept of each row of docs, and the given
    columns, computed in the same scan."""
    made = columns or {}
    rows = docs.select("doc_id", F.col(text).alias("_text"), *[v.alias(f"_made_{k}") for k, v in made.items()])
    found = sieve(rows.select("_text"), "_text")
    scanned = materialise(survivors(rows, found, "_text").drop("_text"), "scanned")
    found.release()
    return _judged(scanned, _groups(scanned)).select("doc_id", "keep_id", "group_size", "kept", *[F.col(f"_made_{k}").alias(k) for k in made])


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that stay, with its columns. Texts are hashed once
    more rather than shuffled."""
    rows = docs.select("doc_id", F.col(text).alias("_text"), F.struct(*docs.columns).alias("_row"))
    found = sieve(rows.select("_text"), "_text")
    scanned = materialise(survivors(rows.select("doc_id", "_text"), found, "_text").drop("_text"), "scanned")
    groups = _groups(scanned)
    ties = has_rows(scanned.where("_print is not null").groupBy("_print", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    release(scanned)
    again = survivors(rows, found, "_text").drop("_text")
    if ties:
        out = _judged(again, groups, F.to_json("_row")).where("kept")
    else:
        out = sized_join(again, groups, ["_print"], "left", ["doc_id"]).where(F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return out.select("_row.*")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8."""
    return F.sha2(folded(text).cast("binary"), 256)


ORACLE_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept, text_sha256 FROM t
"""
