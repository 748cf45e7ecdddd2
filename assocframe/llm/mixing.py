"""Mixing sources to target weights by systematic sampling.

targets() shares the total size among the sources by weight; none gets more
than `most` times its own size, and what is cut off goes to the others by
weight until none is above. mix() then gives each document of a source the same
expected number of copies, sums these in the source's order, adds one offset
per source and emits a copy for each integer that the sum crosses: the rows of
a source get the floor or the ceiling of their expected copies, in turn along
the order. Documents of like size are neighbours in the order, so the words
taken come near the target.

The running sum needs no sorted source: rows are numbered within cells of
(size bin, spread of doc_id) and a table of cell counts gives what precedes.

Nulls: a null source is a source of its own, after all others; a null text has
size 0. Rows that repeat are rows of their own. Documents of size 0 are copied
like others but take no words; a source without words has target 0 and none of
its rows is copied. Texts of any length are counted whole. An empty table gives
an empty result. Columns of `carry` whose names clash with the results' or with
the operator's own (_RESULTS) are left out; pack them in a struct to keep them.

Only DataFrame functions are used; reruns give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assocframe.runtime import materialise, positions, sized_join, spread_of

WEIGHTS = (5, 2, 1)
#: No document is taken more often, and no target is above so many times its source.
MOST = 3
#: Cells into which the rows of a source and a size bin are dealt.
CELLS = 64
_RESULTS = {"doc_id", "source", "size", "source_size", "target", "copies", "taken", "position", "_key", "_bin", "_cell", "_nth", "_before", "_rate", "_offset", "_salt"}


def word_count(text: str | Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ (null: 0), without keeping them."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string")
    ws = r"[\x20\x09-\x0D]"
    edges = t.rlike(f"^{ws}").cast("int") + t.rlike(rf"{ws}\z").cast("int")
    return F.when(t == "", 0).otherwise(F.greatest(F.size(F.split(t, f"{ws}+")) - edges, F.lit(0))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per
    source. Sources are ordered by most * size / weight; a run of them, from the
    first, is cut off, and the rest share what remains by weight: the cut is the
    first place where the next source's share is within its bound."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    w = sizes.withColumn("weight", weight).withColumn("bound", (most * F.col("source_size")).cast("long"))
    rank = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0))) / F.sum("weight").over(onward)
    w = w.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("bound"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("bound") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level"))))
    final = w.withColumn("final", first.over(every)["level"])
    return final.select("source", "source_size", F.when(F.col("final").isNull(), F.col("bound").cast("double")).otherwise(F.least(F.col("bound").cast("double"), F.col("final") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, text: str = "text", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 0, carry: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each row
    of docs (and the columns of `carry`)."""
    own = ["doc_id", "source"]
    more = [c for c in carry or [] if c not in _RESULTS]
    sized = docs.select(*own, word_count(text).alias("size"), *more)
    if not more:
        sized = materialise(sized, "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(totals, weights, most)
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    turn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key).cast("binary")), 1, 5), 16, 10).cast("long")
    aims = materialise(aims.withColumn("_key", key).withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("_offset", (turn + 0.5) / 1048576.0).drop("source"), "targets")
    bits = F.length(F.bin("size")).cast("int")
    cells = sized.withColumn("_key", key).withColumn("_bin", bits).withColumn("_cell", spread_of("doc_id", salts=CELLS))
    # rows that share size and doc_id come in the order of a hash of what can be hashed
    plain = [c for c, kind in docs.dtypes if c in more and "map<" not in kind and "variant" not in kind]
    placed = positions(cells, ["_key"], ["_bin", "_cell"], ["size", "doc_id", *([F.xxhash64(*plain)] if plain else [])])
    out = sized_join(placed, aims, ["_key"], "inner", ["doc_id"])
    upto = lambda k: F.floor(k * F.col("_rate") + F.col("_offset"))
    out = out.withColumn("copies", F.least(upto(F.col("position")) - upto(F.col("position") - 1), F.lit(most)).cast("long"))
    return out.select(*own, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *more)


ORACLE_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight, 3 * source_size AS bound FROM totals),
levels AS (SELECT *, row_number() OVER (ORDER BY bound / weight, source ASC NULLS LAST) AS place,
  CAST(CAST((SELECT sum(source_size) FROM totals) AS BIGINT) - CAST(coalesce(sum(bound) OVER (ORDER BY bound / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS DOUBLE)
  / sum(weight) OVER (ORDER BY bound / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
final AS (SELECT arg_min(level, place) AS level FROM levels WHERE level * weight <= bound),
aims AS (SELECT source, source_size, CASE WHEN (SELECT level FROM final) IS NULL THEN CAST(bound AS DOUBLE) ELSE least(CAST(bound AS DOUBLE), (SELECT level FROM final) * weight) END AS target,
  (CAST(('0x' || substr(md5('0|' || coalesce('s' || source, 'null')), 1, 5)) AS BIGINT) + 0.5) / 1048576.0 AS turn FROM levels),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)), CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 7)) AS BIGINT) % 64, size, doc_id) AS k FROM sized)
SELECT p.doc_id, p.size, a.source_size, a.target,
  CAST(least(floor(k * rate + turn) - floor((k - 1) * rate + turn), 3) AS BIGINT) * p.size AS taken
FROM placed p JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM aims) a ON p.source IS NOT DISTINCT FROM a.source
"""
