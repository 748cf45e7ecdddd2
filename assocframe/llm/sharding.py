"""Sharding along a Hilbert curve.

Language, source and size of each document are quantised to 7 bits each, the
cell's index on the three-dimensional Hilbert curve is computed, and the rows,
in the order of the curve, are cut into runs: the shards. Rows that are near on
the curve are near in all three, so a shard's files have narrow ranges in each
and filters on any of them skip files.

Law `rows`: the runs' row counts are at most one apart. The cut needs each
row's place in the order, which comes from counts of cells, not from a global
sort: rows meet only with those of their own cell, and cells are spread by
doc_id so that many documents with the same metadata have many cells.

Nulls: a null language or source is a value of its own; a null text has one
byte (its end) and the checksum of the empty text. Equal rows keep rows of
their own. An empty table gives an empty result. Only DataFrame functions are
used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from assocframe.runtime import materialise, positions, sized_join, spread_of

SHARDS = 16
BITS, DIMS = 7, 3
#: Cells for the rows of one point of the curve.
CELLS = 64
#: Bits of the index that are a stretch of the curve; each has a count of its own.
_FINE = 9


def curve_tables(n: int = DIMS) -> tuple[list[int], list[int], list[int]]:
    """For each place w of a cube of n dimensions on the curve: its inverse Gray
    code, the corner where the curve enters the sub-cube, and the direction in
    which it leaves it."""
    gray = lambda w: w ^ (w >> 1)
    inverse = [0] * (1 << n)
    for w in range(1 << n):
        inverse[gray(w)] = w
    ones = lambda w: (~w & (w + 1)).bit_length() - 1  # noqa: E731  trailing set bits
    enter = [0 if w == 0 else gray(2 * ((w - 1) // 2)) for w in range(1 << n)]
    turn = [0 if w == 0 else (ones(w - 1) if w % 2 == 0 else ones(w)) % n for w in range(1 << n)]
    return inverse, enter, turn


def hilbert_index(coords: list[Column], bits: int = BITS) -> Column:
    """The index of a point with coordinates of `bits` bits on the Hilbert
    curve: one fold over the bits, from the highest, whose state is the
    orientation of the current cube."""
    n = len(coords)
    mask = (1 << n) - 1
    inverse, enter, turn = (F.array(*[F.lit(v) for v in t]) for t in curve_tables(n))
    point = F.struct(*[c.cast("int").alias(f"c{i}") for i, c in enumerate(coords)])
    shift = lambda x, k: F.call_function("shiftleft", x, k)
    down = lambda x, k: F.call_function("shiftright", x, k)
    left = lambda x, k: shift(x, k).bitwiseOR(down(x, n - k)).bitwiseAND(mask)
    right = lambda x, k: down(x, k).bitwiseOR(shift(x, n - k)).bitwiseAND(mask)

    def step(s: Column, b: Column) -> Column:
        corner = reduce(lambda a, v: a.bitwiseOR(v), [shift(down(s["p"][f"c{i}"], b).bitwiseAND(1), F.lit(i)) for i in range(n)])
        by = (s["d"] + 1) % n
        spot = F.when(by == 0, corner.bitwiseXOR(s["e"])).otherwise(right(corner.bitwiseXOR(s["e"]), by))
        w = inverse[spot]

        def moved(v: Column) -> Column:
            to = F.when(by == 0, enter[v]).otherwise(left(enter[v], by))
            return F.struct(s["p"].alias("p"), s["e"].bitwiseXOR(to).alias("e"), ((s["d"] + turn[v] + 1) % n).alias("d"), (s["h"] * (1 << n) + v).alias("h"))

        return F.transform(F.array(w), moved)[0]

    zero = F.struct(point.alias("p"), F.lit(0).alias("e"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)]), zero, step, lambda s: s["h"])


def size_code(size: Column) -> Column:
    """Quarter powers of two: the bit length, and the two bits after the first."""
    bits = F.length(F.bin(size)).cast("int")
    after = F.when(bits >= 3, F.call_function("shiftright", size, bits - 3).cast("int").bitwiseAND(3)).otherwise(0)
    return F.least(4 * (bits - 1) + after, F.lit((1 << BITS) - 1))


def value_codes(rows: DataFrame, column: str) -> DataFrame:
    """(_k_column, _c_column): the values' ranks, scaled to the grid."""
    values = rows.groupBy(F.col(column)).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col(column).asc_nulls_last())) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    code = F.when(total <= 1 << BITS, rank).otherwise(F.floor(rank * (1 << BITS) / total))
    return materialise(values.select(_tag(column).alias(f"_k_{column}"), code.cast("int").alias(f"_c_{column}")), f"codes-{column}")


def _tag(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("v"), F.col(column)), F.lit("null"))


def shard(docs: DataFrame, text: str = "text", shards: int = SHARDS, by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, law, shard and slot of each row."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = materialise(docs.select("doc_id", *by, (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32")), "sizes")
    coded = rows
    for column in by:
        coded = sized_join(coded.withColumn(f"_k_{column}", _tag(column)), value_codes(rows, column), [f"_k_{column}"], "inner", ["doc_id"])
    index = hilbert_index([F.col(f"_c_{by[0]}"), F.col(f"_c_{by[1]}"), size_code(F.col("size"))])
    placed = materialise(coded.select("doc_id", "size", "text_crc32", index.alias("hilbert")), "curve")
    cells = placed.withColumn("_stretch", F.floor(F.col("hilbert") / (1 << _FINE))).withColumn("_cell", spread_of("doc_id", salts=CELLS))
    # stretches are fewer than 2 ** (BITS * DIMS - _FINE), whatever the number of rows
    stretches = cells.groupBy("_stretch").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    offsets = materialise(stretches.select("_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.sum("_n").over(every).alias("_rows")), "stretches")
    ranked = positions(cells, ["_stretch"], ["hilbert", "_cell"], ["doc_id", "size", "text_crc32"])
    ranked = sized_join(ranked, offsets, ["_stretch"], "inner", ["doc_id"])
    place = F.col("_offset") + F.col("position") - 1
    found = ranked.select("doc_id", "size", "text_crc32", "hilbert", place.alias("_p"), "_rows").withColumn("shard", F.expr(f"int(_p * {shards} div _rows)"))
    first = F.expr(f"(bigint(shard) * _rows + {shards - 1}) div {shards}")
    return found.select("doc_id", "size", "text_crc32", "hilbert", F.lit("rows").alias("law"), "shard", (F.col("_p") - first).cast("long").alias("slot"))


def write(docs: DataFrame, path: str, text: str = "text", shards: int = SHARDS) -> None:
    """Write the documents of each shard, in the order of the curve, to a folder
    of its own (shard=...), for pruning by shard and by the files' ranges. Rows have
    docs' columns, the place on the curve (hilbert) and their slot; columns of docs
    with these names or `shard` are replaced. Rows are matched by doc_id (null is a
    value like others), size and checksum; those that agree in all three share the
    first of their places, none is lost."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = ["_null", "_id", "_size", "_crc"]
    own = F.col("doc_id")
    id_key = lambda: (own.isNull().alias("_null"), F.coalesce(own.cast("string"), F.lit("")).alias("_id"))
    placed = shard(docs, text, shards).select(*id_key(), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), F.struct("shard", "slot", "hilbert").alias("_at"))
    placed = placed.groupBy(*key).agg(F.min("_at").alias("_at"))
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in ("shard", "slot", "hilbert")]).alias("_row"), *id_key(), (F.octet_length(t) + 1).cast("long").alias("_size"), F.crc32(t.cast("binary")).alias("_crc"))
    out = rows.join(placed, key).select("_row.*", "_at.*")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
