"""The prefix trie of conversations, with count-min screening.

A node is a distinct sequence of first turns; conversations that start with it are
its members. Shared nodes say what a cache of prefixes saves.

1. Each turn becomes a digest of role and text and a number of words; each
   conversation a row with the chained digests of all its prefixes. Texts go no
   further.
2. A count-min sketch takes all prefix digests. It never counts too few, so a
   prefix whose estimate is one belongs to one conversation, and so do all longer
   ones. These tails are written as nodes where they are, without a shuffle.
3. Only prefixes before the first that is proved so are grouped by digest, exactly:
   those that the sketch took for shared by mistake come out as nodes of one member.

Sums over subtrees need no walk by depth. A conversation owns the nodes whose
smallest member it is: owned nodes are the last ones of its path. So a node's sum
over its subtree's distinct nodes is a sum over its members of what they own below
it, one grouping; leaves and children are counted the same way.

The sketch has about four cells for each prefix in each of HASHES rows, MAX_CELLS at
most (a bit each, 24 MB together); with more than a quarter of that many prefixes it
proves fewer singletons, e.g. 50 % of them at 1.6 * MAX_CELLS prefixes and 5 % at 4,
and more of the narrow rows of step 3 shuffle; results are the same.

Groups by digest are reduced before they shuffle, so the root and a first turn of a
third of all conversations are no hot keys there; the join that tells members of a
node its smallest one is left to adaptive splitting. A node's list of ends is joined
within ranges of 65,536 ids and hashed as a stream. One conversation's digests (40
bytes a turn) must fit a task.

Nulls: null roles and texts are empty; a null turn comes first; rows without conv_id
belong to no conversation and are left out. Rows with equal turns are ordered by their digest, and
repeated rows are turns of their own. Empty texts have no words. Very long texts are
read whole. An empty table has no nodes, not even a root. Only four columns are read,
so others don't clash. Prefixes are compared by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from assocframe.llm.mixing import word_count
from assocframe.runtime import materialise, release

HASHES = 3
MIN_CELLS, MAX_CELLS = 1 << 12, 1 << 26
#: Cells of the sketch that one task merges.
CHUNK = 1 << 16
#: Prefixes that a task counts before it hands them on.
FLUSH = 1 << 20
#: Ids of one string.
RANGE = 1 << 16
_SIZE = 16
_ROOT = b""
_CHAINED = "conv_id long, n_turns long, total long, digests binary, words binary"
_SCREENED = "conv_id long, n_turns long, total long, k long, head long, digests binary, words binary"
_SHARED = "conv_id long, n_turns long, total long, k long, head long, depth long, digest binary, before long"


def turn_digests(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words) of rows (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    digest = F.unhex(F.substring(F.sha2(told, 256), 1, 2 * _SIZE))
    return rows.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), word_count("text").alias("words"))


def chained(turns: DataFrame) -> DataFrame:
    """One row for each conversation: the digests of its prefixes and the words of
    its turns. A row without a digest is no turn, but makes its conversation exist."""
    held = F.collect_list(F.when(F.col("digest").isNotNull(), F.struct(F.col("turn").isNotNull().alias("known"), "turn", "digest", "words")))
    rows = turns.groupBy("conv_id").agg(F.sort_array(held).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("turns")
            flat, at = lists.flatten(), np.append(0, np.cumsum(np.asarray(lists.value_lengths()))).tolist()
            digests, words = flat.field("digest").to_pylist(), np.asarray(flat.field("words")).astype(np.int64)
            chain = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                last, out = _ROOT, []
                for d in digests[a:b]:
                    last = hashlib.blake2b(last + d, digest_size=_SIZE).digest()
                    out.append(last)
                chain.append(b"".join(out))
            spans = list(zip(at[:-1], at[1:], strict=True))
            cols = [np.diff(at), np.array([words[a:b].sum() for a, b in spans], np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *map(pa.array, cols), pa.array(chain, pa.binary()), pa.array([words[a:b].tobytes() for a, b in spans], pa.binary())], names=["conv_id", "n_turns", "total", "digests", "words"])

    return rows.mapInArrow(run, _CHAINED)


def cells_of(digests: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each digest in each row of the sketch."""
    a, b = digests.view(np.uint64).reshape(-1, 2).T
    return [((a + np.uint64(r) * (b | np.uint64(1))) & np.uint64(cells - 1)).astype(np.int64) for r in range(HASHES)]


def _digests(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The digests of all prefixes of a batch, flat as bytes, and the numbers of
    each conversation."""
    return np.frombuffer(b"".join(batch.column("digests").to_pylist()), np.uint8), np.asarray(batch.column("n_turns")).astype(np.int64)


def sketch(chains: DataFrame, cells: int) -> list[np.ndarray]:
    """For each row the bits of cells that count two or more: all that a proof of
    a singleton asks of a count-min sketch."""

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for r, cell in enumerate(cells_of(np.concatenate(held), cells)):
            cell, count = np.unique(cell, return_counts=True)
            cut = np.flatnonzero(np.append(True, np.diff(cell // CHUNK) > 0)).tolist()
            spans = list(zip(cut, [*cut[1:], len(cell)], strict=True))
            at = [(cell[a:b] % CHUNK).astype(np.uint16).tobytes() for a, b in spans]
            many = [np.packbits(count[a:b] > 1).tobytes() for a, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array([r * (MAX_CELLS // CHUNK) + int(cell[a]) // CHUNK for a in cut]), pa.array(at, pa.binary()), pa.array(many, pa.binary())], names=["chunk", "at", "many"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(_digests(batch)[0])
            size += len(held[-1]) // _SIZE
            if size >= FLUSH:
                yield from counted(held)
                held, size = [], 0
        if size:
            yield from counted(held)

    def merge(t: pa.Table) -> pa.Table:
        n = np.zeros(CHUNK, np.int64)
        for at, many in zip(t.column("at"), t.column("many"), strict=True):
            at = np.frombuffer(at.as_buffer(), np.uint16)
            n[at] += 1 + np.unpackbits(np.frombuffer(many.as_buffer(), np.uint8), count=len(at))
        return pa.table([t.column("chunk").slice(0, 1), pa.array([np.packbits(n > 1).tobytes()], pa.binary())], names=["chunk", "bits"])

    parts = chains.select("n_turns", "digests").mapInArrow(count, "chunk long, at binary, many binary")
    found = parts.groupBy("chunk").applyInArrow(merge, "chunk long, bits binary").collect()  # 3 MAX_CELLS bits at most
    out = [np.zeros(max(cells, CHUNK) // 8, np.uint8) for _ in range(HASHES)]
    for r in found:
        row, chunk = divmod(r.chunk, MAX_CELLS // CHUNK)
        out[row][chunk * CHUNK // 8 : (chunk + 1) * CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def screened(chains: DataFrame, bits: list[np.ndarray], cells: int) -> DataFrame:
    """Each conversation with k, the number of its prefixes before the first that is
    proved to be its own, their digests only, and the words of their turns (head)."""
    known = chains.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, n = _digests(batch)
            maybe = np.ones(len(digests) // _SIZE, bool)
            for row, cell in zip(known.value, cells_of(digests, cells), strict=True):
                maybe &= (row[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
            first = np.append(0, np.cumsum(n))
            none = np.append(np.flatnonzero(~maybe), len(maybe))  # the next one that is proved
            k = np.minimum(none[np.searchsorted(none, first[:-1])], first[1:]) - first[:-1]
            words = [np.frombuffer(v.as_buffer(), np.int64)[:x] for v, x in zip(batch.column("words"), k.tolist(), strict=True)]
            cols = [pa.array(k), pa.array(np.array([w.sum() for w in words], np.int64))]
            heads = pa.array([v.as_py()[: _SIZE * x] for v, x in zip(batch.column("digests"), k.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "n_turns", "total")), *cols, heads, pa.array([w.tobytes() for w in words], pa.binary())], names=["conv_id", "n_turns", "total", "k", "head", "digests", "words"])

    return chains.mapInArrow(run, _SCREENED)


def _maybe_shared(screen: DataFrame) -> DataFrame:
    """A row for each prefix that isn't proved to be one conversation's: its digest,
    depth, and the words of the turns before its last (before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.asarray(batch.column("k")).astype(np.int64)
            row = pa.array(np.repeat(np.arange(len(k)), k))
            words = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("words")]
            before = np.concatenate([np.zeros(0, np.int64), *[np.cumsum(w) - w for w in words]])
            depth = np.concatenate([np.zeros(0, np.int64), *[np.arange(1, x + 1) for x in k.tolist()]])
            flat = b"".join(batch.column("digests").to_pylist())
            digest = pa.array([flat[i : i + _SIZE] for i in range(0, len(flat), _SIZE)], pa.binary())
            same = [batch.column(c).take(row) for c in ("conv_id", "n_turns", "total", "k", "head")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(depth), digest, pa.array(before)], names=["conv_id", "n_turns", "total", "k", "head", "depth", "digest", "before"])

    return screen.where("k > 0").mapInArrow(run, _SHARED)


def _ends(members: DataFrame) -> DataFrame:
    """(digest, ends_sha256) from (digest, conv_id): the hash of the ids, in order and
    joined by commas. Strings hold RANGE ids at most; a node's are hashed in turn."""
    block = F.floor(F.col("conv_id") / F.lit(RANGE)).alias("block")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    texts = members.groupBy("digest", block).agg(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for d, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if d == last:
                    state.update(b"," + ids.encode())
                else:
                    if state is not None:
                        done.append((last, state.hexdigest()))
                    last, state = d, hashlib.sha256(ids.encode())
            yield _pairs(done)
        if state is not None:
            yield _pairs([(last, state.hexdigest())])

    return texts.repartition("digest").sortWithinPartitions("digest", "block").select("digest", "ids").mapInArrow(run, "digest binary, ends_sha256 string")


def _pairs(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["digest", "ends_sha256"])


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of turns (conv_id, turn, digest, words), as turn_digests() has them:
    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256). A node is named by its smallest member and its depth."""
    chains = materialise(chained(turns), "chains")
    total = chains.agg(F.sum("n_turns")).first()[0] or 0
    cells = min(max(1 << (4 * total).bit_length(), MIN_CELLS), MAX_CELLS)
    screen = materialise(screened(chains, sketch(chains, cells), cells), "screened")
    release(chains)
    rows = _maybe_shared(screen)
    ends = F.col("depth") == F.col("n_turns")
    nodes = rows.groupBy("digest").agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n_convs"), F.sum(ends.cast("long")).alias("n_ends"))
    conv = Window.partitionBy("conv_id")
    mine = F.col("first") == F.col("conv_id")
    met = rows.join(nodes, "digest").select(
        "*",
        F.lag("first").over(conv.orderBy("depth")).alias("above"),
        F.min(F.when(mine, F.struct("depth", "before"))).over(conv).alias("own"),
        F.max(F.when(ends, mine & (F.col("n_ends") == F.col("n_convs")))).over(conv).alias("last_is_leaf"),
    )
    tailed = F.col("k") < F.col("n_turns")
    # the first depth that the conversation owns, the words of what it owns, and whether a leaf is among it
    met = met.select(
        *rows.columns,
        "first",
        "above",
        F.coalesce(F.col("own.depth"), F.col("k") + 1).alias("owns"),
        F.coalesce(F.col("total") - F.col("own.before"), F.when(tailed, F.col("total") - F.col("head")), F.lit(0)).alias("owned"),
        (tailed | F.coalesce("last_is_leaf", F.lit(False))).cast("long").alias("leaf"),
    )
    met = materialise(met, "met")
    below = F.col("total") - F.col("before")
    child = ((F.col("n_turns") > F.col("depth")) & (F.col("owns") <= F.col("depth") + 1)).cast("long")
    shared = met.groupBy("digest", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        F.min("above").alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(child).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        (F.sum(below) - F.sum(F.least(below, F.col("owned")))).alias("saved_tokens"),
    )
    alone = F.col("k") == 0
    turned = (alone & (F.col("n_turns") > 0)).cast("long")
    whole = screen.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(turned).alias("a"), F.sum(F.when(alone, 0).otherwise(F.col("total"))).alias("t"))
    firsts = met.where("depth = 1").agg(F.coalesce(F.sum((F.col("owns") <= 1).cast("long")), F.lit(0)).alias("b"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("l"), F.coalesce(F.sum("owned"), F.lit(0)).alias("o"))
    children = F.col("a") + F.col("b")
    root = whole.crossJoin(firsts).where("n_convs > 0").select(  # one row and one row
        F.lit(_ROOT).alias("digest"),
        F.lit(0).cast("long").alias("depth"),
        "conv_id",
        F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs",
        children.alias("n_children"),
        F.when(children == 0, 1).otherwise(F.col("a") + F.col("l")).cast("long").alias("n_leaves"),
        (F.col("t") - F.col("o")).alias("saved_tokens"),
    )
    root = materialise(root, "root")
    least = F.broadcast(root.select(F.col("conv_id").alias("least")))  # one row
    shared = shared.crossJoin(least).withColumn("parent_conv_id", F.coalesce("parent_conv_id", "least")).drop("least")
    ended = met.where(ends).select("digest", "conv_id").unionByName(screen.where("n_turns = 0").select(F.lit(_ROOT).alias("digest"), "conv_id"))
    none, one = F.lit(hashlib.sha256(b"").hexdigest()), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    grouped = shared.unionByName(root).join(_ends(ended), "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)).drop("digest")

    def tail(df: DataFrame, depth, parent) -> DataFrame:
        last = F.col("depth") == F.col("n_turns")
        out = df.withColumn("parent_conv_id", parent).withColumn("depth", depth)
        return out.select("depth", "conv_id", "parent_conv_id", F.lit(1).cast("long").alias("n_convs"), (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, one).otherwise(none).alias("ends_sha256"))

    after = tail(met.where(tailed & (F.col("depth") == F.col("k"))), F.col("k") + 1, F.col("first"))
    at_root = tail(screen.where(alone & (F.col("n_turns") > 0)).crossJoin(least), F.lit(1).cast("long"), F.col("least"))
    longer = tail(screen.where(F.col("n_turns") > F.col("k") + 1), F.explode(F.sequence(F.col("k") + 2, F.col("n_turns"))), F.col("conv_id"))
    return grouped.unionByName(after).unionByName(at_root).unionByName(longer)


#: The trie by paths of digests; a subtree is what starts with a node's path. The checksum of an id's digits is a fold over their bits.
ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS n, d, w FROM (
    SELECT conv_id, turn, substring(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS d, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
    FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
  SELECT v.c, t.n, t.d, t.w FROM convs v JOIN turns t ON t.c = v.base AND t.n <= v.h
  UNION ALL SELECT t.c, t.n, t.d, t.w FROM turns t JOIN convs v ON v.c = t.c WHERE t.n > v.h
), seqs AS (
  SELECT v.c, coalesce(list(d ORDER BY n) FILTER (WHERE d IS NOT NULL), []) AS ds, list(w ORDER BY n) FILTER (WHERE d IS NOT NULL) AS ws FROM convs v LEFT JOIN rebuilt USING (c) GROUP BY v.c
), prefixes AS (
  SELECT c, len(ds) AS size, p AS depth, CASE WHEN p > 0 THEN array_to_string(ds[1:p], '/') || '/' ELSE '' END AS path, CASE WHEN p > 1 THEN array_to_string(ds[1:p - 1], '/') || '/' ELSE '' END AS above, CASE WHEN p > 0 THEN ws[p] ELSE 0 END AS w
  FROM (SELECT c, ds, ws, unnest(range(0, len(ds) + 1)) AS p FROM seqs)
), nodes AS (
  SELECT path, depth, any_value(above) AS above, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE size = depth), '') AS ends FROM prefixes GROUP BY path, depth
), children AS (
  SELECT above AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above
), counted AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)
), below AS (
  SELECT n.path, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, sum(u.saved) AS saved_tokens FROM counted n JOIN counted u ON starts_with(u.path, n.path) GROUP BY n.path
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM counted n JOIN below b USING (path) LEFT JOIN counted p ON n.depth > 0 AND p.path = n.above
"""
