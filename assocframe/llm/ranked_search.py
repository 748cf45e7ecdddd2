"""Ranked lexical search by pipelined term partitioning.

Items (queries) are ranked against all documents by an integer form of BM25. A
term is a maximal run of letters, digits and characters beyond ASCII, with A-Z
lower-cased. With N documents that have terms, L terms in them, df documents that
have a term, n terms in a document, tf of them the term:

    w = floor(1000 ln((2N + 2) / (2 df + 1)))
    m = 100 - 50 + (50 n N) div L
    score = sum over the item's distinct terms of w ((10**9 tf) div (1000 tf + 20 m))

1. One pass over the documents finds the tf of the items' terms and each n, by
   chunks of rows (shards); of other terms nothing is kept.
2. Terms are dealt to owners: rare ones to the first, common ones to the last, so
   that owners have about the same number of postings.
3. Items travel in bundles. A bundle has, for each shard, sparse accumulators
   (item, document, sum). It visits the owners in turn: a cogroup by (bundle,
   shard) adds the owner's contributions, all integers, to the accumulators, which
   go on to the next owner. The last one leaves the best k of each shard.
4. The best k of each item over all shards are taken.

An accumulator is dropped on the way only if it can't reach the best k: k others of
its shard already have more than it would with the highest contribution of every
term that is still to come. So results are exact.

A group of a cogroup has at most so many items and documents (ITEMS, DOCS) and is
spread by shards, which are chunks of rows and not of any key, so no term, source or
repeated doc_id makes one hot. What the tasks of a pass know (the block's terms) is
bounded: items are dealt into blocks of some PAIRS distinct (item, term) pairs, each
of which makes a pass of its own.

Nulls: a null text has no terms, and a document or item without terms isn't in any
result. Documents without a doc_id are ranked as well, after all others of the same
score; rows that repeat a doc_id are documents of their own. Rows that repeat an
item_id are one item with the terms of all, a null item_id is one too. Very long
texts are read whole. Empty tables give an empty result. Only the named columns are
read, so others don't clash. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assocframe.llm.text import buffers, byte_values, slices, span_hashes, word_spans
from assocframe.runtime import materialise, release

#: Owners of terms, and so stages.
OWNERS = 4
#: Items of a bundle; documents and postings of a shard.
ITEMS = 256
DOCS = 4096
POSTINGS = 1 << 20
#: Distinct pairs of an item and a term in one block of items.
PAIRS = 1 << 20

_BETWEEN = np.zeros(256, bool)
_BETWEEN[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_POSTINGS = "shard long, ids binary, nulls binary, n binary, doc binary, term binary, tf binary"
_ROUTED = "bundle int, shard long, ids binary, nulls binary, doc binary, term binary, part binary, owner int"
_BUNDLES = "bundle int, shard long, ids binary, nulls binary, item binary, doc binary, sum binary"


def term_hashes(part: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each term of a slice's texts, and each text's first (with the end)."""
    data, at = buffers(part.column(text))
    starts, ends, first = word_spans(data, at, _BETWEEN)
    return span_hashes(data, starts, ends, byte_values(fold=True)), first


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """Distinct (item, term) pairs, terms as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                hashes, first = term_hashes(part, text)
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                yield pa.RecordBatch.from_arrays([part.column(item).take(pa.array(row)), pa.array(hashes.view(np.int64))], names=["item", "term"])

    kind = items.schema[item].dataType.simpleString()
    return items.select(item, text).mapInArrow(run, f"item {kind}, term long").distinct()


def _array(value, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def postings(docs: DataFrame, terms: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """One row for each shard: its documents in the order of their ids, their
    numbers of terms, and (document, term, tf) of the given terms (sorted hashes)."""

    def shard(number: int, ids: pa.Array, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        order = np.asarray(pc.array_sort_indices(ids, null_placement="at_end")).astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        nulls = np.asarray(ids.is_null())[order]
        values = np.asarray(ids.fill_null(0))[order].astype(np.int64)
        by = np.lexsort((place[doc], term))
        cols = [values, nulls, n[order].astype(np.int64), place[doc][by].astype(np.uint16), term[by].astype(np.int32), tf[by].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([c.tobytes()], pa.binary()) for c in cols]], names=["shard", "ids", "nulls", "n", "doc", "term", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, docs_held, count = [], 0, 0

        def hand_on() -> pa.RecordBatch:
            ids, n, doc, term, tf = zip(*held, strict=True)
            return shard(number, pa.concat_arrays(ids), *map(np.concatenate, (n, doc, term, tf)))

        for batch in batches:
            for part in slices(batch, text):
                for some in range(0, part.num_rows, DOCS):
                    now = part.slice(some, DOCS)
                    hashes, first = term_hashes(now, text)
                    n = np.diff(first)
                    at = np.minimum(np.searchsorted(terms, hashes), max(len(terms) - 1, 0))
                    hit = terms[at] == hashes if len(terms) else np.zeros(len(hashes), bool)
                    doc = np.repeat(np.arange(len(n)), n)[hit]
                    key, tf = np.unique(doc * max(len(terms), 1) + at[hit], return_counts=True)
                    if held and (docs_held + len(n) > DOCS or count + len(key) > POSTINGS):
                        yield hand_on()
                        number, held, docs_held, count = number + 1, [], 0, 0
                    held.append((now.column(doc_id), n, docs_held + key // max(len(terms), 1), key % max(len(terms), 1), tf))
                    docs_held, count = docs_held + len(n), count + len(key)
        if held:
            yield hand_on()

    return docs.select(F.col(doc_id).cast("long").alias(doc_id), text).mapInArrow(run, _POSTINGS)


def statistics(found: DataFrame, terms: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """N, L, and of each term df and the highest tf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, most, n, total = np.zeros(terms, np.int64), np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            for k in range(batch.num_rows):
                lengths, term, tf = (_array(batch.column(c)[k], kind) for c, kind in (("n", np.int64), ("term", np.int32), ("tf", np.int32)))
                n, total = n + int((lengths > 0).sum()), total + int(lengths.sum())
                df += np.bincount(term, minlength=terms)
                np.maximum.at(most, term, tf)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n)), pa.array(np.append(most[at], 0)), pa.array(np.append(np.zeros(len(at), np.int64), total))], names=["term", "n", "most", "total"])

    rows = found.select("n", "term", "tf").mapInArrow(run, "term long, n long, most long, total long").groupBy("term").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum("total").alias("total")).collect()
    df, most, n, total = np.zeros(terms, np.int64), np.zeros(terms, np.int64), 0, 0
    for r in rows:
        if r.term < 0:
            n, total = r.n, r.total
        else:
            df[r.term], most[r.term] = r.n, r.most
    return n, total, df, most


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def contribution(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def owners_of(df: np.ndarray, owners: int = OWNERS) -> np.ndarray:
    """The owner of each term: rare terms first, equal shares of postings."""
    order = np.argsort(df, kind="stable")
    upto = np.cumsum(df[order]) - df[order]
    out = np.empty(len(df), np.int64)
    out[order] = np.minimum(upto * owners // max(int(df.sum()), 1), owners - 1)
    return out


def _best(sums: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or 0."""
    return np.partition(sums, sums.shape[1] - k, axis=1)[:, sums.shape[1] - k] if sums.shape[1] >= k else np.zeros(len(sums), np.int64)


def search(docs: DataFrame, items: DataFrame, k: int = 50, owners: int = OWNERS, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k documents of the highest
    scores above 0, equal ones by ascending doc_id."""
    pairs = materialise(item_terms(items, item_id, text), "item-terms")
    blocks = max(1, -(-pairs.count() // PAIRS))
    found = None
    for b in range(blocks):
        some = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else pairs
        best = _block(docs, some, k, owners, doc_id, text)
        found = best if found is None else found.unionByName(best)
    release(pairs)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, pairs: DataFrame, k: int, owners: int, doc_id: str, text: str) -> DataFrame:
    """The best k documents of each shard for one block of items: (item_id, doc_id,
    score). The block's pairs, which are bounded, are what the tasks know."""
    kind = pairs.schema["item"].dataType
    told = pairs.toArrow()
    names = told.column("item").combine_chunks().unique() if told.num_rows else pa.array([], to_arrow_type(kind))
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    index = {v: i for i, v in enumerate(names.to_pylist())}
    item = np.array([index[v] for v in told.column("item").to_pylist()], np.int64)
    terms, term = np.unique(np.asarray(told.column("term")).astype(np.int64).view(np.uint64), return_inverse=True)
    shards = materialise(postings(docs, terms, doc_id, text), "postings")
    n, total, df, most = statistics(shards, len(terms))
    w, owner = weights(n, df), owners_of(df, owners)
    order = np.lexsort((item, term))
    item, term = item[order], term[order]
    first = np.searchsorted(term, np.arange(len(terms) + 1))  # items of a term: item[first[t]:first[t + 1]]
    bundles = -(-len(names) // ITEMS)
    # the highest contribution of a term, and what owners after s can still give an item
    top = w * contribution(np.maximum(most, 1), np.int64(50 + 50 * n // max(total, 1))) * (most > 0)
    left = np.zeros((owners, len(names)), np.int64)
    for s in range(owners):
        np.add.at(left[s], item, np.where(owner[term] > s, top[term], 0))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contributions by bundle and owner; owner -1 begins a bundle's way."""
        in_bundle = np.zeros((bundles, len(terms)), bool)
        in_bundle[item // ITEMS, term] = True
        for batch in batches:
            for r in range(batch.num_rows):
                lengths, doc, t, tf = (_array(batch.column(c)[r], kind) for c, kind in (("n", np.int64), ("doc", np.uint16), ("term", np.int32), ("tf", np.int32)))
                m = 50 + 50 * lengths * n // max(total, 1)
                part = contribution(tf.astype(np.int64), m[doc])
                whose = owner[t]
                rows = []
                for b in range(bundles):
                    mine = in_bundle[b][t]
                    if mine.any():
                        rows.append((b, batch.column("ids")[r].as_py(), batch.column("nulls")[r].as_py(), b"", b"", b"", -1))
                    for s in np.unique(whose[mine]).tolist():
                        x = mine & (whose == s)
                        rows.append((b, None, None, doc[x].tobytes(), t[x].tobytes(), part[x].astype(np.uint32).tobytes(), s))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    kinds = [pa.int32(), *[pa.binary()] * 5, pa.int32()]
                    out = [pa.array(c, ty) for c, ty in zip(cols, kinds, strict=True)]
                    out.insert(1, pa.array([batch.column("shard")[r].as_py()] * len(rows), pa.int64()))
                    yield pa.RecordBatch.from_arrays(out, names=["bundle", "shard", "ids", "nulls", "doc", "term", "part", "owner"])

    def gather(bundle: pa.Table, owned: pa.Table) -> tuple[int, np.ndarray]:
        """The sums of a bundle's items (rows) over a shard's documents (columns),
        with an owner's contributions."""
        b = bundle.column("bundle")[0].as_py()
        width = min(ITEMS, len(names) - b * ITEMS)
        sums = np.zeros((width, len(_array(bundle.column("ids")[0], np.int64))), np.int64)
        i, d, v = (_array(bundle.column(c)[0], kind) for c, kind in (("item", np.uint16), ("doc", np.uint16), ("sum", np.int64)))
        sums[i, d] = v
        for r in range(owned.num_rows):
            doc, t, part = (_array(owned.column(c)[r], kind) for c, kind in (("doc", np.uint16), ("term", np.int32), ("part", np.uint32)))
            cut = np.append(np.flatnonzero(np.append(True, t[1:] != t[:-1])), len(t)).tolist() if len(t) else [0]
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                who = item[first[t[a]] : first[t[a] + 1]]
                who = who[who // ITEMS == b] - b * ITEMS
                sums[np.ix_(who, doc[a:z])] += w[t[a]] * part[a:z].astype(np.int64)
        return b, sums

    def visit(s: int):
        def run(bundle: pa.Table, owned: pa.Table) -> pa.Table:
            b, sums = gather(bundle, owned)
            ahead = left[s][b * ITEMS : b * ITEMS + len(sums), None]
            i, d = np.nonzero((sums > 0) & (sums + ahead >= _best(sums, k)[:, None]))
            cols = [c.astype(ty).tobytes() for c, ty in ((i, np.uint16), (d, np.uint16), (sums[i, d], np.int64))]
            keep = [bundle.column(c).slice(0, 1) for c in ("bundle", "shard", "ids", "nulls")]
            return pa.table([*keep, *[pa.array([c], pa.binary()) for c in cols]], names=["bundle", "shard", "ids", "nulls", "item", "doc", "sum"])

        return run

    item_kind = to_arrow_type(kind)

    def select(bundle: pa.Table, owned: pa.Table) -> pa.Table:
        b, sums = gather(bundle, owned)
        i, d = np.nonzero((sums > 0) & (sums >= _best(sums, k)[:, None]))
        by = np.lexsort((d, -sums[i, d], i))
        i, d = i[by], d[by]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        i, d = i[nth < k], d[nth < k]
        ids, nulls = _array(bundle.column("ids")[0], np.int64), _array(bundle.column("nulls")[0], bool)
        return pa.table([names.take(pa.array(i + b * ITEMS)).cast(item_kind), pa.array(ids[d], mask=nulls[d]), pa.array(sums[i, d])], names=["item_id", "doc_id", "score"])

    routed = materialise(shards.mapInArrow(route, _ROUTED), "routed", by="owner")
    release(shards)
    none = [F.lit(b"").alias(c) for c in ("item", "doc", "sum")]
    bundle = routed.where("owner = -1").select("bundle", "shard", "ids", "nulls", *none)
    key = ["bundle", "shard"]
    result = f"item_id {kind.simpleString()}, doc_id long, score long"
    for s in range(owners):
        owned = routed.where(F.col("owner") == s).select(*key, "doc", "term", "part")
        met = bundle.groupBy(*key).cogroup(owned.groupBy(*key))
        bundle = met.applyInArrow(visit(s), _BUNDLES) if s < owners - 1 else met.applyInArrow(select, result)
    best = materialise(bundle, "best")
    release(routed)
    return best


#: The formula as it stands, over all documents' terms that items have.
ORACLE_SQL = r"""
WITH found AS (
  SELECT doc_id, row_number() OVER () AS line, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), whole AS (
  SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM found WHERE len(t) > 0
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), posted AS (
  SELECT line, doc_id, n, term, count(*) AS tf FROM (SELECT line, doc_id, len(t) AS n, unnest(t) AS term FROM found) GROUP BY ALL
), weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posted, whole GROUP BY term, n_docs
), scored AS (
  SELECT item_id, doc_id, line, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN posted USING (term) JOIN weighed USING (term), whole GROUP BY ALL
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""
