"""Substring dedup by difference-cover anchors.

A window is a run of `window` consecutive words of one document. A word is
removed if a window that covers it also starts in a document with a smaller
doc_id; windows are judged on the input, not on what is left of it.

Every residue modulo the period v is a difference of two members of the cover D,
so for any two places i and j there is a shift d < v with i + d and j + d both in
D modulo v. Runs of window - v + 1 words (anchors) are hashed at such places only,
three of seven for windows of 13 words. Of two equal windows, some anchor is
taken in both, at the same distance from their starts:

1. Anchors are brought together by hash. Those that two documents share go back
   to the documents that have them.
2. A shared anchor is extended to the windows that hold it, v at most. These are
   brought together by their hash; those that a smaller doc_id has too go back.
3. Each document is cut by the windows that it got back.

Nothing makes pairs of documents: a hash's rows are reduced to what decides. A
task first settles what its own documents tell (an anchor of two of them is
shared; a window of a smaller one is to go), so it asks about each hash once:
a passage of a third of all documents has one row for each task's buffer where
its hash is owned, and the other rows go straight back. Rows of a hash are packed
by bucket, and buckets grow in number with the text.

Nulls: a null text has no words; a row without doc_id is neither smaller nor
greater than any, so it keeps its words and takes none. Rows that repeat a doc_id,
with equal or other texts, don't take from each other; each is cut by itself.
Empty texts give empty texts. Very long texts are read whole, alone. An empty
table gives an empty result. Only doc_id and text are read, so other columns don't
clash; repeated rows give repeated rows. Anchors may collide without harm; words
are compared by 64-bit hashes and windows by 80 bits beside those of their bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assocframe.llm.ngram_join import _by_runs, _runs
from assocframe.llm.text import buffers, byte_values, mix, slices, span_hashes, within, word_spans

#: Difference covers by period: each residue is the difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: Hashes that a task settles among themselves before it asks, and that a bucket gets.
FLUSH = 1 << 20
BUCKET = 1 << 20
#: Hashes in one packed row at most.
PACKED = 1 << 14
#: Buckets for each shuffle partition at least, so that they spread evenly.
EACH = 4
#: Parts into which rows of one doc_id are dealt by their texts.
PARTS = 256

_NAME, _HIGH = np.uint64(0xFFFFFFFF), np.uint64((1 << 48) - 1)
_ASK, _TELL, _KNOWN = 0, 1, 2
_PACKED_SCHEMA = "bucket long, flags binary, low binary, high binary, ids binary, parts binary"
_FOUND = "doc_id long, part int, hash long"


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period, and its cover, that leaves anchors half a window long."""
    if window < 1:
        raise ValueError("a window has one word at least")
    v = max(p for p in COVERS if 2 * p <= window + 1)
    return v, COVERS[v]


def run_hashes(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of the n word hashes that start at each place, as far as they go."""
    salts = mix(np.arange(seed, seed + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out += words[k : k + len(out)] * salts[k]
    return mix(out)


def starts_of(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of n words start that lie within a text, and their texts."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    return np.repeat(first[:-1], count) + within(count), np.repeat(np.arange(len(count)), count)


class Words:
    """The words of the texts of a slice: hashes, first word of each text, spans."""

    def __init__(self, part: pa.RecordBatch, text: str = "text"):
        self.data, at = buffers(part.column(text))
        self.starts, self.ends, self.first = word_spans(self.data, at)
        self.hashes = span_hashes(self.data, self.starts, self.ends, byte_values(fold=False))

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, place and text of each anchor at the cover's places."""
        v, cover = cover_of(window)
        n = window - v + 1
        at, text = starts_of(self.first, n)
        take = np.isin((at - self.first[text]) % v, cover)
        at, text = at[take], text[take]
        return run_hashes(self.hashes, n, 101)[at], at, text


def _groups(low: np.ndarray, high: np.ndarray, ids: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash and doc_id, and where each hash's rows begin in it (with
    the end)."""
    order = np.lexsort((parts, ids, high, low))
    a, b = low[order], high[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    return order, np.append(np.flatnonzero(new), len(a))


def settled(low: np.ndarray, high: np.ndarray, ids: np.ndarray, parts: np.ndarray, smaller: bool) -> tuple[np.ndarray, ...]:
    """Rows (flag, low, high, ids, parts) to hand on, once each: what is already
    known of these documents, and what has to be asked or told elsewhere. With
    `smaller`, known are the rows of all but the smallest doc_id of a hash, which
    asks; without, all rows of a hash of two documents, one of which is told."""
    order, cut = _groups(low, high, ids, parts)
    low, high, ids, parts = low[order], high[order], ids[order], parts[order]
    n = np.diff(cut)
    least = np.repeat(ids[cut[:-1]], n)
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (ids[1:] != ids[:-1]) | (parts[1:] != parts[:-1])
    if smaller:
        flag = np.where(ids > least, _KNOWN, _ASK)
    else:
        many = ids[cut[1:] - 1] != ids[cut[:-1]]
        flag = np.where(np.repeat(many, n), _KNOWN, _ASK)
        told = cut[:-1][many]
        low, high, ids, parts, flag, new = (np.append(x, y) for x, y in ((low, low[told]), (high, high[told]), (ids, ids[told]), (parts, parts[told]), (flag, np.full(len(told), _TELL)), (new, np.ones(len(told), bool))))
    return tuple(x[new] for x in (flag.astype(np.uint8), low, high, ids, parts))


def keys(low: np.ndarray, high: np.ndarray, wide: bool) -> np.ndarray:
    """What a hash is called within its document: of anchors 32 bits, of windows
    64, all of them among the bits that a bucket compares."""
    name = low & _NAME
    return (high & _HIGH) << np.uint64(16) | (name & np.uint64(0xFFFF)) if wide else name


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, their second ones, ...: what is alike compresses."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(value, kind) -> np.ndarray:
    raw, size = np.frombuffer(value.as_buffer(), np.uint8), np.dtype(kind).itemsize
    return raw.reshape(size, -1).T.copy().view(kind).ravel()


def _pack(rows: tuple[np.ndarray, ...], buckets: int, wide: bool) -> Iterator[pa.RecordBatch]:
    """Packed rows by bucket. A bucket compares 32 bits of anchors, which are there
    to find candidates, and 80 of windows. What is known only passes through: it is
    dealt out evenly, to buckets beyond the others, under its key."""
    flag, low, high, ids, parts = rows
    known = np.cumsum(flag == _KNOWN) // PACKED
    spread = mix(known.astype(np.uint64) + (low[:1] if len(low) else np.zeros(1, np.uint64))) % np.uint64(buckets)
    bucket = np.where(flag == _KNOWN, spread.astype(np.int64) + buckets, ((low >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
    order = np.lexsort((ids, bucket))
    flag, low, high, ids, parts, bucket = (x[order] for x in (flag, low, high, ids, parts, bucket))
    key, name, high = keys(low, high, wide), (low & _NAME).astype(np.uint32), high.view(np.uint8).reshape(len(high), 8)[:, :6]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(bucket))
    spans = [(a + k, min(a + k + PACKED, b)) for a, b in zip(cut.tolist(), ends.tolist(), strict=True) for k in range(0, b - a, PACKED)]
    for some in range(0, len(spans), 64):
        now = [(a, b, bucket[a] >= buckets) for a, b in spans[some : some + 64]]
        cols = [
            [flag[a:b].tobytes() for a, b, _ in now],
            [b"" if told else name[a:b].tobytes() for a, b, told in now],
            [(key[a:b].tobytes() if wide else name[a:b].tobytes()) if told else high[a:b].tobytes() if wide else b"" for a, b, told in now],
            [_planes(ids[a:b]) for a, b, _ in now],
            [parts[a:b].tobytes() for a, b, _ in now],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[[a for a, *_ in now]]), *[pa.array(c, pa.binary()) for c in cols]], names=["bucket", "flags", "low", "high", "ids", "parts"])


def _asked(batches: Iterator[pa.RecordBatch], hashed, buckets: int, smaller: bool) -> Iterator[pa.RecordBatch]:
    """Packed questions from batches of rows, by hashed(slice), which gives (low,
    high, row of the slice) of what is to be asked."""
    held, count = [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            low, high, row = hashed(part)
            ids = np.asarray(part.column("doc_id").fill_null(0))[row]
            held.append((low, high, ids.astype(np.int64), np.asarray(part.column("part"))[row].astype(np.uint8)))
            count += len(low)
            if count >= FLUSH:
                yield from _pack(settled(*map(np.concatenate, zip(*held, strict=True)), smaller), buckets, smaller)
                held, count = [], 0
    if count:
        yield from _pack(settled(*map(np.concatenate, zip(*held, strict=True)), smaller), buckets, smaller)


def _answered(asked: DataFrame, buckets: int, partitions: int, smaller: bool) -> DataFrame:
    """(doc_id, part, hash) of the rows whose question has the answer yes: the
    hash is of another document too, or, with `smaller`, of a smaller one."""

    def of_bucket(t: pa.Table) -> pa.RecordBatch:
        read = lambda name, kind: np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in t.column(name)])
        flag, parts = read("flags", np.uint8), read("parts", np.uint8)
        ids = np.concatenate([_from_planes(v, np.int64) for v in t.column("ids")])
        if t.column("bucket")[0].as_py() >= buckets:
            yes, key = np.ones(len(flag), bool), read("high", np.uint64 if smaller else np.uint32).astype(np.uint64)
        else:
            low, high, yes = read("low", np.uint32).astype(np.uint64), np.zeros((len(flag), 8), np.uint8), np.zeros(len(flag), bool)
            if smaller:
                high[:, :6] = read("high", np.uint8).reshape(-1, 6)
            high = high.view(np.uint64).ravel()
            key = keys(low, high, smaller)
            order, cut = _groups(low, high, ids, parts)
            n = np.diff(cut)
            if smaller:
                found = ids[order] > np.repeat(ids[order][cut[:-1]], n)
            else:
                many = (ids[order][cut[1:] - 1] != ids[order][cut[:-1]]) | (np.add.reduceat((flag[order] == _TELL).astype(np.int64), cut[:-1]) > 0)
                found = np.repeat(many, n) & (flag[order] == _ASK)
            yes[order[found]] = True
        return pa.RecordBatch.from_arrays([pa.array(ids[yes]), pa.array(parts[yes].astype(np.int32)), pa.array(key[yes].view(np.int64))], names=["doc_id", "part", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_runs(batches, "bucket"):
            for a, b in _runs(t, "bucket"):
                yield of_bucket(t.slice(a, b - a))

    return asked.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _FOUND)


def _sets(found: DataFrame) -> DataFrame:
    sets = found.groupBy(F.coalesce("doc_id", F.lit(0)).alias("key"), F.coalesce("part", F.lit(0)).alias("part")).agg(F.collect_list("hash").alias("hashes"))
    return sets.withColumn("has_id", F.lit(True))


def _members(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that came back to the rows of a slice, flat, and their rows."""
    lists = part.column("hashes")
    n = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    return np.asarray(lists.flatten()).astype(np.int64).view(np.uint64), np.repeat(np.arange(len(n)), n)


def _of_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A hash of (hash, row), so that rows are looked up all at once."""
    return mix(hashes + mix(row.astype(np.uint64) + np.uint64(1)))


def dedup(docs: DataFrame, window: int = 13, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), one row for each row of docs: its
    words without those that a window of a smaller doc_id covers, joined by one
    space."""
    spark = docs.sparkSession
    v, cover = cover_of(window)
    # keys without nulls: then both joins below read one shuffle of the texts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("key"), F.col("doc_id").isNotNull().alias("has_id"), F.coalesce(F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int"), F.lit(0)).alias("part"))
    on = ["key", "has_id", "part"]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # words of six letters and a space, at the cover's places
    buckets = max(EACH * partitions, size * len(cover) // (7 * v) // BUCKET + 1)
    partitions = max(partitions, buckets // EACH)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed(part):
            low, _, row = Words(part).anchors(window)
            return low, np.zeros_like(low), row

        return _asked(batches, hashed, buckets, smaller=False)

    def whole(w: Words) -> tuple[np.ndarray, np.ndarray]:
        return run_hashes(w.hashes, window, 211), run_hashes(w.hashes, window, 307)

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed(part):
            w = Words(part)
            low, at, row = w.anchors(window)
            shared, owner = _members(part)
            hit = np.isin(_of_row(keys(low, low, False), row), _of_row(shared, owner))
            reach = np.zeros(len(w.hashes) + 1, np.int64)  # windows that start up to v - 1 words before the anchor
            np.add.at(reach, np.maximum(at[hit] - v + 1, w.first[row[hit]]), 1)
            np.add.at(reach, at[hit] + 1, -1)
            start, row = starts_of(w.first, window)
            take = np.cumsum(reach)[start] > 0
            start, row = start[take], row[take]
            return *(h[start] for h in whole(w)), row

        return _asked((b.filter(b.column("hashes").is_valid()) for b in batches), hashed, buckets, smaller=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part)
                gone, owner = _members(part)
                start, row = starts_of(w.first, window)
                mark = np.zeros(len(w.hashes) + 1, np.int64)
                if len(gone):
                    low, high = whole(w)
                    hit = start[np.isin(_of_row(keys(low[start], high[start], True), row), _of_row(gone, owner))]
                    np.add.at(mark, hit, 1)
                    np.add.at(mark, hit + window, -1)
                keep = np.cumsum(mark)[:-1] == 0
                n = np.diff(w.first)
                kept = np.append(0, np.cumsum(keep))[w.first]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(n - np.diff(kept)), _joined(w, keep, kept)], names=["doc_id", "n_words", "n_removed", "kept_text"])

    asked = rows.where("has_id").mapInArrow(anchors, _PACKED_SCHEMA)
    shared = _sets(_answered(asked, buckets, partitions, smaller=False))
    # a left join, as the last one: rows without shared anchors make no windows
    asked = rows.join(shared, on, "left").select("doc_id", "part", "text", "hashes").mapInArrow(extended, _PACKED_SCHEMA)
    gone = _sets(_answered(asked, buckets, partitions, smaller=True))
    found = rows.join(gone, on, "left").select("doc_id", "part", "text", "hashes")
    return found.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def _joined(w: Words, keep: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text (from kept[i] to kept[i + 1]) with a space between."""
    a, b = w.starts[keep], w.ends[keep]
    size = b - a
    last = np.zeros(len(size), bool)
    ends = kept[1:][np.diff(kept) > 0]
    last[ends - 1] = True
    room = size + ~last
    out = np.full(int(room.sum()), 0x20, np.uint8)
    to = np.cumsum(room) - room
    inside = within(size)
    out[np.repeat(to, size) + inside] = w.data[np.repeat(a, size) + inside]
    at = np.append(0, np.cumsum(room))[kept]
    return pa.Array.from_buffers(pa.large_string(), len(kept) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())


#: Windows as lists of words, the smallest document of each, and the words that a window of a smaller one covers.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS line, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT line, doc_id, s, md5(array_to_string(w[s:s + 12], ' ')) AS h FROM (SELECT line, doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM words)
), least AS (
  SELECT h, min(doc_id) AS first FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT line, p FROM (SELECT line, unnest(range(s, s + 13)) AS p FROM windows JOIN least USING (h) WHERE first < doc_id)
), spans AS (
  SELECT line, list(p) AS gone FROM gone GROUP BY line
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(gone, k))) END, ' ')) AS kept_sha256
FROM words LEFT JOIN spans USING (line)
"""
