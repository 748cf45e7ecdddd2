"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct word n-grams, as 64-bit hashes. Two sets link
when 100 * intersection >= threshold * union. Sizes are cut into bands so that
linked sets lie in the same band or in neighbouring ones; a band of sizes up to
r bounds the symmetric difference of a linked pair by
k = floor(2 r (100 - t) / (100 + t)). For each band that concerns it, a set is
partitioned by hashes of its elements into parts of three cells each. Among
floor(k / 2) + 1 + slack parts of a linked pair, slack + 1 at least differ in
one element at most, so that the pair agrees on two of their cells: the
signatures are the sums over each part without one of its cells.

Two empty cells are no evidence. A part that has such is bare; a set with no
more bare parts than the slack shares a signature of filled cells with all that
it links with, so the empty ones are left out. Sets with more bare parts (poor
ones) need them only for each other: there each comes combined with every
signature of a second, independent partition into k + 1 parts, one of which
must be equal as well (for a small k, into k + 2, two of which are).

Sets that are equal form one class; only classes are joined. The groups of
classes that share a signature are merged by their smallest class (the centre).
Each set has a sketch, the parities of its numbers of elements in so many cells;
no more of them differ between two sets than elements do. In a group that fits a
tile the sets whose sketches or sizes rule out a link with every other one are left out,
and what remains is compared as a whole: the shared elements of
its sets make a matrix whose product with itself counts all intersections, and
the tile gives a spanning forest of its links, fewer rows than it has sets. In
a larger one all classes are first held against the centre, in tiles; classes
outside the largest component that results are then compared with all of
others, in tiles. So no group is collected, no group's pairs are emitted, and no
link that could join two components is left out. jaccard_links() gives every
link between classes by the same tiles.

Nulls and texts without words have empty sets and link with nothing. Rows that
share a doc_id, and are no copies of a smaller one's, count as one document
with several sets, which links where any of them does; rows without a doc_id
stand alone. A text of any length is one set; columns other than doc_id and the
text aren't read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assocframe.llm.components import components
from assocframe.llm.text import buffers, byte_values, mix, shingles, slices, span_hashes, within, word_spans
from assocframe.runtime import BROADCAST_ROWS, batches_of, has_rows, materialise, release, sized_join

#: Sets on either side of a tile, and elements in them.
TILE = 512
TILE_ELEMENTS = 1 << 20
#: Rows handed to a Python worker at once.
BATCH_ROWS = 200
#: Signatures that a task holds before it hands them on, and that a bucket gets.
FLUSH = 1 << 20
BUCKET = 1 << 20
LEAST_BUCKETS = 512
#: Sets of one flush with the same signature beyond which it counts as hot there.
HOT = 64
#: Fingerprints of sets that a task remembers.
REMEMBERED = 200_000
#: Distinct elements of a tile that are counted at once.
_COLUMNS = 4096
#: Words of sketches that are held against each other at once.
_WORDS = 1 << 20
_CELLS = 3
#: The largest k for which pairs of parts make the second partition's signatures.
PAIRED = 8
#: Bytes of an element's hash that tiles compare, and of a signature within its bucket.
_BYTES = 6


def bands(threshold: int, most: int) -> np.ndarray:
    """The upper size of each band, up to one that holds `most`."""
    out = [0]
    while out[-1] < most:
        out.append(100 * (out[-1] + 1) // threshold)
    return np.array(out[1:] + [100 * (out[-1] + 1) // threshold], np.int64)


def text_sets(part: pa.RecordBatch, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-grams of each text, flat, and where each begins."""
    data, at = buffers(part.column(text))
    starts, ends, first = word_spans(data, at)
    grams, gram_at = shingles(span_hashes(data, starts, ends, byte_values(fold=True)), first, n)
    sets = [np.unique(grams[a:b]) for a, b in zip(gram_at[:-1], gram_at[1:], strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of each run."""
    run = np.append(np.uint64(0), np.cumsum(values))
    return run[at[1:]] - run[at[:-1]]


def sums_by(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit sum of the values of each index, from exact sums of their halves."""
    low = np.bincount(index, (values & np.uint64(0xFFFFFFFF)).astype(float), n).astype(np.uint64)
    high = np.bincount(index, (values >> np.uint64(32)).astype(float), n).astype(np.uint64)
    return low + mix(high) * np.uint64(0x9FB21C651E98DF25)


def dealt(x: np.ndarray, parts: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part, numbered from `first`, of each element hash of sets of n."""
    return np.repeat(first, n) + ((x >> np.uint64(32)) * np.repeat(parts.astype(np.uint64), n) >> np.uint64(32)).astype(np.int64)


def _second(x: np.ndarray, n: np.ndarray, k: np.ndarray, poor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the poor sets by a second partition, flat, and where each
    set's begin: sums of pairs of k + 2 parts for a small k, of which two parts
    are equal, else of each of k + 1 parts, of which one is."""
    paired = poor & (k <= PAIRED)
    parts = np.where(paired, k + 2, k + 1) * poor
    first = np.append(0, np.cumsum(parts))
    z = mix(x + np.uint64(0x2545F4914F6CDD1D))
    total = mix(sums_by(dealt(z, parts[poor], first[:-1][poor], n[poor]), mix(z), first[-1]) + within(parts).astype(np.uint64))
    begin = np.append(0, np.cumsum(np.where(paired, (k + 2) * (k + 1) // 2, parts)))
    out = np.empty(begin[-1], np.uint64)
    single = np.repeat(~paired, parts)
    out[np.repeat(~paired, np.diff(begin))] = total[single]
    for size in np.unique(parts[paired]).tolist():
        sets = np.flatnonzero(paired & (parts == size))
        t = total[first[sets][:, None] + np.arange(size)]
        i, j = np.triu_indices(size, 1)
        out[begin[sets][:, None] + np.arange(len(i))] = mix(t[:, i] + mix(t[:, j]))
    return begin, out


def signatures(sets: np.ndarray, at: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of the sets, flat, and the index of the set of each."""
    size = np.diff(at)
    upper = bands(threshold, int(size.max(initial=0)))
    band = np.searchsorted(upper, size)
    out, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for tag in (band, band + 1):
        k = 2 * upper[tag] * (100 - threshold) // (100 + threshold)
        on = (size > 0) & (k > 0)
        live, elements = np.flatnonzero(on), np.repeat(on, size)
        n, tags, least = size[live], tag[live].astype(np.uint64), k[live] // 2 + 1
        slack = least // 8
        parts = least + slack
        first = np.append(0, np.cumsum(parts))
        x = mix(sets[elements] + np.repeat(mix(tags + np.uint64(101)), n))
        cell = dealt(x, parts, first[:-1], n) * _CELLS + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(_CELLS) >> np.uint64(32)).astype(np.int64)
        y = mix(x + np.uint64(0x632BE59BD9B4E019))
        held = np.bincount(cell, minlength=first[-1] * _CELLS).reshape(-1, _CELLS)
        total = sums_by(cell, y, first[-1] * _CELLS).reshape(-1, _CELLS)
        mine = np.repeat(np.arange(len(live)), parts)
        key = mix(np.repeat(tags, parts) << np.uint64(32) | within(parts).astype(np.uint64))
        sig = np.stack([mix(total.sum(axis=1) - total[:, j] + key + np.uint64(j)) for j in range(_CELLS)], axis=1)
        bare = held.sum(axis=1, keepdims=True) == held
        out.append(sig[~bare])
        owner.append(live[np.repeat(mine[:, None], _CELLS, 1)[~bare]])
        poor = np.bincount(mine, bare.any(axis=1), len(live)) > slack
        if poor.any():
            second, other = _second(y[np.repeat(poor, n)], n, k[live], poor)
            r, j = np.nonzero(bare & poor[mine][:, None])
            times = np.diff(second)[mine[r]]
            out.append(mix(np.repeat(sig[r, j], times) + other[np.repeat(second[mine[r]], times) + within(times)]))
            owner.append(np.repeat(live[mine[r]], times))
    return np.concatenate(out), np.concatenate(owner)


def cut_bytes(values: np.ndarray) -> bytes:
    """The low bytes of 64-bit integers, _BYTES of each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()


def whole_numbers(raw: bytes | memoryview) -> np.ndarray:
    """The integers that cut_bytes() cut."""
    out = np.zeros((len(raw) // _BYTES, 8), np.uint8)
    out[:, :_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, _BYTES)
    return out.view("<u8").ravel()


def _sets_of(docs: DataFrame, text: str, n: int) -> DataFrame:
    """(node, elements): the low bytes of each set's hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                sets, at = text_sets(part, text, n)
                each = [cut_bytes(sets[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(each, pa.binary())], names=["node", "elements"])

    return docs.select("doc_id", text).mapInArrow(run, "node long, elements binary")


def sketches(sets: np.ndarray, at: np.ndarray, threshold: int) -> list[bytes]:
    """The parity sketch of each set, of a power of two of bits: four times the
    largest difference of a link, or more. Halves XORed give the one half as long."""
    size = np.diff(at)
    bits = np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(1, 8 * size * (100 - threshold) / (100 + threshold)))).astype(np.int64))
    first = np.append(0, np.cumsum(bits))
    cell = (mix(sets + np.uint64(0x3C79AC492BA7B653)) & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64) + np.repeat(first[:-1], size)
    flat = np.packbits((np.bincount(cell, minlength=first[-1]) & 1).astype(np.uint8), bitorder="little")
    return [flat[a // 8 : b // 8].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def has_near(node: np.ndarray, size: np.ndarray, raw: list[bytes], threshold: int) -> np.ndarray:
    """Which sets another node's set may link with, as far as sketches tell."""
    words = np.array([len(x) // 8 for x in raw])
    out = np.zeros(len(node), bool)
    rows = np.zeros(0, np.int64)
    m = np.zeros((0, 1), np.uint64)
    for w in np.unique(words)[::-1].tolist():
        while len(rows) and m.shape[1] > w:
            m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
        mine = np.flatnonzero(words == w)
        m = np.concatenate([m.reshape(-1, w), np.frombuffer(b"".join(raw[i] for i in mine), np.uint64).reshape(-1, w)])
        rows = np.append(rows, mine)
        step = max(1, _WORDS // (len(rows) * w))
        for a in range(len(rows) - len(mine), len(rows), step):
            b = min(a + step, len(rows))
            apart = np.bitwise_count(m[a:b, None, :] ^ m[None]).sum(axis=2, dtype=np.int64)
            one, other = size[rows[a:b], None], size[None, rows]
            near = np.maximum(apart, abs(one - other)) * (100 + threshold) <= (100 - threshold) * (one + other)
            near &= node[rows[a:b], None] != node[None, rows]
            out[rows[a:b]] |= near.any(axis=1)
            out[rows] |= near.any(axis=0)
    return out


def _sizes(docs: DataFrame, text: str, n: int, threshold: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sketch): size, 128-bit fingerprint and sketch
    of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                sets, at = text_sets(part, text, n)
                h1, h2 = sums(mix(sets), at), sums(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(at)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(sketches(sets, at, threshold), pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "sketch"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sketch binary")


def bucket_of(sig: np.ndarray, buckets: int) -> np.ndarray:
    return (sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def name_of(bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What a group of one signature is called: from its bucket and its low bytes."""
    return mix(mix(bucket + np.uint64(1)) ^ low)


def _signed(docs: DataFrame, text: str, n: int, threshold: int, buckets: int) -> DataFrame:
    """(bucket, sigs, nodes, hot): the signatures of the sets that a task meets,
    packed by bucket, with the document of each. Nodes lie in planes of bytes, of
    which most are constant, so the shuffle's compression takes them away. Where a
    flush has a signature of many sets, they go to another bucket under its name,
    `hot`, without the signature, and the signature's bucket gets one of them."""
    low = np.uint64((1 << 8 * _BYTES) - 1)

    def packed(sig: np.ndarray, node: np.ndarray, salt: np.uint64) -> pa.RecordBatch:
        order = np.argsort(sig, kind="stable")
        sig, node = sig[order], node[order]
        run = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        count = np.diff(np.append(run, len(sig)))
        rows = []
        for a, c in zip(run[count > HOT].tolist(), count[count > HOT].tolist(), strict=True):
            x = sig[a : a + 1]
            name = name_of(bucket_of(x, buckets), x & low).view(np.int64)[0]
            rows.append((bucket_of(mix(x + salt), buckets)[0], b"", node[a : a + c].tobytes(), name))
            rows.append((bucket_of(x, buckets)[0], cut_bytes(x), node[a : a + 1].tobytes(), name))
        keep = np.repeat(count <= HOT, count)
        sig, node = sig[keep], node[keep]
        bucket = bucket_of(sig, buckets)
        cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(sig)).tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            rows.append((bucket[a], cut_bytes(sig[a:b]), node[a:b].view(np.uint8).reshape(-1, 8).T.tobytes(), None))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["bucket", "sigs", "nodes", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            for part in slices(batch, text):
                sets, at = text_sets(part, text, n)
                prints = list(zip(sums(mix(sets), at).tolist(), np.diff(at).tolist(), strict=True))
                new = np.zeros(len(at) - 1, bool)
                for i, x in enumerate(prints):
                    if x[1] and x not in met:
                        met.add(x)
                        new[i] = True
                if len(met) > REMEMBERED:
                    met.clear()
                keep = np.flatnonzero(new)
                size = np.diff(at)[keep]
                sig, owner = signatures(sets[np.repeat(new, np.diff(at))], np.append(0, np.cumsum(size)), threshold)
                held.append((sig, np.asarray(part.column("doc_id").cast(pa.int64()))[keep][owner]))
                count += len(sig)
                if count >= FLUSH:
                    yield packed(*map(np.concatenate, zip(*held, strict=True)), mix(held[0][0][:1])[0])
                    held, count = [], 0
        if count:
            yield packed(*map(np.concatenate, zip(*held, strict=True)), mix(held[0][0][:1].sum(keepdims=True))[0])

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", text).mapInArrow(run, "bucket long, sigs binary, nodes binary, hot long")


def _by_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys, from rows sorted by key."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        k = np.asarray(t.column(key))
        last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
        if last:
            yield t.slice(0, last)
        rest = t.slice(last)
    if rest is not None:
        yield rest


def _runs(t: pa.Table, key: str) -> Iterator[tuple[int, int]]:
    k = np.asarray(t.column(key))
    cut = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k)).tolist()
    return zip(cut[:-1], cut[1:], strict=True)


def _shared(signed: DataFrame) -> DataFrame:
    """Who shares a signature with whom: (sig, centre, node), where centre is the
    smallest document of a bucket's signature, and sig is null. Of hot signatures
    each document has a row with sig, without a centre."""

    def of_bucket(bucket: int, sigs: list, nodes: list, hot: list) -> pa.RecordBatch:
        name, centre, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def tell(names: np.ndarray, found: np.ndarray) -> None:
            name.append(names)
            other.append(found)

        low, node, flagged = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for h, x, v in zip(hot, sigs, nodes, strict=True):
            x, v = whole_numbers(x.as_buffer()), np.frombuffer(v.as_buffer(), np.uint8)
            if h is None or len(x):
                low.append(x)
                node.append(v.reshape(8, -1).T.copy().view(np.int64).ravel())
            else:
                tell(np.full(len(v) // 8, h, np.int64), v.view(np.int64))
            if h is not None and len(x):
                flagged.append(x[0])
        low, node = np.concatenate(low), np.concatenate(node)
        order = np.lexsort((node, low))
        low, node = low[order], node[order]
        run = np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(low) else np.zeros(0, np.int64)
        count = np.diff(np.append(run, len(low)))
        by_name = np.repeat(np.isin(low[run], np.array(flagged, np.uint64)), count)
        tell(name_of(np.array([bucket], np.uint64), low[by_name]).view(np.int64), node[by_name])
        first = np.repeat(node[run], count)
        pair = ~by_name & (first != node)
        both = np.unique(np.stack([first[pair], node[pair]]), axis=1) if pair.any() else np.zeros((2, 0), np.int64)
        centre.append(both[0])
        other.append(both[1])
        name, centre = np.concatenate(name), np.concatenate(centre)
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(name), none(len(centre))]), pa.concat_arrays([none(len(name)), pa.array(centre)]), pa.array(np.concatenate(other))], names=["sig", "centre", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_runs(batches, "bucket"):
            for a, b in _runs(t, "bucket"):
                part = t.slice(a, b - a)
                yield of_bucket(part.column("bucket")[0].as_py(), list(part.column("sigs")), list(part.column("nodes")), part.column("hot").to_pylist())

    return signed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "sig long, centre long, node long")


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs of sets of unsigned integers."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    count = np.diff(np.append(np.flatnonzero(new), len(flat)))
    shared = np.repeat(count > 1, count)
    column, owner = np.cumsum(new[shared]) - 1, owner[shared]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [first, first + _COLUMNS])
        m = np.zeros((len(sets), min(_COLUMNS, int(column[b - 1]) - first + 1)), np.float32)
        m[owner[a:b], column[a:b] - first] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _forest(linked: np.ndarray) -> tuple[list, list]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    seen, out_a, out_b = np.zeros(len(linked), bool), [], []
    for first in np.flatnonzero(linked.any(axis=1)).tolist():
        todo = [] if seen[first] else [first]
        seen[first] = True
        while todo:
            v = todo.pop()
            near = np.flatnonzero(linked[v] & ~seen)
            seen[near] = True
            out_a.append(np.full(len(near), v))
            out_b.append(near)
            todo.extend(near.tolist())
    return out_a, out_b


def _links(tiles: DataFrame, threshold: int, every: bool) -> DataFrame:
    """Links (a, b), a < b, from rows (tile, node, lead, rest, elements): of each
    tile's leading sets with its other ones. Of each tile a spanning forest, or
    all with `every`."""

    def of_tile(node: np.ndarray, lead: np.ndarray, rest: np.ndarray, raw: list) -> tuple[np.ndarray, np.ndarray]:
        sets = [whole_numbers(v.as_buffer()) for v in raw]
        size = np.array([len(v) for v in sets])
        both = _counts(sets)
        linked = 100 * both >= threshold * (size[:, None] + size[None, :] - both)
        linked &= (lead[:, None] & rest[None, :]) | (rest[:, None] & lead[None, :])
        linked &= node[:, None] != node[None, :]
        linked &= (size[:, None] > 0) & (size[None, :] > 0)
        a, b = np.nonzero(linked) if every else (np.concatenate([np.zeros(0, int), *x]) for x in _forest(linked))
        return np.minimum(node[a], node[b]), np.maximum(node[a], node[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_runs(batches, "tile"):
            node, lead, rest = (np.asarray(t.column(c)) for c in ("node", "lead", "rest"))
            raw = list(t.column("elements"))
            found = [of_tile(node[x:y], lead[x:y], rest[x:y], raw[x:y]) for x, y in _runs(t, "tile")]
            pairs = np.unique(np.stack([np.concatenate([f[k] for f in found]) for k in (0, 1)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["a", "b"])

    return tiles.mapInArrow(run, "a long, b long").distinct()


def _near(tiles: DataFrame, threshold: int) -> DataFrame:
    """The rows (centre, node, size, sketch), in runs by centre, whose sketches
    leave a link with another node of their centre open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_runs(batches, "centre"):
            node, size = np.asarray(t.column("node")), np.asarray(t.column("size"))
            raw = t.column("sketch").to_pylist()
            keep = np.concatenate([has_near(node[a:b], size[a:b], raw[a:b], threshold) for a, b in _runs(t, "centre")])
            yield from t.select(["centre", "node", "size"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return tiles.mapInArrow(run, "centre long, node long, size long")


def _blocks(n: str, elements: str) -> str:
    """SQL for the number of blocks that so many sets with so many elements take."""
    return f"greatest(ceil({n} / {TILE}), ceil({elements} / {TILE_ELEMENTS}))"


class Join:
    """Classes, candidate groups and links of one table of documents."""

    def __init__(self, docs: DataFrame, n: int = 3, threshold: int = 90, text: str = "text", every: bool = False):
        self.threshold, self.every = threshold, every
        found = materialise(_sizes(docs, text, n, threshold), "sets")
        twice = found.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
        twice = materialise(twice.drop("n"), "classes")
        named = F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
        self.members = materialise(sized_join(found, twice, ["h1", "h2"], "left", ["doc_id"]).select("doc_id", "n_shingles", named.alias("class")), "members")
        release(twice)
        elements = self.members.agg(F.sum("n_shingles")).first()[0] or 0
        # about 2.5 k signatures a set, of which k is a part of its size
        buckets = max(LEAST_BUCKETS, int(5 * elements * (100 - threshold) / (100 + threshold)) // BUCKET)
        raw = materialise(_shared(_signed(docs, text, n, threshold, buckets)), "shared")
        known = self.members.where("doc_id is not null and n_shingles > 0").groupBy(F.col("doc_id").alias("node"), "class").agg(F.max("n_shingles").alias("size"))
        hot = raw.where("sig is not null").select("sig", "node")
        centres = hot.groupBy("sig").agg(F.min("node").alias("centre"))
        met = raw.where("sig is null").select("centre", "node").union(hot.join(centres, "sig").where("centre != node").select("centre", "node")).distinct()
        # by class; a centre belongs to its group
        ends = met.join(known, "node").select("centre", F.col("class").alias("node"), "size").join(known.select(F.col("node").alias("centre"), F.col("class").alias("at"), F.col("size").alias("own")), "centre")
        pairs = materialise(ends.where("at != node").groupBy(F.col("at").alias("centre"), "node").agg(F.max("size").alias("size"), F.max("own").alias("own")), "pairs")
        merged = materialise(pairs.select("centre", "node", "size").union(pairs.groupBy("centre").agg(F.max("own").alias("size")).select("centre", F.col("centre").alias("node"), "size")), "merged")
        sizes = materialise(self._sized(merged), "sizes")
        small = merged.join(sizes.where("blocks = 1").select("centre"), "centre").select("centre", "node")
        drawn = found.where("n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"), "sketch")
        near = _near(small.join(drawn, "node").select("centre", "node", "size", "sketch").repartition("centre").sortWithinPartitions("centre"), threshold)
        near = near.groupBy("centre", "node").agg(F.max("size").alias("size"))
        self.merged = materialise(merged.join(sizes.where("blocks > 1").select("centre"), "centre").select("centre", "node", "size").union(near), "near")
        release(found, merged, sizes)
        self.sizes = materialise(self._sized(self.merged), "sizes")
        ids = materialise(self.merged.select(F.col("node").alias("doc_id")).distinct(), "candidates")
        self.sets = materialise(sized_join(docs.select("doc_id", text), ids, ["doc_id"], most=5 * BROADCAST_ROWS).transform(lambda d: _sets_of(d, text, n)), "elements")
        release(raw, pairs, ids)

    def _sized(self, merged: DataFrame) -> DataFrame:
        """(centre, n, elements, blocks) of groups (centre, node, size)."""
        return merged.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("elements")).withColumn("blocks", F.expr(_blocks("n", "elements")).cast("int"))

    def _compared(self, rows: DataFrame, tag: str) -> DataFrame:
        """The links of rows (tile, node, lead, rest)."""
        tiles = rows.join(self.sets, "node").select("tile", "node", "lead", "rest", "elements").repartition("tile").sortWithinPartitions("tile")
        return materialise(_links(tiles, self.threshold, self.every), tag)

    def first(self) -> DataFrame:
        """Links of the groups that fit a tile, and those between each larger one's
        classes and its centre."""
        sized = self.merged.join(self.sizes.select("centre", "blocks"), "centre")
        yes, no = F.lit(True), F.lit(False)
        whole = sized.where("blocks = 1").select(F.xxhash64("centre").alias("tile"), "node", yes.alias("lead"), yes.alias("rest"))
        large = sized.where("blocks > 1")
        part = F.pmod(F.xxhash64("node"), F.col("blocks"))
        arms = large.where("node != centre").select(F.xxhash64("centre", part).alias("tile"), "node", no.alias("lead"), yes.alias("rest"))
        each = self.sizes.where("blocks > 1").select("centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("part"))
        heads = each.select(F.xxhash64("centre", "part").alias("tile"), F.col("centre").alias("node"), yes.alias("lead"), no.alias("rest"))
        return self._compared(whole.union(arms).union(heads), "first")

    def across(self, labels: DataFrame | None) -> DataFrame | None:
        """In groups larger than a tile, links between classes whose labels (node,
        label) differ; without labels, all links. None if there is no such group."""
        large = self.sizes.where("blocks > 1")
        if not has_rows(large):
            return None
        groups = self.merged.join(large.select("centre"), "centre").select(F.xxhash64("centre").alias("grp"), "node", "size")
        if labels is None:
            marked = groups.withColumn("label", F.col("node"))
        else:
            marked = groups.join(labels.select("node", "label"), "node", "left").select("grp", "node", "size", F.coalesce("label", "node").alias("label"))
        marked = materialise(marked, "labelled")
        parts = marked.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("elements"))
        open_ = parts.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("elements").alias("elements"), F.max(F.struct("n", "elements", F.col("label").alias("major"))).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        minor = "0" if self.every else "top.n", "0" if self.every else "top.elements"
        open_ = open_.select("grp", F.expr(_blocks("n", "elements")).cast("long").alias("blocks"), F.expr(_blocks(f"(n - {minor[0]})", f"(elements - {minor[1]})")).cast("long").alias("leads"), "top.major")
        open_ = marked.join(open_, "grp")
        # a row for each tile in which a class is compared, and in which it leads
        block = lambda k, n: F.pmod(F.xxhash64("node", F.lit(k)), F.col(n))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        rest = open_.select("grp", "node", F.lit(False).alias("lead"), F.lit(True).alias("rest"), block(0, "blocks").alias("m"), upto("leads").alias("p"))
        leads = open_ if self.every else open_.where("label != major")
        lead = leads.select("grp", "node", F.lit(True).alias("lead"), F.lit(False).alias("rest"), upto("blocks").alias("m"), block(1, "leads").alias("p"))
        out = self._compared(rest.union(lead).select(F.xxhash64("grp", "m", "p").alias("tile"), "node", "lead", "rest"), "across")
        release(marked)
        return out

    def close(self) -> None:
        release(self.merged, self.sizes, self.sets)


def jaccard_components(docs: DataFrame, n: int = 3, threshold: int = 90, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest
    doc_id that can be reached by links, itself included)."""
    with batches_of(docs.sparkSession, BATCH_ROWS):
        j = Join(docs, n, threshold, text)
        links = j.first()
        labels = components(links)
        more = j.across(labels)
    if more is not None and has_rows(more):
        release(labels)
        labels = components(links.union(more))
    j.close()
    release(links, *[more] * (more is not None))
    out = sized_join(j.members, labels.select(F.col("node").alias("class"), "label"), ["class"], "left", ["doc_id"])
    return out.select("doc_id", "n_shingles", F.coalesce("label", "class").alias("component_id"))


def jaccard_links(docs: DataFrame, n: int = 3, threshold: int = 90, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links (a, b) between classes of equal sets, each named by its
    smallest doc_id, and the membership (doc_id, n_shingles, class)."""
    with batches_of(docs.sparkSession, BATCH_ROWS):
        j = Join(docs, n, threshold, text, every=True)
        links, more = j.first(), j.across(None)
    j.close()
    return links if more is None else links.union(more).distinct(), j.members
