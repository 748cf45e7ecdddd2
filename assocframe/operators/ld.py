"""Linkage disequilibrium from packed genotypes: r2 of pairs of variants, pruning
by sliding windows and clumping.

A variant's calls are one binary value: two bits a sample in the samples' order or,
where that is shorter, four bytes for each sample that has a call. Variants are laid out in blocks of neighbours by position, and blocks that a window
reaches meet as pairs (tiles), where six matrix products give all counts and sums
over the samples that both variants have; of sparse blocks, over the samples that both
blocks have. What is shuffled is a few copies of the packed calls: in proportion to
calls, not to samples times pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assocframe.runtime import batches_of, has_rows, materialise, positions, release, sized_join

#: Variants of a block, and samples whose calls are unpacked at once.
BLOCK = 256
SAMPLES = 4096
#: Tiles that a Python worker gets at once.
TILES = 4
#: Ranks whose removals are decided in one task; two windows at least.
SPAN = 4096
_MISSING = 3
#: Bases in which variants are numbered.
_CELL = 1_000_000


def packed(dosages: DataFrame) -> DataFrame:
    """(SNPID, calls): samples are numbered in an order of their ids' hashes, calls are
    0, 1 or 2 (dosages are rounded). After a byte 0 come two bits for each sample, 3
    where there is no call; after a byte 1, four times the sample's number plus the call,
    for the samples that have one. Of several rows of a sample and variant the largest
    dosage counts."""
    known = dosages.where("dosage is not null").select("IID", "SNPID", F.round("dosage").cast("int").alias("call"))
    cells = known.select("IID").distinct().withColumn("_g", F.lit(0)).withColumn("_c", F.pmod(F.xxhash64("IID"), F.lit(256)))
    at = materialise(positions(cells, ["_g"], ["_c"], ["IID"], "_at").select("IID", (F.col("_at") - 1).cast("int").alias("_at")), "samples")
    n = at.count()
    lists = sized_join(known, at, ["IID"]).groupBy("SNPID").agg(F.array_sort(F.collect_list(F.struct("_at", "call"))).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_written(np.asarray(place.values), np.asarray(call.values), n) for place, call in zip(batch.column("place"), batch.column("call"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("SNPID"), pa.array(out, pa.binary())], names=["SNPID", "calls"])

    return lists.select("SNPID", F.col("v._at").alias("place"), F.col("v.call").alias("call")).mapInArrow(pack, "SNPID string, calls binary")


def _written(place: np.ndarray, call: np.ndarray, n: int) -> bytes:
    """The calls of one variant, by ascending place (of equal ones the last counts)."""
    if 4 * len(place) < -(-n // 4):
        last = np.append(np.diff(place) > 0, True)
        return b"\1" + (place[last].astype("<u4") << 2 | call[last].astype("<u4")).astype("<u4").tobytes()
    row = np.full(-(-n // 4) * 4, _MISSING, np.uint8)
    row[place] = call
    q = row.reshape(-1, 4)
    return b"\0" + (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).tobytes()


def _sparse(call: bytes) -> np.ndarray | None:
    return np.frombuffer(call, "<u4", offset=1) if call[0] else None


def _samples(calls: list[bytes]) -> np.ndarray | None:
    """The samples that have calls of these variants; None: it may be all."""
    found = [_sparse(c) for c in calls]
    return None if any(f is None for f in found) else np.unique(np.concatenate(found) >> 2)


def unpacked(calls: list[bytes], samples: np.ndarray) -> np.ndarray:
    """The calls of these samples (ascending), a row each."""
    out = np.full((len(calls), len(samples)), _MISSING, np.uint8)
    for row, c in zip(out, calls, strict=True):
        if (has := _sparse(c)) is None:
            row[:] = np.frombuffer(c, np.uint8, offset=1)[samples >> 2] >> ((samples & 3) << 1).astype(np.uint8) & 3
        else:
            has = has[np.searchsorted(has, samples[0] << 2) : np.searchsorted(has, (samples[-1] << 2) + 4)]
            spot = np.searchsorted(samples, has >> 2)
            there = samples[np.minimum(spot, len(samples) - 1)] == has >> 2
            row[spot[there]] = has[there] & 3
    return out


def _by_sample(a: list[bytes], b: list[bytes]) -> np.ndarray | None:
    """n and the sums of x, y, x squared, y squared and xy of all pairs of sparse
    variants, from the pairs of calls of a sample; None where products are cheaper."""
    calls = [[_sparse(c) for c in v] for v in (a, b)]
    if any(c is None for v in calls for c in v):
        return None
    flat = []
    for v in calls:
        call, of = np.concatenate(v).astype(np.int64), np.repeat(np.arange(len(v)), [len(c) for c in v])
        order = np.argsort(call >> 2, kind="stable")
        flat.append((call[order] >> 2, (call[order] & 3).astype(float), of[order]))
    (at, x, i), (other, y, j) = flat
    first = np.searchsorted(other, at)
    met = np.searchsorted(other, at, "right") - first
    pairs = int(met.sum())
    if pairs > len(a) * len(b) * 64:
        return None
    left = np.repeat(np.arange(len(at)), met)
    right = np.arange(pairs) + np.repeat(first - np.cumsum(met) + met, met)
    cell, x, y = i[left] * len(b) + j[right], x[left], y[right]
    return np.stack([np.bincount(cell, w, len(a) * len(b)).reshape(len(a), len(b)) for w in (np.ones(pairs), x, y, x * x, y * y, x * y)])


def _by_products(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The same by matrix products over the samples that both lists may have."""
    sums = np.zeros((6, len(a), len(b)))
    sets = [s for s in (_samples(a), _samples(b)) if s is not None]
    if sets:
        shared = sets[0] if len(sets) == 1 else np.intersect1d(*sets, assume_unique=True)
    else:
        shared = np.arange(4 * (len(next(c for c in a if not c[0])) - 1))
    shared = shared.astype(np.int64)
    for first in range(0, len(shared), SAMPLES):
        x, y = (unpacked(v, shared[first : first + SAMPLES]) for v in (a, b))
        has_x, has_y = ((v != _MISSING).astype(np.float32) for v in (x, y))
        x, y = x * has_x, y * has_y
        for k, (u, v) in enumerate(((has_x, has_y), (x, has_y), (has_x, y), (x * x, has_y), (has_x, y * y), (x, y))):
            sums[k] += u @ v.T  # whole numbers under 2**24, so exact
    return sums


def correlations(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Samples that have both calls, and r2 over them, of all pairs of two lists of
    variants; r2 is nan where one of them doesn't vary."""
    sums = _by_sample(a, b)
    if sums is None:
        sums = _by_products(a, b)
    n, sx, sy, sxx, syy, sxy = sums
    both = (n * sxx - sx * sx) * (n * syy - sy * sy)
    with np.errstate(invalid="ignore", divide="ignore"):
        return n.astype(np.int64), np.where(both > 0, (n * sxy - sx * sy) ** 2 / both, np.nan)


def ranked(places: DataFrame) -> DataFrame:
    """places (SNPID, CHR, POS) with the rank, from 0, in the order of position and
    id within the chromosome. No chromosome is sorted in one task."""
    cells = places.withColumn("_c", F.floor(F.col("POS") / _CELL))
    return positions(cells, ["CHR"], ["_c"], ["POS", "SNPID"], "rank").drop("_c").withColumn("rank", F.col("rank") - 1)


def _blocks(dosages: DataFrame, places: DataFrame) -> DataFrame:
    """A row for each block: (CHR, block, lo, hi, ids, at, ranks, calls)."""
    calls = materialise(packed(dosages), "calls")
    known = places.select("SNPID", "CHR", "POS").join(calls.select("SNPID"), "SNPID", "left_semi")
    rows = ranked(known).join(calls, "SNPID").withColumn("block", F.floor(F.col("rank") / BLOCK))
    v = F.array_sort(F.collect_list(F.struct("rank", "POS", "SNPID", "calls")))
    out = rows.groupBy("CHR", "block").agg(F.min("POS").alias("lo"), F.max("POS").alias("hi"), v.alias("v"))
    with batches_of(dosages.sparkSession, BLOCK):
        blocks = materialise(out.select("CHR", "block", "lo", "hi", F.col("v.SNPID").alias("ids"), F.col("v.POS").alias("at"), F.col("v.rank").alias("ranks"), F.col("v.calls").alias("calls")), "blocks")
    release(calls)
    return blocks


def _tiles(blocks: DataFrame, pairs: DataFrame, keep, least: float | None) -> DataFrame:
    """(CHR, s1, s2, rank1, rank2, n, r2) of the pairs of variants, in order, of the
    given pairs of blocks (CHR, b1, b2) that keep(at1, at2, rank1, rank2) lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, r2 = correlations(r["calls1"], r["calls2"])
                at1, at2, rank1, rank2 = (np.array(r[c], np.int64) for c in ("at1", "at2", "ranks1", "ranks2"))
                take = (rank1[:, None] < rank2) & (n > 0) & keep(at1[:, None], at2, rank1[:, None], rank2)
                if least is not None:
                    take &= r2 >= least
                i, j = np.nonzero(take)
                found = r2[i, j]
                cols = [pa.array([r["CHR"]] * len(i), pa.string()), pa.array(r["ids1"], pa.string()).take(pa.array(i)), pa.array(r["ids2"], pa.string()).take(pa.array(j)), pa.array(rank1[i]), pa.array(rank2[j]), pa.array(n[i, j]), pa.array(found, mask=np.isnan(found))]
                yield pa.RecordBatch.from_arrays(cols, names=["CHR", "s1", "s2", "rank1", "rank2", "n", "r2"])

    side = lambda k: blocks.select("CHR", F.col("block").alias(f"b{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("ids", "at", "ranks", "calls")])
    met = pairs.join(side(1), ["CHR", "b1"]).join(side(2), ["CHR", "b2"])
    with batches_of(blocks.sparkSession, TILES):
        return materialise(met.mapInArrow(run, "CHR string, s1 string, s2 string, rank1 long, rank2 long, n long, r2 double"), "tiles")


def by_distance(dosages: DataFrame, places: DataFrame, window: int, least: float | None = None) -> DataFrame:
    """(CHR, s1, s2, n, r2) of variants of a chromosome at most `window` bases apart
    that share a sample; with `least`, only of that r2 and more."""
    blocks = _blocks(dosages, places)
    # blocks begin in the order of their numbers; b2 begins in one of the bins that b1 reaches
    first = blocks.select("CHR", F.col("block").alias("b1"), F.col("hi"), F.explode(F.sequence(F.floor(F.col("lo") / window), F.floor(F.col("hi") / window) + 1)).alias("bin"))
    second = blocks.select("CHR", F.col("block").alias("b2"), F.col("lo"), F.floor(F.col("lo") / window).alias("bin"))
    pairs = first.join(second, ["CHR", "bin"]).where((F.col("b2") >= F.col("b1")) & (F.col("lo") <= F.col("hi") + window)).select("CHR", "b1", "b2")
    out = _tiles(blocks, pairs, lambda at1, at2, *_: at2 - at1 <= window, least)
    release(blocks)
    return out.select("CHR", "s1", "s2", "n", "r2")


def by_rank(dosages: DataFrame, places: DataFrame, window: int, step: int, least: float) -> DataFrame:
    """(CHR, s1, s2, rank1, rank2, n, r2) of variants that some window of so many
    variants holds; windows begin at every step-th one."""
    blocks = _blocks(dosages, places)
    far = -(-window // BLOCK)
    pairs = blocks.select("CHR", F.col("block").alias("b1"), F.explode(F.sequence(F.col("block"), F.col("block") + far)).alias("b2"))
    out = _tiles(blocks, pairs, lambda _1, _2, rank1, rank2: rank2 < rank1 // step * step + window, least)
    release(blocks)
    return out


def prune(dosages: DataFrame, places: DataFrame, window: int = 200, step: int = 50, r2: float = 0.25) -> DataFrame:
    """(CHR, SNPID) of the variants that stay when windows of `window` variants slide
    by `step` along each chromosome. In a window pairs are taken in order; of one
    above r2 whose variants both still stand, that of the lower minor allele
    frequency goes, the later one where these are equal.

    A pair is judged in the first window that holds it, so the walk is a list of
    pairs in the order (window, first, second), each of which removes a known one of
    its variants if both stand. Tasks decide the pairs of SPAN ranks; what hangs on
    ranks beyond waits for the next round, whose spans are shifted by half of one. The
    first pair that waits is decided in this round or the next, so rounds end; two or three do where
    chains of pairs that wait for each other are shorter than half a span."""
    d = F.col("dosage")
    maf = dosages.where(d.isNotNull()).groupBy("SNPID").agg((F.avg(d) / 2).alias("f")).select("SNPID", F.least("f", 1 - F.col("f")).alias("maf"))
    linked = by_rank(dosages, places, window, step, r2).where(F.col("r2") > r2)
    first = F.greatest(F.lit(0), F.floor((F.col("rank2") - window) / step) + 1)  # the first window that reaches rank2
    m1, m2 = (maf.select(F.col("SNPID").alias(f"s{k}"), F.col("maf").alias(f"m{k}")) for k in (1, 2))
    loses = F.when(F.col("m1") < (1 - 1e-9) * F.col("m2"), F.col("rank1")).otherwise(F.col("rank2"))
    pairs = materialise(linked.join(m1, "s1").join(m2, "s2").select("CHR", first.alias("win"), "rank1", "rank2", loses.alias("loses")), "pairs")
    gone, rounds, span = [], 0, max(SPAN, 2 * window)  # so that each pair lies within a span of one shift or the other
    while has_rows(pairs):
        said = materialise(_decide(pairs, span, (rounds % 2) * (span // 2)), "round")
        now = said.where("removed is not null").select("CHR", F.col("removed").alias("rank"), "win", "rank1", "rank2")
        gone.append(now.select("CHR", "rank"))
        rest = said.where("removed is null").drop("removed")
        for c in ("rank1", "rank2"):  # a pair is void if one of it has gone before its turn
            by = now.select("CHR", F.col("rank").alias(c), F.struct("win", "rank1", "rank2").alias("_when"))
            rest = rest.join(by, ["CHR", c], "left").where(F.col("_when").isNull() | (F.struct("win", "rank1", "rank2") <= F.col("_when"))).drop("_when")
        pairs, last = materialise(rest.select("CHR", "win", "rank1", "rank2", "loses"), "pairs"), pairs
        release(last)
        rounds += 1
    known = ranked(places.select("SNPID", "CHR", "POS").join(dosages.where(d.isNotNull()).select("SNPID").distinct(), "SNPID", "left_semi"))
    for g in gone:
        known = known.join(g, ["CHR", "rank"], "left_anti")
    return known.select("CHR", "SNPID")


def _decide(pairs: DataFrame, size: int, shift: int) -> DataFrame:
    """Of each span of ranks: the removals that are certain, and the pairs that
    aren't decided, given by the span of their first variant."""
    span = lambda c: F.floor((F.col(c) + shift) / size)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        own = int(rows["span"].iloc[0])
        out, dead, unsure = [], set(), set()
        for c, w, i, j, loses in rows.sort_values(["win", "rank1", "rank2"])[["CHR", "win", "rank1", "rank2", "loses"]].itertuples(index=False):
            if i in dead or j in dead:
                continue
            mine = [(x + shift) // size == own for x in (i, j)]
            if all(mine) and i not in unsure and j not in unsure:
                dead.add(loses)
                out.append((c, w, i, j, loses, loses))
            else:
                unsure.add(loses)
                if mine[0]:
                    out.append((c, w, i, j, loses, None))
        return pd.DataFrame(out, columns=["CHR", "win", "rank1", "rank2", "loses", "removed"]).astype({"removed": "Int64"})

    both = pairs.withColumn("span", F.explode(F.array_distinct(F.array(span("rank1"), span("rank2")))))
    return both.groupBy("CHR", "span").applyInPandas(walk, "CHR string, win long, rank1 long, rank2 long, loses long, removed long")


def clump(stats: DataFrame, ld: DataFrame, p1: float = 1.0, r2: float = 0.1, p2: float = 1.0) -> DataFrame:
    """Index variants (CHR, SNPID, P, members): in the order of P and id, a variant of
    P <= p1 stands unless it is linked to one that stands. Members are the variants of
    P <= p2 that are linked to an index and to none before it.

    The order isn't walked: in each round every variant that comes before all that it
    is linked to stands, and those linked to it fall; what is left goes to the next
    round, about the logarithm of the number of variants of them."""
    # one row for an id: its least P
    rows = stats.where(F.col("P").isNotNull()).groupBy("SNPID").agg(F.min(F.struct("P", "CHR")).alias("_m")).select("_m.CHR", "SNPID", "_m.P")
    index = rows.where(F.col("P") <= p1)
    order = lambda k, df: df.select(F.col("SNPID").alias(f"s{k}"), F.struct("P", "SNPID").alias(f"o{k}"))
    close = ld.where(F.col("r2") >= r2).select(F.explode(F.array(F.struct("s1", "s2"), F.struct(F.col("s2").alias("s1"), F.col("s1").alias("s2")))).alias("e")).select("e.*").distinct()
    close = materialise(close, "close")
    links = materialise(close.join(order(1, index), "s1").join(order(2, index), "s2"), "links")
    fallen = []
    while has_rows(links):
        won = materialise(links.groupBy("s1", "o1").agg(F.min("o2").alias("m")).where("o1 < m").select("s1"), "won")
        lost = materialise(sized_join(links, won, ["s1"], "left_semi", ["s2"]).select(F.col("s2").alias("s1")).distinct(), "lost")
        out = materialise(won.unionByName(lost), "out")
        rest = sized_join(links, out, ["s1"], "left_anti")
        rest, last = materialise(sized_join(rest, out.withColumnRenamed("s1", "s2"), ["s2"], "left_anti"), "links"), links
        release(last, out)
        fallen.append(lost)
        links = rest
    release(links)
    found = index
    for f in fallen:
        found = found.join(f.withColumnRenamed("s1", "SNPID"), "SNPID", "left_anti")
    found = materialise(found, "index")
    of = order(1, found).join(close, "s1").join(rows.where(F.col("P") <= p2).select(F.col("SNPID").alias("s2")), "s2")
    claimed = of.join(found.select(F.col("SNPID").alias("s2")), "s2", "left_anti").groupBy("s2").agg(F.min("o1").alias("o"))
    members = claimed.groupBy(F.col("o.SNPID").alias("SNPID")).agg(F.count(F.lit(1)).alias("members"))
    return found.join(members, "SNPID", "left").select("CHR", "SNPID", "P", F.coalesce("members", F.lit(0)).cast("long").alias("members"))
