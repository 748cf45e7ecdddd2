"""The prefix trie against a walk over all prefixes."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import words

from assocframe.llm import prefix_trie as pt
from assocframe.llm.queries import rebuilt
from assocframe.runtime import ship

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def key(role, text):
    return role or "", text or ""


def name(role, text):
    role, text = key(role, text)
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def in_order(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, name(role, text), key(role, text)))
    return {c: [t[-1] for t in sorted(ts)] for c, ts in convs.items()}


def plain(convs):
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = Counter()
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * (len(words(q[-1][1])) if q else 0) for q in under)
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out[min(cs), len(p), parent, len(cs), kids[p], sum(not kids[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def found(df):
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return Counter(tuple(r[c] for c in cols) for r in pt.trie(df).collect())


def made(rng, n):
    """Conversations that share beginnings, many of them whole, with nulls, ties,
    repeated rows and empty texts."""
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 6)):
            rows.append((c - 30 if rng.random() < 0.98 else None, rng.choice([t, t, t, 0, None]), rng.choice(["user", None]), rng.choice(["a b", "c", "", None, f"own {rng.randrange(40)} x"])))
    return rows + rows[:10]


def test_against_a_walk(spark):
    rows = made(random.Random(4), 150)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", digest int, depth int").repartition(5)
    assert found(pt.turn_digests(df)) == plain(in_order(rows))


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    """When nothing is proved to be a singleton, all goes the exact way."""
    rows = made(random.Random(5), 40)
    turns = pt.turn_digests(spark.createDataFrame(rows, SCHEMA))
    monkeypatch.setattr(pt, "sketch", lambda chains, cells: [np.full(max(cells, pt.CHUNK) // 8, 255, np.uint8)] * pt.HASHES)
    assert found(turns) == plain(in_order(rows))


def test_rebuilt_conversations(spark):
    rows = [r for r in made(random.Random(6), 120) if r[0] not in (20, 40)]
    own = in_order(rows)
    want = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        want[c] = own.get(base, [])[:h] + ts[h:]
    assert any(not ts for ts in want.values())
    assert found(rebuilt(pt.turn_digests(spark.createDataFrame(rows, SCHEMA)))) == plain(want)


def test_only_turnless_and_empty(spark):
    turns = pt.turn_digests(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))
    assert not found(turns)
    none = spark.createDataFrame([(7, None, None, 0), (3, None, None, 0)], "conv_id long, turn long, digest binary, words long")
    assert found(none) == plain({7: [], 3: []})


def test_the_sketch_never_counts_too_few(spark):
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 255, (300, 16), np.uint8)
    rows = [(i, 3, 0, digests[i % 100].tobytes() + digests[100 + i].tobytes() + digests[99 - i % 100].tobytes(), b"") for i in range(200)]
    bits = pt.sketch(spark.createDataFrame(rows, "conv_id long, n_turns long, total long, digests binary, words binary").repartition(3), 4096)
    shared = np.logical_and.reduce([np.unpackbits(b)[c] for b, c in zip(bits, pt.cells_of(digests.ravel(), 4096), strict=True)])
    assert shared[:100].all() and shared[100:].mean() < 0.05
