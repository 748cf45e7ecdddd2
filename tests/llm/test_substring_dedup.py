"""Substring dedup against a plain version."""

import random
from collections import Counter

import numpy as np
import pytest
from conftest import SCHEMA, prose
from test_operators import words

from assocframe.llm import substring_dedup as sd
from assocframe.runtime import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def plain(rows, window):
    least = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if i is not None:
                least[k] = min(least.get(k, i), i)
    out = Counter()
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and least[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out[i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)] += 1
    return out


def found(docs, window=13):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in sd.dedup(docs, window).collect())


def test_covers_have_every_difference():
    for v, cover in sd.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    assert sd.cover_of(13) == (7, (0, 1, 3)) and sd.cover_of(1) == (1, (0,)) and sd.cover_of(50)[0] == 21


@pytest.mark.parametrize("window", [1, 2, 5, 13, 30])
def test_passages_at_all_shifts(spark, window):
    """Passages from one word short of a window to three windows, planted at every
    residue of the period, some twice in one document, some by two smaller ones."""
    rng = random.Random(window)
    passages = [prose(rng, n).split() for n in (max(1, window - 1), window, window + 1, 2 * window, 3 * window)]
    rows = []
    for i in range(120):
        w = prose(rng, rng.randrange(0, 40)).split()
        for p in rng.sample(passages, rng.randrange(0, 4)):
            at = rng.randrange(len(w) + 1)
            a = rng.randrange(len(p))
            w[at:at] = p[a:] if rng.random() < 0.3 else p
        rows.append((rng.randrange(100) if i % 10 else None, " ".join(w)))
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).repartition(5)
    assert found(docs, window) == plain(rows, window)


def test_odd_rows(odd):
    assert found(odd) == plain([(r.doc_id, r.text) for r in odd.collect()], 13)


def test_empty(empty):
    assert not found(empty)


def test_a_passage_of_most_documents(spark):
    """Its questions are one for each task, whatever the number of documents."""
    rng = random.Random(2)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 20) + " " + passage + " " + prose(rng, 20)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    got = found(docs.repartition(7))
    assert got == plain(rows, 13) and sum(k[2] for k in got) >= 599 * 60


def test_a_task_settles_what_it_knows():
    h, ids = np.array([5, 5, 5, 9, 9, 7], np.uint64), np.array([3, 1, 2, 4, 4, 8])
    none, part = np.zeros(6, np.uint64), np.array([0, 0, 0, 1, 2, 0])
    flag, low, _, who, _ = sd.settled(h, none, ids, part, smaller=True)
    assert sorted(zip(flag.tolist(), low.tolist(), who.tolist(), strict=True)) == [(0, 5, 1), (0, 7, 8), (0, 9, 4), (0, 9, 4), (2, 5, 2), (2, 5, 3)]
    flag, low, _, who, _ = sd.settled(h, none, ids, part, smaller=False)
    assert sorted(zip(flag.tolist(), low.tolist(), who.tolist(), strict=True)) == [(0, 7, 8), (0, 9, 4), (0, 9, 4), (1, 5, 1), (2, 5, 1), (2, 5, 2), (2, 5, 3)]
