"""Ranked search against the formula over all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SCHEMA

from assocframe.llm import ranked_search as rs
from assocframe.runtime import ship

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def terms(t):
    return TERM.findall((t or "").translate(LOW))


def plain(docs, items, k):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for d in docs for t in d[1])
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in asked.items():
        found = []
        for d, c, length in docs:
            m = 50 + 50 * length * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score:
                found.append((-score, d is None, d or 0, d))
        found.sort(key=lambda x: x[:3])
        out += [(i, r + 1, f[3], -f[0]) for r, f in enumerate(found[:k])]
    return Counter(out)


def found(docs, items, k, **kw):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in rs.search(docs, items, k, **kw).collect())


@pytest.mark.parametrize("k, owners", [(3, 1), (10, 4), (200, 7)])
def test_against_all_pairs(spark, monkeypatch, k, owners):
    """Common and rare terms, ties, repeated and null ids; shards of a few rows and
    more than one block and bundle."""
    monkeypatch.setattr(rs, "PAIRS", 150)
    monkeypatch.setattr(rs, "ITEMS", 16)
    rng = random.Random(k)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(2000)]
    docs = [(rng.choice([None, *range(150)]), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for _ in range(300)]
    docs += docs[:20]
    items = [(rng.choice([None, *range(40)]), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 12)))) for _ in range(50)]
    a = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in docs], SCHEMA).repartition(6)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert found(a, b, k, owners=owners) == plain(docs, items, k)


def test_odd_rows(spark, odd):
    items = [(1, "one TWO word"), (2, None), (3, ""), (4, "é ünï " + "é" * 50), (5, "no term of any document"), (6, "Line of words HERE x")]
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    asked = spark.createDataFrame([(i, t, 7, "z") for i, t in items], "item_id long, text string, score int, rank string")
    assert found(odd, asked, 50) == plain(docs, items, 50)


def test_items_with_text_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id int, text string")
    items = spark.createDataFrame([("x", "a"), (None, "b c")], "item_id string, text string")
    assert found(docs, items, 5) == plain([(1, "a b"), (2, "b c")], [("x", "a"), (None, "b c")], 5)


def test_empty(spark, empty):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert not found(empty, items, 5)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert not found(docs, items.limit(0), 5)
    assert not found(docs, items, 5)


def test_owners_get_rare_terms_first_and_equal_shares():
    df = np.array([1, 100, 2, 50, 48, 1, 0])
    owner = rs.owners_of(df, 2)
    assert owner.tolist() == [0, 1, 0, 0, 0, 0, 0]
    assert rs.owners_of(np.zeros(0, np.int64)).tolist() == []
