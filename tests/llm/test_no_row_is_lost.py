"""Rows in and rows out, with null and repeated ids, and columns with clashing names."""

import random
from collections import Counter

import pytest
from conftest import SCHEMA, prose

from assocframe.llm import chat, exact_dedup, quality_rules, sharding
from assocframe.runtime import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def test_shards_have_every_row(spark, odd, tmp_path):
    clash = odd.selectExpr("*", "1 slot", "'x' shard", "2 law", "3 hilbert", "4 text_crc32", "5 _at", "6 _row")
    sharding.write(clash, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    plain = lambda df: Counter((r.doc_id, r.text, r.text_crc32, r._at, r.lang) for r in df.collect())
    assert plain(back) == plain(clash)
    assert {r.shard for r in back.select("shard").distinct().collect()} <= set(range(16))


def test_counts_may_carry_any_name(odd):
    names = ["scale", "m_0", "_e", "e0", "l_0_0", "g1", "_c", "_far"]
    docs = odd.selectExpr("*", *[f"'{c}' `{c}`" for c in names])
    found = quality_rules.quality(docs, carry=["text", *names])
    kept = [c for c in names if c in found.columns]
    assert "scale" in kept and "m_0" in kept and "_e" in kept
    assert all(r[c] == c for r in found.collect() for c in kept)
    want = Counter((r.doc_id, r.kept) for r in quality_rules.quality(odd).collect())
    assert Counter((r.doc_id, r.kept) for r in found.collect()) == want


def test_turns_keep_other_columns(spark):
    df = spark.sql("select 1 _parts, 2 _parts_, array(named_struct('role', 'user', 'text', 'hi')) turns")
    r = chat.format_turns(df).first()
    assert (r._parts, r._parts_) == (1, 2) and "hi" in r.formatted


def test_the_same_equal_row_stays_however_rows_are_dealt(spark):
    rows = [(5, "same text", lang, "a", 1) for lang in ("en", "de", "fr")] + [(4, "same text", "en", "a", 1)]
    found = {exact_dedup.keep(spark.createDataFrame(rows[k:] + rows[:k], SCHEMA).repartition(n)).collect()[0].lang for k in range(4) for n in (1, 3)}
    assert len(found) == 1


def test_near_copies_by_row_not_by_id(spark):
    import corpus_pipeline as p

    rng = random.Random(3)
    a, other, third = prose(rng, 300), prose(rng, 300), prose(rng, 300)
    rows = [(1, a), (2, a + " tail"), (2, other), (3, other + " more"), (None, a), (7, third), (7, third + " x"), (7, "short")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    got = Counter((r.doc_id, r.text) for r in p.near(spark, docs, "").collect())
    assert {k: v for k, v in got.items() if k[0] != 7} == {(1, a): 1, (2, other): 1, (None, a): 1}
    assert sum(v for k, v in got.items() if k[0] == 7) == 2 and (7, "short") in got
