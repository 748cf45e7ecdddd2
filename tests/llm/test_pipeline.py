"""The pipeline's stages against brute force."""

import random

import pytest
from conftest import SCHEMA, prose
from test_operators import sets_of

import corpus_pipeline as p
from assocframe.llm.queries import vocabulary_path
from assocframe.runtime import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def likeness(a, b):
    return len(a & b) / len(a | b)


def test_near_copies_by_five_words_and_four_fifths(spark):
    """Copies with words changed one by one or with text appended, on both sides
    of 0.8; among them pairs that three words and 0.9 don't link."""
    rng = random.Random(11)
    texts = {}
    for i in range(12):
        base = prose(rng, 400)
        texts[100 * i] = base
        for k, n in enumerate((2, 6, 8, 12, 20)):
            w = base.split()
            for at in rng.sample(range(400), n):
                w[at] = f"new{i}x{at}"
            texts[100 * i + 1 + k] = " ".join(w)
        for k, n in enumerate((30, 60, 90, 130)):
            texts[100 * i + 11 + k] = base + " " + prose(rng, n)
    fives, threes = ({i: sets_of(t, n) for i, t in texts.items()} for n in (5, 3))
    ids = sorted(texts)
    label = {i: i for i in ids}
    between = 0
    for i in ids:
        for j in ids:
            if i < j and likeness(fives[i], fives[j]) >= 0.8:
                between += likeness(threes[i], threes[j]) < 0.9
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    assert between > 20
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], SCHEMA)
    got = sorted(r.doc_id for r in p.near(spark, docs, "").collect())
    assert got == [i for i in ids if label[i] == i]


def test_the_last_stage_returns_the_ids(spark, odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    texts = [r.text or "" for r in odd.select("text").collect()]
    want = sorted(lib.encode(t, add_special_tokens=False).ids for t in texts)
    rows = p.STAGES[-1][1](spark, odd, "").collect()
    assert sorted(list(r.ids) for r in rows) == want
    assert all(len(r.ids) == r.n_tokens for r in rows)


def test_the_corpus_has_ids(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    assert "ids" in p.corpus(spark, str(tmp_path)).columns
