"""Each operator against a brute-force version, on rows with every odd case, on
an empty table and on the small tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from compare import rows_of, rows_of_sql
from pyspark.sql import functions as F

from assocframe.llm import bpe, chat, exact_dedup, mixing, ngram_join, ordinal, quality_classifier, quality_rules, queries, sharding, text, token_rollup, toxicity
from assocframe.runtime import ship

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def prose(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "epsilon", "zeta")) + str(rng.randrange(400)) for _ in range(n))


def words(t):
    return WORD.findall(t or "")


# quality rules


def counts(t):
    w, t = words(t), t or ""
    seen = defaultdict(list)
    for k in range(len(w) - 7):
        seen[tuple(w[k : k + 8])].append(k)
    covered = {p for v in seen.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(odd):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.rules(odd).collect())
    want = Counter((r.doc_id, *(c := counts(r.text)), c[0] < 20 or 100 * c[4] > 30 * c[0]) for r in odd.collect())
    assert got == want


def test_outliers_are_rejected_and_others_kept(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        t = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(60, 400)))
        if i % 20 == 0:
            t = " ".join(x + "###" for x in t.split())
        rows.append((i, t, "en", "a" if i % 2 else None, 1))
    found = quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), least=50)
    kept = {r.doc_id: r.kept for r in found.collect()}
    assert all(kept[i] == (i % 20 != 0) for i in range(600))


def test_estimate_is_the_least_determinant(spark):
    """The centre and the scatter of the chosen share are those that numpy finds
    by the same steps without bins."""
    rng = np.random.default_rng(1)
    x = rng.normal([5, 1.5, 0.1, 0.1, 0.1], [0.5, 0.2, 0.3, 0.2, 0.1], (2000, 5))
    x[:200] += 4
    df = spark.createDataFrame([(*map(float, v), "l", "s", i) for i, v in enumerate(x)], [*quality_rules.STATISTICS, "g1", "g2", "doc_spread"])
    e = quality_rules.estimate(df, steps=6).where("level = 2").first()
    floor = np.diag(np.array(list(quality_rules.STATISTICS.values())) ** 2)
    m, c = np.median(x, axis=0), np.diag((1.4826 * np.median(np.abs(x - np.median(x, axis=0)), axis=0)) ** 2) + floor
    for _ in range(20):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        h = x[np.argsort(d)[:1500]]
        m, c = h.mean(axis=0), np.cov(h.T, bias=True) + floor
    low = np.linalg.cholesky(c)
    assert np.allclose([e[f"m_{i}"] for i in range(5)], m, atol=0.02)
    assert np.allclose([e[f"l_{i}_{i}"] for i in range(5)], np.diag(low), atol=0.03)


def test_quality_on_no_rows(empty, odd):
    assert quality_rules.quality(empty).count() == 0
    assert quality_rules.quality(odd).count() == odd.count()


# BPE


def test_bpe_is_the_library(odd):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    lib = Tokenizer.from_file(path)
    want = Counter()
    for r in odd.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digests(odd, path).collect()) == want
    full = bpe.decode(bpe.encode(odd, path), path).collect()
    assert all(r.decoded == (r.text or "") for r in full) and len(full) == sum(want.values())


def test_bpe_on_no_rows(empty):
    assert bpe.digests(empty, queries.vocabulary_path()).count() == 0


def test_bpe_of_odd_characters():
    from tokenizers import Tokenizer

    path, rng = queries.vocabulary_path(), random.Random(2)
    lib, e = Tokenizer.from_file(path), bpe.Encoder(bpe.vocabulary(path))
    texts = ["".join(rng.choice("aab 'sS\n\t\x1c\x85 ​é漢字🙂1٣!.<|>") for _ in range(60)) for _ in range(300)] + ["a" * 999, "퟿"]
    ids, at = e.encode(texts)
    for k, x in enumerate(lib.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == x.ids


def test_bpe_of_long_words():
    import string
    import time

    from tokenizers import Tokenizer

    path, rng = queries.vocabulary_path(), random.Random(7)
    lib, v = Tokenizer.from_file(path), bpe.vocabulary(path)
    words = ["".join(rng.choice(alphabet) for _ in range(n)) for alphabet, n in (("a", 999), ("ab", 2000), (string.ascii_letters, 5000), (string.ascii_letters + string.digits + "+/", 1_000_000))]
    bpe.Encoder(v).encode(["warm"])
    began = time.perf_counter()
    ids, at = bpe.Encoder(v).encode([*words, "short words too"])
    took = time.perf_counter() - began
    began = time.perf_counter()
    for k, w in enumerate([*words, "short words too"]):
        assert ids[at[k] : at[k + 1]].tolist() == lib.encode(w, add_special_tokens=False).ids
    assert took < 10 * (time.perf_counter() - began) + 1


# n-gram join


def sets_of(t, n=3):
    w = words((t or "").translate(LOW))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked(a, b, t=90):
    return bool(a and b) and 100 * len(a & b) >= t * len(a | b)


def test_join_finds_all_components(odd):
    docs = odd.where("doc_id is not null")
    sets = {r.doc_id: sets_of(r.text) for r in docs.collect()}
    ids, up = sorted(sets), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and linked(sets[i], sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in ids}
    assert ngram_join.jaccard_components(odd).count() == odd.count()


def test_links_are_all_pairs_of_classes(odd):
    docs = odd.where("doc_id is not null")
    links, members = ngram_join.jaccard_links(docs)
    sets = {r.doc_id: sets_of(r.text) for r in docs.collect()}
    classes = sorted({r["class"] for r in members.collect()})
    want = {(i, j) for i in classes for j in classes if i < j and linked(sets[i], sets[j])}
    assert {(r.a, r.b) for r in links.collect()} == want and want


def test_signatures_are_shared_by_close_sets():
    rng = np.random.default_rng(4)
    for size in (10, 11, 19, 40, 200, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            k = 2 * len(a) * 10 // 190 // 2
            b = np.unique(np.concatenate([a[: len(a) - k], rng.integers(0, 2**63, k).astype(np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)) and k:
                sig, owner = ngram_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 90)
                assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


def components_of(sets, t):
    ids, up = sorted(sets), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if linked(sets[i], sets[j], t):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}


def family(rng, n, words, edits, vocabulary=4000):
    """Texts that differ from one base in up to so many words each."""
    base, out = [f"w{rng.randrange(vocabulary)}" for _ in range(words)], []
    for _ in range(n):
        w = list(base)
        for k in rng.sample(range(words), rng.randrange(edits + 1)):
            w[k] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("tile", [512, 16])
@pytest.mark.parametrize(("n", "t"), [(5, 80), (3, 90)])
def test_large_groups_near_the_threshold(spark, monkeypatch, tile, n, t):
    """A family most of whose pairs lie just under or over the threshold, in one
    tile and in many; tiles give at most a row for each of their sets."""
    rng = random.Random(13)
    texts = family(rng, 220, 150, 9) + family(rng, 120, 60, 3) + [prose(rng, 80) for _ in range(100)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    sent = []
    links = ngram_join.Join._compared

    def counted(self, rows, tag):
        out = links(self, rows, tag)
        sent.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(ngram_join.Join, "_compared", counted)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, n, t).collect()}
    assert got == components_of({i: sets_of(x, n) for i, x in enumerate(texts)}, t)
    assert all(out <= rows for rows, out in sent)
    assert len(sent) == (1 if tile == 512 else 2)


def test_signatures_of_many_sets_in_one_task(spark, monkeypatch):
    """More sets of a task share a signature than HOT: they go under its name."""
    rng = random.Random(17)
    texts = family(rng, 260, 80, 2) + [prose(rng, 70) for _ in range(30)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").coalesce(1)
    rows = ngram_join._signed(docs, "text", 5, 80, 512).where("hot is not null")
    assert rows.count() > 0 and rows.where("length(sigs) > 0").count() * 2 == rows.count()
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, 5, 80).collect()}
    assert got == components_of({i: sets_of(x, 5) for i, x in enumerate(texts)}, 80)


@pytest.mark.parametrize(("n", "t", "most"), [(3, 90, 1500), (5, 80, 6000)])
def test_unrelated_small_sets_share_few_signatures(n, t, most):
    """20,000 sets of 19 shingles with nothing in common: few share a signature,
    and no signature is shared by many."""
    rng = np.random.default_rng(3)
    sets = np.sort(rng.integers(0, 2**63, (20_000, 19)).astype(np.uint64), axis=1).ravel()
    sig, owner = ngram_join.signatures(sets, np.arange(20_001) * 19, t)
    _, count = np.unique(sig, return_counts=True)
    assert count[count > 1].sum() <= most and count.max() <= 12
    assert len(sig) <= 40 * 20_000


def test_signatures_of_poor_sets():
    """Small sets at the threshold, many of whose cells are empty, share one."""
    rng = np.random.default_rng(5)
    for size in range(5, 60):
        for t in (80, 90):
            k = (100 - t) * size // 100
            for _ in range(40 if k else 0):
                a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
                b = np.sort(a[rng.permutation(size)[: size - k]])
                sig, owner = ngram_join.signatures(np.concatenate([a, b]), np.array([0, size, 2 * size - k]), t)
                assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())


@pytest.mark.parametrize("t", [50, 80, 90])
def test_sketches_rule_out_no_link(monkeypatch, t):
    """Each set that links with another one is left by its sketch, of whatever
    sizes; few of those with nothing in common are."""
    monkeypatch.setattr(ngram_join, "_WORDS", 64)
    rng = np.random.default_rng(11)
    sets = []
    for size in (1, 5, 9, 33, 140, 141, 900):
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        for lost in range(0, (100 - t) * size // 100 + 1, max(1, size // 30)):
            sets.append(np.unique(base[: size - lost]))
            sets.append(np.unique(np.append(base[lost // 2 :], rng.integers(0, 2**63, lost // 2).astype(np.uint64))))
    alone = [np.unique(rng.integers(0, 2**63, size).astype(np.uint64)) for size in (200, 210, 400, 800, 1000)]
    sets = [sets[i] for i in rng.permutation(len(sets))] + alone
    at = np.append(0, np.cumsum([len(x) for x in sets]))
    raw = ngram_join.sketches(np.concatenate(sets), at, t)
    near = ngram_join.has_near(np.arange(len(sets)), np.diff(at), raw, t)
    for i, a in enumerate(sets):
        linked_ = any(100 * len(np.intersect1d(a, b)) >= t * len(np.union1d(a, b)) for j, b in enumerate(sets) if j != i)
        assert near[i] or not linked_
    assert not near[-len(alone) :].any()
    # rows of one node alone aren't near
    assert not ngram_join.has_near(np.array([7, 7]), np.diff(at)[[0, 0]], [raw[0], raw[0]], t).any()


def test_join_on_no_rows(empty):
    assert ngram_join.jaccard_components(empty).count() == 0


def test_words_in_arrays():
    import pyarrow as pa

    texts = ["a b", "", None, "  x", "é\x0by ", "\n"]
    data, at = text.buffers(pa.array(texts))
    s, e, first = text.word_spans(data, at)
    raw = data.tobytes()
    assert [[raw[s[i] : e[i]].decode() for i in range(first[k], first[k + 1])] for k in range(len(texts))] == [words(t) for t in texts]


# toxicity and quality


def made_labels(spark, n=900, seed=1):
    rng = random.Random(seed)
    clean = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randrange(30, 200))]
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            w[3 : 3 + rng.randrange(1, 4)] = rng.sample(["scoundrel", "blackguard", "villain"], 3)[: rng.randrange(1, 4)]
        if bad:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "en", "a", 1))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels, known = made_labels(spark)
    model = toxicity.train(docs, labels.where("doc_id < 600"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(i, t) for i, _, t in known if i >= 600]
    assert sum(got[i].toxic == bool(t) for i, t in held) >= 0.97 * len(held)
    assert (np.diff(model.thresholds) >= 0).all()
    assert all(0 <= r.severity <= 3 and math.isfinite(r.severity) for r in got.values())


def test_quality_on_held_out_rows(spark):
    docs, labels, known = made_labels(spark, seed=2)
    got = {r.doc_id: r for r in quality_classifier.score(docs, quality_classifier.train(docs, labels.where("doc_id < 600"))).collect()}
    held = [(i, q) for i, q, _ in known if i >= 600]
    assert sum(got[i].kept == bool(q) for i, q in held) >= 0.97 * len(held)
    assert all(r.p_good >= r.p_best - 1e-9 for r in got.values())


def test_models_on_odd_rows(spark, odd, empty):
    docs, labels, _ = made_labels(spark, 200)
    none = labels.limit(0)
    for train, score in ((toxicity.train, toxicity.score), (quality_classifier.train, quality_classifier.score)):
        m = train(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (7, None, None), (10**9, 1, 0)], labels.schema)))
        assert score(odd, m).count() == odd.count() and score(empty, m).count() == 0
        m = train(docs, none)
        assert score(odd, m).count() == odd.count()
        assert train(empty, labels) is not None


def test_derivatives_of_the_likelihood():
    rng = np.random.default_rng(0)
    theta, score, grades = np.array([-1.0, 0.5]), rng.normal(size=50), rng.integers(0, 3, 50)
    slope, bend = ordinal._derivatives(theta, score, grades)

    def at(s):
        up, lo = (1 / (1 + np.exp(-(np.append(theta, np.inf)[grades] - s))), 1 / (1 + np.exp(-(np.append(-np.inf, theta)[grades] - s))))
        return np.log(up - lo)

    h = 1e-5
    assert np.allclose(slope, (at(score + h) - at(score - h)) / (2 * h), atol=1e-6)
    assert np.allclose(bend, -(at(score + 1e-4) - 2 * at(score) + at(score - 1e-4)) / 1e-8, atol=1e-4)


# mixing


def as_duck(df):
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    return con


def test_mix_is_the_sql(odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", [tuple(r) for r in docs.collect()])
    assert rows_of(got) == rows_of_sql(con, mixing.ORACLE_SQL)


def test_targets_fill_up_by_weight(spark):
    rng = random.Random(9)
    for _ in range(5):
        sizes = [(f"s{i:02d}" if i else None, rng.choice([0, 1, 5, 50, 1000, 20000])) for i in range(rng.randrange(1, 9))]
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(order)}
        bound, left, free = {s: 3 * n for s, n in sizes}, float(sum(n for _, n in sizes)), {s for s, _ in sizes}
        want = {}
        while free:
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = {s for s in free if share[s] > bound[s] * (1 + 1e-12)}
            if not over:
                want |= share
                break
            for s in over:
                want[s] = float(bound[s])
                left -= bound[s]
            free -= over
        assert all(got[s] == pytest.approx(want[s], abs=1e-6) for s in want)


def test_mix_comes_near_and_repeats(spark, empty):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(0, 200), "en", rng.choice("aaaaab"), 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    first, again = mixing.mix(docs).collect(), mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))
    taken, target = Counter(), {}
    for r in first:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 300 for s in target)
    assert mixing.mix(empty).count() == 0
    with_text = mixing.mix(docs, carry=docs.columns)
    assert with_text.agg(F.sum("taken")).first()[0] == sum(taken.values()) and "text" in with_text.columns


def test_mix_of_clashing_names(odd):
    docs = odd.withColumns({"copies": F.lit(1), "position": F.lit(2), "m": F.create_map(F.lit("k"), F.lit(1))})
    got = mixing.mix(docs, carry=[*docs.columns])
    assert "m" in got.columns and len(set(got.columns)) == len(got.columns)
    key = lambda df: Counter(map(tuple, df.select("doc_id", "size", "taken").collect()))
    assert key(got) == key(mixing.mix(odd))


# exact dedup


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_dedup_is_brute_force(odd, bits, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SIEVE_BITS", bits)
    groups = defaultdict(list)
    for r in odd.collect():
        groups[(r.text or "").translate(LOW)].append(r.doc_id)
    got = exact_dedup.dedup(odd, columns={"text_sha256": exact_dedup.digest(F.col("text"))}).collect()
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert len(by) == len(groups) and len(got) == odd.count()
    for t, ids in groups.items():
        rows = by[hashlib.sha256(t.encode()).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))
        assert all(r.keep_id == best and r.group_size == len(ids) for r in rows)
        assert [r.doc_id for r in rows if r.kept] == [best]
    assert exact_dedup.keep(odd).count() == len(groups) and exact_dedup.keep(odd).columns == odd.columns


def test_each_stage_reads_fewer_rows(spark):
    rng = random.Random(4)
    texts = ["x" * n for n in range(1, 400)] + ["Abc " + prose(rng, 40)[:300] for _ in range(300)] + ["a b " + "same text " * 40] * 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bytes_, heads = Counter(len(t) for t in texts), Counter((len(t), t[:128].translate(LOW)) for t in texts)
    want = {"rows": len(texts), "prefix": sum(n for n in bytes_.values() if n > 1), "whole": sum(n for n in heads.values() if n > 1)}
    assert exact_dedup.stages(docs) == want and want["rows"] > want["prefix"] > want["whole"] > 0


def test_dedup_of_clashing_names(odd):
    names = ["_twice", "_print", "_head", "_bytes", "_word", "_mask", "_text", "_row", "keep_id", "group_size", "kept"]
    docs = odd.drop("kept").withColumns({n: F.lit(n) for n in names})
    plain = odd.select("doc_id", "text")
    assert Counter(map(tuple, exact_dedup.dedup(docs).collect())) == Counter(map(tuple, exact_dedup.dedup(plain).collect()))
    kept = exact_dedup.keep(docs)
    assert kept.columns == docs.columns and all(r._twice == "_twice" and r.kept == "kept" for r in kept.collect())


def test_dedup_on_no_rows(empty):
    assert exact_dedup.dedup(empty).count() == 0 and exact_dedup.keep(empty).count() == 0


# sharding


def test_curve_visits_neighbours(spark):
    import itertools

    cells = list(itertools.product(range(8), repeat=3))
    df = spark.createDataFrame(cells, "a int, b int, c int")
    got = sorted((r[3], tuple(r[:3])) for r in df.select("a", "b", "c", sharding.hilbert_index([F.col("a"), F.col("b"), F.col("c")], bits=3)).collect())
    assert [h for h, _ in got] == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(p, q, strict=True)) == 1 for (_, p), (_, q) in zip(got, got[1:], strict=False))


def test_shards(odd, empty):
    import zlib

    got = sharding.shard(odd).collect()
    n = odd.count()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append((r.slot, r.hilbert))
    assert set(shards) == set(range(16)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    ordered = [h for s in range(16) for _, h in sorted(shards[s])]
    assert ordered == sorted(ordered) and len(ordered) == n
    assert all(sorted(k for k, _ in v) == list(range(len(v))) for v in shards.values())
    assert sharding.shard(empty).count() == 0


def test_few_rows_in_shards(spark):
    docs = spark.createDataFrame([(i, "x", "en", "a", 1) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(Counter(r.shard for r in sharding.shard(docs).collect()).values()) == [1] * 5


def test_layouts_are_told_apart_below_the_first_element(spark):
    import json

    same = [{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, {"messages": [{"role": "user"}, {"role": "assistant", "content": "b"}]}]
    other = [{"messages": [{"role": "user", "content": "a"}, {"from": "gpt", "value": "b"}]}, {"messages": [{"role": "user", "content": [{"type": "text"}]}]}, {"messages": [{"role": "user", "content": [{"kind": "text"}]}]}, {"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}, {"a": {"b": {"c": {"d": {"e": 1}}}}}, "text", None]
    df = spark.createDataFrame([(i, json.dumps(r) if r is not None else None) for i, r in enumerate([*same, *other])], "i int, record string")
    got = {r.i: r for r in chat.canonical(df).collect()}
    assert len({got[i].fingerprint for i in range(2)}) == 1
    assert [[tuple(t) for t in got[i].turns] for i in range(2)] == [[("user", "a"), ("assistant", "b")], [("user", ""), ("assistant", "b")]]
    assert len({got[i].fingerprint for i in range(7)}) == 6 and all(got[i].turns is None for i in range(2, 9))
    assert sum(r.records for r in chat.unmapped(chat.canonical(df)).collect()) == 7
    # texts that are JSON themselves are texts
    quoted = spark.createDataFrame([(json.dumps({"prompt": '{"a": 1}', "response": "[Q] " + x}),) for x in ("", "[1]")] + [(json.dumps({"messages": [{"role": "user", "content": '[{"role": "x"}]'}]}),)], "record string")
    assert [[tuple(t) for t in r.turns] for r in chat.canonical(quoted).collect()] == [[("user", '{"a": 1}'), ("assistant", "[Q] " + x)] for x in ("", "[1]")] + [[("user", '[{"role": "x"}]')]]


def test_chats_of_odd_rows(spark):
    long = "x<|" + "y" * 20_000_001
    rows = [(1, 0, "user,assistant", "one"), (2, 0, "user", long), (2, 1, "assistant", long), (3, 0, None, None), (4, 0, "user", "q"), (5, 0, "assistant", ""), (5, 0, "assistant", "")]
    df = spark.createDataFrame([], "conv_id long, turn int, role string, text string").unionByName(
        spark.createDataFrame([r for r in rows if r[3] != long], "conv_id long, turn int, role string, text string")
    ).unionByName(spark.range(2).selectExpr("2L as conv_id", "int(id) as turn", "if(id = 0, 'user', 'assistant') as role", "concat('x<|', repeat('y', 20000001)) as text"))
    read = chat.read_back(chat.format_turns(chat.canonical(chat.as_records(df))))
    got = {r.conv_id: r for r in read.select("conv_id", F.transform("read_turns", lambda t: F.struct(t["role"], F.sha2(t["text"].cast("binary"), 256), F.length(t["text"]))).alias("t"), F.transform("loss_texts", lambda x: F.length(x)).alias("loss")).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert [tuple(x) for x in got[1].t] == [("user,assistant", sha("one"), 3)]
    assert [tuple(x) for x in got[2].t] == [("user", sha(long), len(long)), ("assistant", sha(long), len(long))] and got[2].loss == [len(long)]
    assert [tuple(x) for x in got[3].t] == [("unknown", sha(""), 0)]
    assert [x[0] for x in got[5].t] == ["assistant"] * 2 and got[5].loss == [0, 0]


# rollups


def test_rollup_counts_real_tokens(spark, odd, empty):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    paths = {k: public_tokenizers.path(v) for k, v in queries.VERSIONS.items()}
    one = Tokenizer.from_file(paths["byte_bpe_50k"])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(paths["byte_bpe_multi_50k"], "rb"))}
    two = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, r.source, r.lang, len(one.encode(r.text or "", add_special_tokens=False).ids), len(two.encode_ordinary(r.text or ""))) for r in odd.collect())
    assert Counter(map(tuple, token_rollup.counts(odd, paths).collect())) == want
    assert token_rollup.counts(empty, paths).count() == 0


def test_rollup_query_is_brute_force(spark, small):
    import public_tokenizers

    docs = spark.read.parquet(f"{small}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("toxic = 1").collect()}
    found = token_rollup.counts(docs, {k: public_tokenizers.path(v) for k, v in queries.VERSIONS.items()}).collect()
    want = defaultdict(lambda: [0, 0])
    for r in found:
        if r.doc_id is None or r.doc_id not in toxic:
            for v in queries.VERSIONS:
                want[r.source, r.lang, v][0] += 1
                want[r.source, r.lang, v][1] += r[v]
    assert {tuple(r)[:3]: list(r)[3:] for r in queries.op8_token_rollup(spark, small).collect()} == want


def test_rollup_takes_batches_during_compaction(spark, tmp_path, monkeypatch):
    c = spark.createDataFrame([(1, "a", "en", 5)], "doc_id long, source string, lang string, n long")
    r, other = token_rollup.Rollup(spark, str(tmp_path / "r")), token_rollup.Rollup(spark, str(tmp_path / "r"))
    r.commit("1", token_rollup.inserts(c, "v", "n"))
    plain = r._sums

    def late(g, batches):  # another writer commits between the list of batches and their sums
        other.commit("2", token_rollup.inserts(c, "v", "n"))
        return plain(g, batches)

    monkeypatch.setattr(r, "_sums", late)
    assert r.compact()
    monkeypatch.undo()
    assert [x.tokens for x in r.totals().collect()] == [10] and not r.commit("2", token_rollup.inserts(c, "v", "n"))
    r.compact()
    r.compact()
    assert [x.tokens for x in r.totals().collect()] == [10] and r._names("batches") == []
    assert not r.commit("1", token_rollup.inserts(c, "v", "n")) and not other.commit("2", token_rollup.inserts(c, "v", "n"))


def test_one_of_two_writers_of_a_batch_succeeds(spark, tmp_path, monkeypatch):
    c = spark.createDataFrame([(1, "a", "en", 5)], "doc_id long, source string, lang string, n long")
    r, other = token_rollup.Rollup(spark, str(tmp_path / "r")), token_rollup.Rollup(spark, str(tmp_path / "r"))
    plain, done = r._publish, []

    def second(staged, path):
        if not done:
            done.append(other.commit("1", token_rollup.inserts(c, "v", "n")))
        return plain(staged, path)

    monkeypatch.setattr(r, "_publish", second)
    assert not r.commit("1", token_rollup.inserts(c, "v", "n")) and done == [True]
    assert [x.tokens for x in r.totals().collect()] == [5]


def test_rollup_replays_and_compacts(spark, tmp_path):
    c = spark.createDataFrame([(1, "a", "en", 5, 6), (2, "a", None, 7, 7), (3, None, "en", None, 1)], "doc_id long, source string, lang string, old long, new long")
    r = token_rollup.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    assert r.commit("1", token_rollup.inserts(c, "v1", "old")) and not r.commit("1", token_rollup.inserts(c, "v1", "old"))
    r.commit("2", token_rollup.revisions(c, "v1", "old", "new"))
    r.commit("3", token_rollup.deletes(c.where("doc_id = 2"), "v1", "new"))
    r.commit("4", token_rollup.inserts(c.limit(0), "v1", "old"))
    want = {("a", "en", "v1", 1, 6), (None, "en", "v1", 1, 1)}
    assert {tuple(x) for x in r.totals().collect()} == want
    r.compact()
    assert not r.commit("2", token_rollup.inserts(c, "v1", "old"))
    assert {tuple(x) for x in r.totals().collect()} == want
    r.commit("5", token_rollup.inserts(c.where("doc_id = 2"), "v2", "new"))
    r.compact()
    assert {tuple(x) for x in r.totals().collect()} == want | {("a", None, "v2", 1, 7)}


def test_rollup_takes_up_a_batch_that_was_cut_off(spark, tmp_path):
    c = spark.createDataFrame([(1, "a", "en", 5)], "doc_id long, source string, lang string, n long")
    r = token_rollup.Rollup(spark, str(tmp_path / "r"))
    r.commit("1", token_rollup.inserts(c, "v", "n"))
    (tmp_path / "r/batches/1/_SUCCESS").unlink()
    assert r.totals().count() == 0 and r.commit("1", token_rollup.inserts(c, "v", "n"))
    assert [x.tokens for x in r.totals().collect()] == [5]


# chats


def test_layouts_become_turns(spark):
    import json

    records = [
        {"prompt": "p", "response": "r"}, {"instruction": "i", "input": "", "output": "o"}, {"instruction": "i", "input": "more", "output": "o"},
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"what": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, None)], "i int, record string")
    got = {r.i: r.turns and [tuple(t) for t in r.turns] for r in chat.canonical(df).collect()}
    assert got == {
        0: [("user", "p"), ("assistant", "r")], 1: [("user", "i"), ("assistant", "o")], 2: [("user", "i"), ("user", "more"), ("assistant", "o")],
        3: [("user", "a"), ("assistant", "b")], 4: [("user", "h"), ("assistant", "g")], 5: None, 9: None,
    }


def test_template_reads_back(spark):
    rng = random.Random(6)
    parts = ["\\", "\\b", "\\p", "<|", "<|im_end|>\n", "<|im_start|>", "x", "\n", "é", "🙂", ""]
    text_ = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))
    chats = [(i, [(rng.choice(["user", "assistant", "sys\ntem", "<|im_start|>"]), text_()) for _ in range(rng.randrange(0, 6))]) for i in range(200)]
    df = spark.createDataFrame(chats, f"i int, turns {chat.TURNS}")
    for r in chat.read_back(chat.format_turns(df)).collect():
        want = chats[r.i][1]
        assert [tuple(t) for t in r.read_turns] == want
        assert r.loss_texts == [t for role, t in want if role == "assistant"]


def test_chats_with_nulls_and_ties(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "a"), (2, 0, None, "x"), (2, 0, None, "x"), (3, None, "assistant", ""), (None, 1, "user", "y")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.canonical(chat.as_records(rows)).collect()}
    assert got == {1: [("user", ""), ("assistant", "a")], 2: [("unknown", "x")] * 2, 3: [("assistant", "")], None: [("user", "y")]}
    assert chat.as_records(rows.limit(0)).count() == 0
