"""Association, linkage, pruning and clumping against plain versions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from assocframe.operators import allelic, ld
from assocframe.runtime import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def exact(a, b, c, d):
    """By whole numbers."""
    r, k, n = a + b, a + c, a + b + c + d
    ways = {x: math.comb(r, x) * math.comb(n - r, k - x) for x in range(max(0, r + k - n), min(r, k) + 1)}
    return float(Fraction(sum(w for w in ways.values() if 10**7 * w <= ways[a] * (10**7 + 1)), math.comb(n, k)))


def test_fisher_on_small_tables():
    """All tables of counts up to five, those with empty rows and columns too."""
    t = np.array([(a, b, c, d) for a in range(6) for b in range(6) for c in range(6) for d in range(6)])
    assert allelic.fisher_p(*t.T) == pytest.approx([exact(*map(int, r)) for r in t], rel=1e-9)


def test_fisher_on_large_tables():
    rng = random.Random(1)
    t = [tuple(rng.randrange(int(10 ** rng.uniform(0, 3.3))) for _ in range(4)) for _ in range(300)] + [(900, 100, 100, 900), (1, 2000, 2000, 1), (0, 1500, 30, 1470), (500, 500, 500, 500)]
    got = allelic.fisher_p(*np.array(t).T)
    want = [exact(*r) for r in t]
    assert got == pytest.approx(want, rel=1e-8, abs=1e-300)
    big = allelic.fisher_p(*np.array([(300_000, 700_000, 301_000, 699_000), (10, 999_990, 400_000, 600_000)]).T)
    z = 1000 / math.sqrt(2e6 * 0.3005 * 0.6995)
    assert big[0] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=2e-2) and big[1] == 0


def test_association_counts_and_ratios(spark):
    rng = random.Random(2)
    rows = [(f"i{i}", f"v{k}", rng.choice([0, 1, 2, None]) if k < 7 else 0) for i in range(60) for k in range(9)]
    y = {f"i{i}": rng.choice([0.0, 1.0, None]) for i in range(60)}
    rows += [(f"i{i}", "cases", 1) for i in range(60) if y[f"i{i}"] == 1]
    d = spark.createDataFrame(rows, "IID string, SNPID string, dosage int")
    pheno = spark.createDataFrame(list(y.items()), "IID string, y double")
    plain = {}
    for i, v, x in rows:
        if x is not None and y[i] is not None:
            t = plain.setdefault(v, [0, 0, 0, 0])
            t[0 if y[i] else 2] += x
            t[1 if y[i] else 3] += 2 - x
    for half in (False, True):
        got = {r.SNPID: r for r in allelic.association(d, pheno, half).collect()}
        assert set(got) == set(plain)
        for v, (a, b, c, e) in plain.items():
            r = got[v]
            assert (r.case_a1, r.case_a2, r.control_a1, r.control_a2) == (a, b, c, e)
            if half and 0 in (a, b, c, e):
                a, b, c, e = (x + 0.5 for x in (a, b, c, e))
            assert r.odds_ratio == (pytest.approx(a * e / (b * c)) if b * c else None)
            assert r.p == (pytest.approx(exact(*plain[v])) if v != "cases" else None)
    assert got["v8"].p == 1.0 and got["cases"].f_u is None


def genotypes(rng, n, variants, stay=0.8, missing=0.1):
    """Neighbours alike, with missing calls, some variants without any spread."""
    out, g = {}, rng.integers(0, 3, n)
    for k in range(variants):
        g = np.where(rng.random(n) < stay, g, rng.binomial(2, rng.uniform(0.1, 0.5), n))
        x = np.where(rng.random(n) < missing, -1, g)
        out[f"v{k:04d}"] = x if k % 37 else np.where(x < 0, x, 1)
    return out


def r2(x, y):
    m = (x >= 0) & (y >= 0)
    x, y, n = x[m].tolist(), y[m].tolist(), int(m.sum())
    c = n * sum(a * b for a, b in zip(x, y, strict=True)) - sum(x) * sum(y)
    v = (n * sum(a * a for a in x) - sum(x) ** 2) * (n * sum(b * b for b in y) - sum(y) ** 2)
    return n, c * c / v if v else None


def frames(spark, dose, at):
    rows = [(str(i), s, int(v)) for s, x in dose.items() for i, v in enumerate(x) if v >= 0]
    d = spark.createDataFrame(rows, "IID string, SNPID string, dosage int").repartition(5)
    return d, spark.createDataFrame([(s, *at[s]) for s in dose], "SNPID string, CHR string, POS long")


def test_pairs_by_distance(spark, monkeypatch):
    monkeypatch.setattr(ld, "BLOCK", 8)
    rng = np.random.default_rng(4)
    dose = genotypes(rng, 41, 60, missing=0.5)
    at = {s: (str(k % 2), int(rng.integers(0, 30) * 100)) for k, s in enumerate(dose)}
    d, places = frames(spark, dose, at)
    got = {(r.s1, r.s2): (r.n, r.r2) for r in ld.by_distance(d, places, 500).collect()}
    want = {}
    for s in dose:
        for t in dose:
            if at[s][0] == at[t][0] and (at[s][1], s) < (at[t][1], t) and at[t][1] - at[s][1] <= 500:
                n, v = r2(dose[s], dose[t])
                if n:
                    want[s, t] = n, pytest.approx(v) if v is not None else None
    assert got == want
    strong = {(r.s1, r.s2) for r in ld.by_distance(d, places, 500, 0.3).collect()}
    assert strong == {k for k, v in got.items() if v[1] is not None and v[1] >= 0.3}


def windowed(dose, at, window, step, limit):
    """The walk, window by window."""
    f = {s: (lambda m: min(m, 1 - m))(x[x >= 0].mean() / 2) for s, x in dose.items()}
    stay = set()
    for c in {p[0] for p in at.values()}:
        order = sorted((s for s in dose if at[s][0] == c), key=lambda s: (at[s][1], s))
        gone = set()
        for first in range(0, max(len(order), 1), step):
            now = order[first : first + window]
            for i, s in enumerate(now):
                for t in now[i + 1 :]:
                    if s in gone:
                        break
                    if t in gone:
                        continue
                    v = r2(dose[s], dose[t])[1]
                    if v is not None and v > limit:
                        gone.add(s if f[s] < (1 - 1e-9) * f[t] else t)
        stay |= {(c, s) for s in order if s not in gone}
    return stay


@pytest.mark.parametrize("span, window, step", [(4096, 200, 50), (1, 12, 5)])
def test_pruning_is_the_walk(spark, monkeypatch, span, window, step):
    """Spans shorter than windows need many rounds and give the same."""
    monkeypatch.setattr(ld, "SPAN", span)
    monkeypatch.setattr(ld, "BLOCK", 8)
    rng = np.random.default_rng(span)
    dose = genotypes(rng, 30, 130)
    at = {s: ("1" if k < 100 else "2", int(rng.integers(0, 500))) for k, s in enumerate(dose)}
    d, places = frames(spark, dose, at)
    assert {(r.CHR, r.SNPID) for r in ld.prune(d, places, window, step, 0.25).collect()} == windowed(dose, at, window, step, 0.25)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clumping_is_the_walk(spark, seed):
    rng = random.Random(seed)
    p = {f"s{i}": rng.choice([rng.random(), 0.5, None]) for i in range(80)}
    pairs = {tuple(sorted(rng.sample(sorted(p), 2))): rng.random() for _ in range(200)}
    p1, p2 = rng.choice([(1.0, 1.0), (0.6, 0.8)])
    stats = spark.createDataFrame([("1", s, v) for s, v in p.items()], "CHR string, SNPID string, P double")
    linked = spark.createDataFrame([("1", *k, 9, v) for k, v in pairs.items()], "CHR string, s1 string, s2 string, n long, r2 double")
    near = {s: set() for s in p}
    for (s, t), v in pairs.items():
        if v >= 0.3:
            near[s].add(t)
            near[t].add(s)
    want, gone = {}, set()
    for v, s in sorted((v, s) for s, v in p.items() if v is not None and v <= p1):
        if s not in gone:
            mine = {t for t in near[s] - gone if p[t] is not None and p[t] <= p2}
            gone |= mine | {s} | near[s]
            want[s] = mine
    claimed = set()
    for s, mine in sorted(want.items(), key=lambda x: (p[x[0]], x[0])):
        want[s] = len({t for t in near[s] - claimed if p[t] is not None and p[t] <= p2 and t not in want})
        claimed |= near[s]
    assert {r.SNPID: r.members for r in ld.clump(stats, linked, p1, 0.3, p2).collect()} == want


def test_calls_of_few_samples_stay_few(spark, monkeypatch):
    """What is packed grows with the calls, not with variants times samples; rare and
    common variants of one block compare as before."""
    monkeypatch.setattr(ld, "BLOCK", 8)
    rng = np.random.default_rng(6)
    dose = genotypes(rng, 2000, 16, missing=0.2)
    for k, s in enumerate(dose):
        if k not in (3, 5):
            dose[s] = np.where(np.isin(np.arange(2000), rng.choice(200, 60, replace=False)), dose[s], -1)
    at = {s: ("1", 10 * k) for k, s in enumerate(dose)}
    d, places = frames(spark, dose, at)
    sizes = {r.SNPID: len(r.calls) for r in ld.packed(d).collect()}
    assert all(sizes[s] <= 1 + 4 * 60 for s in dose if s not in ("v0003", "v0005")) and sizes["v0003"] > 400
    got = {(r.s1, r.s2): (r.n, r.r2) for r in ld.by_distance(d, places, 80).collect()}
    want = {(s, t): r2(dose[s], dose[t]) for s in dose for t in dose if at[s] < at[t] and at[t][1] - at[s][1] <= 80}
    assert got == {k: (n, pytest.approx(v) if v is not None else None) for k, (n, v) in want.items() if n}


def test_no_genotypes(spark):
    d = spark.createDataFrame([], "IID string, SNPID string, dosage int")
    places = spark.createDataFrame([("a", "1", 5)], "SNPID string, CHR string, POS long")
    assert not ld.by_distance(d, places, 100).count() and not ld.prune(d, places).count()
