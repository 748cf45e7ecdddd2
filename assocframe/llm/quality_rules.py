"""Quality rules and robust outliers by minimum covariance determinant.

rules() counts, for each whole text, its words, symbols, repeated lines and
words in repeated windows, and applies the base rules. outliers() takes
transformed statistics of the texts that pass, estimates a centre and a scatter
per language and source by the minimum covariance determinant, and rejects what
lies too far by Mahalanobis distance.

The estimate: from two starts (medians with median deviations, and plain
moments), each step takes the rows with the smallest distances, a share `keep`
of the group, and computes their mean and covariance; the start with the
smaller determinant wins. Distances are binned, and each step's shuffle holds
one row of sums per group and bin, so a group of any size costs the same and no
group meets in one task. A floor on each scale keeps the scatter regular where
a statistic is constant. A group with fewer than `least` rows takes its
language's estimate, and a language with fewer all rows'; where even those are
fewer, no row is rejected by its distance.

A null text has no words. Nulls in language and source are values of their own.
Rows are judged one by one, so repeated rows and ties don't matter; an empty
table gives an empty result. Columns of the input that clash with the results'
names are left out.

Only DataFrame functions are used. Long texts cost time in proportion.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from assocframe.runtime import materialise, release, sized_join

_WS = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: The statistics' least standard deviations, after their transformation.
STATISTICS = {"s_len": 0.35, "s_word": 0.05, "s_sym": 0.15, "s_dup": 0.1, "s_rep": 0.06}
_D = list(STATISTICS)
_BINS = 192


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _shift_pair(h: Column, by: int) -> Column:
    """Hashes of h's elements with those `by` places on."""
    n = F.size(h) - by
    return F.when(n > 0, F.zip_with(F.slice(h, 1, n), F.slice(h, by + 1, n), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def _covered(h: Column) -> Column:
    """Places covered by windows whose hash occurs twice or more. Hashes are
    sorted with their places; each window that equals a neighbour is marked,
    and its places count as far as the next marked window doesn't cover them."""

    def marked(s: Column) -> Column:
        twin = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        places = F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), F.coalesce(twin(x, i), F.lit(False)).alias("twin"))), lambda x: x["twin"]), lambda x: x["i"])
        return _let(F.sort_array(places), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x))

    return _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), marked)


def rules(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """carry (doc_id, lang, source) and each text's n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    own = {"_w", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept", "g1", "g2", "doc_spread", *_D}
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(t, _WS), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        *[c for c in carry or ["doc_id", "lang", "source"] if c not in own],
        _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).cast("long").alias("n"), _let(_shift_pair(h, 1), lambda a: _let(_shift_pair(a, 2), lambda b: _shift_pair(b, 4))).alias("h"))).alias("_w"),
        F.length(F.regexp_replace(t, _WS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    repeat = _let(F.col("_w.h"), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(0))
    out = first.withColumn("n_words", F.col("_w.n")).withColumn("n_repeat_words", repeat.cast("long")).drop("_w")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def statistics() -> list[Column]:
    """The transformed statistics of rules()'s columns; defined, if meaningless,
    for texts without words."""
    words, chars = (F.greatest(F.col(c).cast("double"), F.lit(1.0)) for c in ("n_words", "word_chars"))
    return [
        F.log1p(F.col("n_words").cast("double")).alias("s_len"),
        F.log(chars / words).alias("s_word"),
        F.asinh(100 * F.col("n_symbols") / chars).alias("s_sym"),
        F.least(10 * F.col("n_dup_lines") / words, F.lit(1.0)).alias("s_dup"),
        (F.col("n_repeat_words") / words).alias("s_rep"),
    ]


def chi2_quantile(p: float, d: int) -> float:
    """The quantile of the chi-squared distribution, by bisection."""

    def cdf(x: float) -> float:
        a, x = d / 2, x / 2
        term = total = 1 / a
        k = 0
        while term > total * 1e-15:
            k += 1
            term *= x / (a + k)
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0

    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def _distance(x: list[Column], prefix: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution with the columns
    l_i_j of a Cholesky factor and the centre's m_i, as one let-chain."""

    def step(i: int, z: list[Column]) -> Column:
        if i == len(x):
            return sum((v * v for v in z[1:]), z[0] * z[0])
        rest = x[i] - F.col(f"{prefix}m_{i}")
        for j, v in enumerate(z):
            rest = rest - F.col(f"{prefix}l_{i}_{j}") * v
        return _let(rest / F.col(f"{prefix}l_{i}_{i}"), lambda v: step(i + 1, [*z, v]))

    return step(0, [])


def _factor(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Centres, Cholesky factors and log-determinants from n, sums s_i and
    products q_i_j. A table of one row per group: chained projections."""
    d, floor = len(_D), list(STATISTICS.values())
    out = sums.select(*keys, "n", *[(F.col(f"s_{i}") / F.col("n")).alias(f"m_{i}") for i in range(d)], *[F.col(f"q_{i}_{j}") for i in range(d) for j in range(i + 1)])
    out = out.select(*keys, "n", *[f"m_{i}" for i in range(d)], *[(F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}") + (floor[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i in range(d) for j in range(i + 1)])
    flat = F.array(*[F.col(f"c_{i}_{j}") for i in range(d) for j in range(i + 1)])
    at = {(i, j): i * (i + 1) // 2 + j for i in range(d) for j in range(i + 1)}

    def step(k: int, c: Column, done: list[Column]) -> Column:
        if k == len(at):
            return F.array(*done)
        i, j = next(ij for ij, v in at.items() if v == k)
        rest = c[k]
        for m in range(j):
            rest = rest - done[at[i, m]] * done[at[j, m]]
        value = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / done[at[j, j]]
        return _let(value, lambda v: step(k + 1, c, [*done, v]))

    out = out.select(*keys, "n", *[f"m_{i}" for i in range(d)], _let(flat, lambda c: step(0, c, [])).alias("_l"))
    return out.select(*keys, "n", *[f"m_{i}" for i in range(d)], *[F.col("_l")[k].alias(f"l_{i}_{j}") for (i, j), k in at.items()], sum((2 * F.log(F.col("_l")[at[i, i]]) for i in range(1, d)), 2 * F.log(F.col("_l")[0])).alias("logdet"))


def _moments(cols: list[str]) -> list[Column]:
    d = range(len(cols))
    return [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(cols)], *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"q_{i}_{j}") for i in d for j in range(i + 1)]]


def _totals() -> list[Column]:
    d = range(len(_D))
    return [F.sum(c).alias(c) for c in ["n", *[f"s_{i}" for i in d], *[f"q_{i}_{j}" for i in d for j in range(i + 1)]]]


def _within_share(binned: DataFrame, keys: list[str], order: str, keep: float) -> DataFrame:
    """Sums of the first bins of each group that hold a share `keep` of its rows."""
    w = Window.partitionBy(*keys)
    run = binned.withColumn("_before", F.coalesce(F.sum("n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("_all", F.sum("n").over(w))
    return run.where(F.col("_before") < keep * F.col("_all")).groupBy(*keys).agg(*_totals())


def _spot(x: Column) -> Column:
    """A bin of a distance: about 7 percent wide."""
    return F.least(F.greatest(F.floor(10 * F.log2(x + 0.01)).cast("int") + 70, F.lit(0)), F.lit(_BINS))


def estimate(vectors: DataFrame, keep: float = 0.75, steps: int = 4, least: int = 200) -> DataFrame:
    """(grp, n, m_i, l_i_j, logdet, scale) for the groups of (level, lang,
    source) of at least `least` rows. scale makes the median distance that of
    the normal law."""
    named = F.explode(F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("grp")), F.struct(F.lit(1).alias("level"), F.col("g1").alias("grp")), F.struct(F.lit(2).alias("level"), F.col("g2").alias("grp"))))
    levels = vectors.select(named.alias("_g"), *_D, "doc_spread").select("_g.level", "_g.grp", *_D, "doc_spread")
    plain = materialise(levels.groupBy("level", "grp").agg(*_moments(_D)).where(F.col("n") >= least), "moments")
    scale = 40.0
    # medians and median deviations, from histograms of each statistic
    long = levels.select("level", "grp", F.posexplode(F.array(*_D)).alias("dim", "x"))
    hist = long.groupBy("level", "grp", "dim", F.floor(F.col("x") * scale).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("level", "grp", "dim")
    hist = materialise(hist, "histogram")

    def middle(h: DataFrame, name: str) -> DataFrame:
        run = h.withColumn("_run", F.sum("n").over(w.orderBy("b"))).withColumn("_all", F.sum("n").over(w))
        return run.where(2 * F.col("_run") >= F.col("_all")).groupBy("level", "grp", "dim").agg(((F.min("b") + 0.5) / scale).alias(name))

    med = middle(hist, "med")
    dev = middle(hist.join(med, ["level", "grp", "dim"]).groupBy("level", "grp", "dim", F.floor(F.abs((F.col("b") + 0.5) / scale - F.col("med")) * scale).alias("b")).agg(F.sum("n").alias("n")), "mad")
    robust = med.join(dev, ["level", "grp", "dim"]).groupBy("level", "grp").agg(*[F.max(F.when(F.col("dim") == i, F.col("med"))).alias(f"m{i}") for i in range(len(_D))], *[F.max(F.when(F.col("dim") == i, F.col("mad"))).alias(f"d{i}") for i in range(len(_D))])
    d = range(len(_D))
    start = robust.join(plain.select("level", "grp", "n"), ["level", "grp"]).select("level", "grp", F.lit(1).alias("start"), "n", *[(F.col("n") * F.col(f"m{i}")).alias(f"s_{i}") for i in d], *[(F.col("n") * (F.col(f"m{i}") * F.col(f"m{j}") + (F.pow(1.4826 * F.col(f"d{i}"), F.lit(2.0)) if i == j else F.lit(0.0)))).alias(f"q_{i}_{j}") for i in d for j in range(i + 1)])
    keys = ["level", "grp", "start"]
    now = materialise(_factor(plain.withColumn("start", F.lit(0)).unionByName(start), keys), "estimate")
    release(plain, hist)
    for _ in range(steps):
        dist = sized_join(levels, now, ["level", "grp"], "inner", ["doc_spread"], most=20_000).select(*keys, *_D, _distance([F.col(c) for c in _D]).alias("_d"))
        binned = dist.groupBy(*keys, _spot(F.col("_d")).alias("_b")).agg(*_moments(_D))
        new = materialise(_factor(_within_share(binned, keys, "_b", keep), keys), "estimate")
        release(now)
        now = new
    best = now.groupBy("level", "grp").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    chosen = materialise(now.join(best, keys), "chosen")
    dist = sized_join(levels, chosen, ["level", "grp"], "inner", ["doc_spread"], most=20_000).groupBy("level", "grp", _spot(_distance([F.col(c) for c in _D])).alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("level", "grp")
    half = dist.withColumn("_run", F.sum("n").over(w.orderBy("_b"))).withColumn("_all", F.sum("n").over(w)).where(2 * F.col("_run") >= F.col("_all")).groupBy("level", "grp").agg(F.min("_b").alias("_b"))
    scaled = half.select("level", "grp", F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("_b") - 69.5) / 10) / chi2_quantile(0.5, len(_D))).alias("scale"))
    out = materialise(chosen.join(scaled, ["level", "grp"]), "estimates")
    release(now, chosen)
    return out


def _grouped(counted: DataFrame) -> DataFrame:
    tag = lambda c, mark: F.coalesce(F.concat(F.lit(mark), F.col(c)), F.lit(mark.upper()))
    return counted.withColumn("g1", tag("lang", "l")).withColumn("g2", F.concat_ws("\0", "g1", tag("source", "s"))).withColumn("doc_spread", F.xxhash64("doc_id", "word_chars"))


def fit(counted: DataFrame, keep: float = 0.75, steps: int = 4, least: int = 200) -> DataFrame:
    """The estimates of all groups, from rules()'s rows (materialised)."""
    return estimate(_grouped(counted).where("not base_failed").select("g1", "g2", "doc_spread", *statistics()), keep, steps, least)


def judge(counted: DataFrame, found: DataFrame, cut: float = 0.999999) -> DataFrame:
    """rules()'s rows with `distance` (squared, scaled; null where base_failed)
    and `kept`: false where base_failed or where the distance is beyond the
    chi-squared quantile `cut`."""
    fields = [c for c in found.columns if c not in ("level", "grp", "start", "n", "logdet")]
    # all of counted's columns in one, so that carried ones don't clash with what is made here
    named = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = _grouped(counted.select(F.struct(*counted.columns).alias("_c"), *named)).withColumns(dict(zip(_D, statistics(), strict=True)))
    for k in (1, 2):
        side = found.where(F.col("level") == k).select(F.col("grp").alias(f"g{k}"), F.struct(*fields).alias(f"e{k}"))
        out = sized_join(out, materialise(side, f"level{k}"), [f"g{k}"], "left", ["doc_spread"], most=20_000)
    out = out.join(F.broadcast(found.where("level = 0").select(F.struct(*fields).alias("e0")).limit(1)), F.lit(True), "left")
    out = out.withColumn("_e", F.coalesce("e2", "e1", "e0")).select("_c", "base_failed", *_D, "_e.*")
    far = F.when(~F.col("base_failed") & F.col("m_0").isNotNull(), _distance([F.col(c) for c in _D]) / F.col("scale"))
    # one comparison, which needs both sides of the joins: as a conjunction, a filter on it would be split, and
    # its part on the counts moved below, where they would be made once more
    verdict = F.coalesce(F.when(F.col("base_failed"), F.lit(float("inf"))).otherwise(far), F.lit(0.0)) <= chi2_quantile(cut, len(_D))
    return out.select("_c", far.alias("_far"), verdict.alias("_kept")).select("_c.*", F.col("_far").alias("distance"), F.col("_kept").alias("kept"))


def counted(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A table of rules()'s rows."""
    return materialise(rules(docs, text, list(dict.fromkeys([*(carry or []), "doc_id", "lang", "source"]))), "counted")


def quality(docs: DataFrame, text: str = "text", carry: list[str] | None = None, **options) -> DataFrame:
    """rules(), fit() and judge() for all rows of docs. With carry, the rows
    have these columns of docs; they are written beside the counts, so that
    texts are neither counted twice nor shuffled."""
    found = counted(docs, text, carry)
    return judge(found, fit(found, **options))
