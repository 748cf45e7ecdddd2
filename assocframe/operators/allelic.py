"""Allelic association of cases and controls: counts, odds ratio and Fisher's exact
test. Counts are one grouped pass; the test runs over Arrow batches of tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

#: Two tables are as likely as each other within this share.
_SAME = 1e-7
#: Factorials whose logarithms are summed; beyond, Stirling's series has all digits.
_SUMMED = 256


def log_factorial(n: np.ndarray) -> np.ndarray:
    small = np.append(0.0, np.cumsum(np.log(np.arange(1, _SUMMED))))
    x = np.maximum(n, _SUMMED) + 1.0
    large = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < _SUMMED, small[np.minimum(n, _SUMMED - 1)], large)


def _log_p(x: np.ndarray, row: np.ndarray, column: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The logarithm of the hypergeometric probability of x, up to a constant of the
    margins."""
    return -(log_factorial(x) + log_factorial(row - x) + log_factorial(column - x) + log_factorial(total - row - column + x))


def _tail(x: np.ndarray, step: np.ndarray, row: np.ndarray, column: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The sum of the probabilities of x, x + step, ... to the end of the support, in
    units of that of x; steps (1 or -1) lead away from the peak. Terms come by
    recurrence, until they don't count any more."""
    x, out, term = x.astype(float), np.ones(len(x)), np.ones(len(x))
    on = np.arange(len(x))
    while len(on):
        a, r, c, n = x[on], row[on], column[on], total[on]
        up, down = (r - a) * (c - a), a * (n - r - c + a)
        term[on] *= np.where(step[on] > 0, up / ((a + 1) * (n - r - c + a + 1)), down / ((r - a + 1) * (c - a + 1)))
        x[on] += step[on]
        out[on] += term[on]
        on = on[term[on] > 1e-17 * out[on]]
    return out


def fisher_p(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Two-sided p of the tables [[a, b], [c, d]]: the probability of all tables with
    the same margins that are no more likely. 1 where a margin is zero.

    Beyond the peak probabilities fall on both sides, so the other side's tables are
    those from a place on that bisection finds; both tails are sums outwards."""
    a, b, c, d = (np.asarray(v, np.int64) for v in (a, b, c, d))
    row, column, total = a + b, a + c, a + b + c + d
    low, high = np.maximum(0, row + column - total), np.minimum(row, column)
    peak = np.clip((row + 1) * (column + 1) // (total + 2), low, high)
    here, whole = _log_p(a, row, column, total), _log_p(peak, row, column, total)
    bound = here + _SAME
    right = a > peak
    # the other side's last place, seen from its end, that is no more likely
    near, far = np.where(right, low - 1, high + 1), peak
    while (np.abs(far - near) > 1).any():
        mid = (near + far) // 2
        fits = _log_p(np.clip(mid, low, high), row, column, total) <= bound
        near, far = np.where(fits, mid, near), np.where(fits, far, mid)
    peaked = whole <= bound  # of the most likely tables: all count
    away, out = np.where(right, 1, -1), np.zeros(len(a))
    for x, step, some in ((a, away, ~peaked), (near, -away, ~peaked & (near >= low) & (near <= high))):
        x, step, r, c, n = (v[some] for v in (x, step, row, column, total))
        out[some] += np.exp(_log_p(x, r, c, n) - here[some]) * _tail(x, step, r, c, n)
    constant = log_factorial(row) + log_factorial(total - row) + log_factorial(column) + log_factorial(total - column) - log_factorial(total)
    p = np.exp(here + constant) * out
    return np.where(peaked, 1.0, np.minimum(p, 1.0))


@F.pandas_udf(DoubleType())
def _fisher(tables: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b, c, d in tables:
        known = ~(a.isna() | b.isna() | c.isna() | d.isna())
        t = np.stack([v[known].to_numpy().astype(np.int64) for v in (a, b, c, d)], axis=1)
        once, back = np.unique(t, axis=0, return_inverse=True) if len(t) else (t, np.zeros(0, int))
        out = pd.Series(np.nan, index=a.index)
        out[known] = fisher_p(*once.T)[back.ravel()] if len(t) else []
        yield out


def fisher_exact(a: str | Column, b: str | Column, c: str | Column, d: str | Column) -> Column:
    """Fisher's two-sided p of a 2 x 2 table of counts; null where a count is null."""
    p = _fisher(a, b, c, d)
    return F.when(~F.isnan(p), p)


def counts(dosages: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """Per variant the alleles of cases (y = 1) and controls (y = 0): of the counted
    one (case_a1, control_a1) and of the other. Samples without a dosage or with
    another y are left out."""
    j = dosages.join(phenotypes.where("y in (0, 1)"), "IID").where("dosage is not null")
    x, y = F.col("dosage"), F.col("y")
    of = lambda k, v: F.coalesce(F.sum(F.when(y == k, v)), F.lit(0)).cast("long")
    return j.groupBy("SNPID").agg(of(1, x).alias("case_a1"), of(1, 2 - x).alias("case_a2"), of(0, x).alias("control_a1"), of(0, 2 - x).alias("control_a2"))


def association(dosages: DataFrame, phenotypes: DataFrame, half: bool = False) -> DataFrame:
    """Per variant the counts, the allele's frequency among cases (f_a) and controls
    (f_u), the odds ratio and Fisher's p. Where a count of the denominator is zero the
    ratio is null; with `half`, 0.5 is added to all counts of tables with a zero, which
    gives every table a ratio. p is null where cases or controls are missing."""
    t = counts(dosages, phenotypes)
    a, b, c, d = (F.col(k) for k in ("case_a1", "case_a2", "control_a1", "control_a2"))
    share = lambda k, n: F.try_divide(k.cast("double"), (k + n).cast("double"))
    if half:
        more = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), 0.5).otherwise(0.0)
        ratio = (a + more) * (d + more) / ((b + more) * (c + more))
    else:
        ratio = F.try_divide(a.cast("double") * d, b.cast("double") * c)
    both = (a + b > 0) & (c + d > 0)
    return t.select("SNPID", a, b, c, d, share(a, b).alias("f_a"), share(c, d).alias("f_u"), ratio.alias("odds_ratio"), F.when(both, fisher_exact(a, b, c, d)).alias("p"))
