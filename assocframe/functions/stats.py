"""Distribution functions as Columns: the inverse normal distribution, the
complementary error function and chi-squared quantiles of one degree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from assocframe.functions.numeric import let

#: Coefficients of Wichura's algorithm AS 241, PPND16 (fixed values): numerator
#: and denominator for the centre, the near tail and the far tail.
CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
NEAR = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def _ratio(pair, x: Column) -> Column:
    return let(x, lambda v: _horner(pair[0], v) / _horner(pair[1], v))


def normal_quantile(p: Column) -> Column:
    """The inverse of the normal distribution function for 0 < p < 1."""

    def of(v: Column) -> Column:
        q = v - 0.5
        tail = let(F.sqrt(-F.log(F.least(v, 1 - v))), lambda r: F.when(r <= 5, _ratio(NEAR, r - 1.6)).otherwise(_ratio(FAR, r - 5)))
        return F.when((v > 0) & (v < 1), F.when(F.abs(q) <= 0.425, q * _ratio(CENTRE, 0.180625 - q * q)).otherwise(F.signum(q) * tail))

    return let(p, of)


def z_from_p(p: Column, exact_tail: bool = False) -> Column:
    """|z| of a two-sided p. By default from 1 - p / 2, which saturates for tiny
    p as double precision does; exact_tail uses p / 2."""
    return -normal_quantile(p / 2) if exact_tail else normal_quantile(F.least(1 - p / 2, F.lit(1 - 2.0**-53)))


def erfc(x: Column, terms: int = 40) -> Column:
    """The complementary error function for x >= 0: a series below 2.5 and a
    continued fraction beyond, of a batch of rows at once."""

    @F.pandas_udf("double")
    def of(x: pd.Series) -> pd.Series:
        v = x.to_numpy(float)
        low = np.where(v < 2.5, v, 0.0)
        high = np.where(v < 2.5, 2.5, v)
        total, t = low.copy(), low
        for k in range(1, terms + 1):
            t = -t * low * low / k
            total = total + t / (2 * k + 1)
        f = high
        for k in range(60, 0, -1):
            f = high + k / 2.0 / f
        return pd.Series(np.where(v < 2.5, 1 - total * 1.1283791670955126, np.exp(-high * high) * 0.5641895835477563 / f))

    value = x.cast("double")
    return F.when(value.isNotNull(), of(value))


def two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z) / 1.4142135623730951)


def chi2_quantile_1(p: Column) -> Column:
    """The chi-squared quantile of one degree of freedom."""
    z = normal_quantile((1 + p) / 2)
    return z * z


def significance(p: Column) -> Column:
    return F.when(p.isNull(), "not_available").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
