"""Distribution functions in plain numpy, and as column functions for the few rows of a result."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    """By Newton steps on a bracketed root."""
    return _invert(lambda x: 1.0 - norm_sf(x), p, -40.0, 40.0)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, modified Lentz."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_sf(x: float, a: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - total * front
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5)


def t_cdf(t: float, df: float) -> float:
    half = t_two_sided(t, df) / 2.0
    return half if t < 0 else 1.0 - half


def t_ppf(p: float, df: float) -> float:
    return _invert(lambda x: t_cdf(x, df), p, -1e6, 1e6)


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(x / 2.0, df / 2.0)


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0) if f > 0 else 1.0


def beta_ppf(p: float, a: float, b: float) -> float:
    return _invert(lambda x: beta_cdf(x, a, b), p, 0.0, 1.0)


def _invert(cdf, p: float, lo: float, hi: float) -> float:
    for _ in range(300):
        mid = (lo + hi) / 2.0
        if mid in (lo, hi):
            break
        if cdf(mid) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def _column(fn, n: int):
    """A scalar function of n arguments over the rows of a small result; null or NaN gives null."""

    def body(*args: pd.Series) -> pd.Series:
        out = []
        for row in zip(*args):
            bad = any(v is None or v != v or math.isinf(v) for v in row)
            out.append(None if bad else fn(*row))
        return pd.Series(out, dtype="float64")

    if n == 1:
        @F.pandas_udf("double")
        def one(a: pd.Series) -> pd.Series:
            return body(a)

        return one
    if n == 2:
        @F.pandas_udf("double")
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return body(a, b)

        return two

    @F.pandas_udf("double")
    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return body(a, b, c)

    return three


def t_p(t: Column, df: Column) -> Column:
    return _column(t_two_sided, 2)(t, df.cast("double"))


def t_q(p: Column, df: Column) -> Column:
    return _column(t_ppf, 2)(p.cast("double"), df.cast("double"))


def z_p(z: Column) -> Column:
    return _column(lambda v: 2.0 * norm_sf(abs(v)), 1)(z)


def chi2_p(x: Column, df: Column) -> Column:
    return _column(chi2_sf, 2)(x, df.cast("double"))


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    return _column(f_sf, 3)(f, d1.cast("double"), d2.cast("double"))


def logit(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
