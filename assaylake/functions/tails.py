"""Tail probabilities of test statistics, as column functions on tables of tests.

Continued fractions for the regularised incomplete beta and gamma, run until they stand still; their leading factors come
from deviances and Stirling remainders, so that they keep their digits at any degrees of freedom. They run in Arrow
batches over the table of tests: a row for each test, whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

TINY, STILL = 1e-300, 1e-16


def _remainder(n: float) -> float:
    """ln(n!) less Stirling's (n + 1/2) ln n - n + ln(2 pi) / 2."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    s = 1 / (n * n)
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - s / 1188) * s) * s) * s) / n


def _deviance(x: float, m: float) -> float:
    """x ln(x / m) + m - x, without loss where x is near m."""
    if abs(x - m) < 0.1 * (x + m):
        v = (x - m) / (x + m)
        total, term, j = (x - m) * v, 2 * x * v, 1
        while True:
            term *= v * v
            more = total + term / (2 * j + 1)
            if more == total:
                return total
            total, j = more, j + 1
    return x * math.log(x / m) + m - x


def _lentz(first: float, terms: Callable[[int], tuple[float, float]]) -> float:
    """first + a1 / (b1 + a2 / (b2 + ...)) for (a, b) = terms(1), terms(2), ..."""
    f = c = first or TINY
    d, i = 0.0, 0
    while True:
        i += 1
        a, b = terms(i)
        d = 1 / (b + a * d or TINY)
        c = b + a / c or TINY
        f *= c * d
        if abs(c * d - 1) <= STILL * 4:
            return f


def gamma_upper(a: float, x: float) -> float:
    """Q(a, x), the regularised upper incomplete gamma."""
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    lead = math.exp(-_remainder(a) - _deviance(a, x)) * math.sqrt(a / (2 * math.pi))  # x^a e^-x / gamma(a)
    if x < a + 1:
        total = term = 1 / a
        n = a
        while term > total * STILL:
            n += 1
            term *= x / n
            total += term
        return 1 - lead * total
    return lead / _lentz(x + 1 - a, lambda i: (-i * (i - a), x + 2 * i + 1 - a))


def beta_lower(a: float, b: float, x: float, y: float) -> float:
    """I_x(a, b), the regularised lower incomplete beta; ``y`` is 1 - x, given apart to keep its digits."""
    if x <= 0:
        return 0.0
    if y <= 0:
        return 1.0
    away = a * y - b * x
    if away < 0:
        return 1 - beta_lower(b, a, y, x)
    n = a + b
    # x^a y^b gamma(a + b) / (gamma(a) gamma(b))
    lead = math.exp(_remainder(n) - _remainder(a) - _remainder(b) - _deviance(a, n * x) - _deviance(b, n * y)) * math.sqrt(a * b / (2 * math.pi * n))

    def terms(m: int) -> tuple[float, float]:
        above = (a + m - 1) * (n + m - 1) * m * (b - m) * x * x / ((a + 2 * m - 1) * (a + 2 * m - 1))
        return above, m + m * (b - m) * x / (a + 2 * m - 1) + (a + m) * (away + 1 + m * (1 + y)) / (a + 2 * m + 1)

    return lead / _lentz(a * (away + 1) / (a + 1), terms)


def _chi2(x: float, k: float) -> float:
    return gamma_upper(k / 2, x / 2)


def _f(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_lower(d2 / 2, d1 / 2, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def _t(t: float, df: float) -> float:
    return 1.0 if t == 0 else beta_lower(df / 2, 0.5, df / (df + t * t), t * t / (df + t * t))


def _column(f: Callable[..., float], *args: Column | str) -> Column:
    """``f`` of each row; null where an argument is null or not a number, or degrees of freedom are not above zero."""

    def run(*series: pd.Series) -> pd.Series:
        def one(*v: float) -> float | None:
            if any(x is None or math.isnan(x) for x in v) or any(x <= 0 for x in v[1:]):
                return None
            return 0.0 if math.isinf(v[0]) else min(max(f(*v), 0.0), 1.0)

        return pd.Series([one(*v) for v in zip(*series, strict=True)], dtype="float64")

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    made = pandas_udf(two if len(args) == 2 else three, "double")(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in args])
    return F.when(~F.isnan(made), made)


def chi2_p(x: Column | str, k: Column | str) -> Column:
    """P(X >= x) of chi squared with k degrees of freedom."""
    return _column(_chi2, x, k)


def f_p(f: Column | str, d1: Column | str, d2: Column | str) -> Column:
    """P(X >= f) of F with d1 and d2 degrees of freedom."""
    return _column(_f, f, d1, d2)


def t_p(t: Column | str, df: Column | str) -> Column:
    """P(|X| >= |t|) of Student's t."""
    return _column(_t, F.abs(t), df)


def normal_p(z: Column | str) -> Column:
    """P(|X| >= |z|) of the normal distribution: chi squared of one degree at z squared."""
    z = F.col(z) if isinstance(z, str) else z
    return _column(lambda x, _: math.erfc(x / math.sqrt(2)), F.abs(z), F.lit(1.0))
