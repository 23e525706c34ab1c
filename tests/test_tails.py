"""Tail probabilities against tables, closed forms and Simpson's rule; adjusted p-values against a plain pass."""

import math
import random

import pytest
from pyspark.sql import functions as F

from assaylake.functions import tails
from assaylake.operators import stats


def close(got, want, digits=1e-9):
    assert abs(got - want) <= digits * abs(want) + 1e-300, (got, want)


def simpson(f, a, b, n=200_000):
    h = (b - a) / n
    return h / 3 * math.fsum((1 if i in (0, n) else 4 if i % 2 else 2) * f(a + i * h) for i in range(n + 1))


@pytest.mark.parametrize("x, k, p", [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (23.209251158954356, 10, 0.01), (124.34211340400407, 100, 0.05)])
def test_chi_squared_table(x, k, p):
    close(tails._chi2(x, k), p)


@pytest.mark.parametrize("f, d1, d2, p", [(3.885293834652391, 2, 12, 0.05), (4.964602743730711, 1, 10, 0.05), (161.44763879758855, 1, 1, 0.05)])
def test_f_table(f, d1, d2, p):
    close(tails._f(f, d1, d2), p)


@pytest.mark.parametrize("t, df, p", [(2.2281388519649385, 10, 0.05), (12.706204736432095, 1, 0.05), (2.7499956535672253, 30, 0.01)])
def test_t_table(t, df, p):
    close(tails._t(t, df), p)


def test_closed_forms():
    rng = random.Random(1)
    for _ in range(200):
        x, k, m = rng.uniform(0, 60), rng.randint(1, 40), rng.randint(1, 10_000_000)
        close(tails._chi2(x, 2 * k), math.exp(-x / 2) * math.fsum((x / 2) ** i / math.factorial(i) for i in range(k)))  # a Poisson sum
        close(tails._f(x, 2, m), math.exp(-m / 2 * math.log1p(2 * x / m)))
        t = rng.uniform(0.01, 50)
        close(tails._t(t, 1), 2 / math.pi * math.atan2(1, t))
        close(tails._t(t, 2), 2 / (2 + t * t + t * math.sqrt(2 + t * t)))
        close(tails._f(t * t, 1, m), tails._t(t, m))


def test_many_degrees_of_freedom_keep_their_digits():
    assert abs(tails._t(1.959963984540054, 1e12) - 0.05) < 1e-10
    density = lambda k: lambda x: math.exp((k / 2 - 1) * math.log(x / 2) - x / 2 - math.lgamma(k / 2)) / 2
    for k, x in ((5000, 5100), (5000, 4900), (777, 900)):
        close(tails._chi2(x, k), simpson(density(k), x, x + 60 * math.sqrt(2 * k)), 1e-8)
    close(tails._f(1.02, 40_000, 60_000), 1 - tails._f(1 / 1.02, 60_000, 40_000), 1e-9)


def test_columns(spark):
    rows = spark.createDataFrame([(1.96, 10.0), (-1.96, 10.0), (None, 10.0), (float("nan"), 10.0), (1.0, 0.0), (float("inf"), 3.0)], "x double, k double")
    got = rows.select(tails.t_p("x", "k").alias("t"), tails.normal_p("x").alias("z"), tails.chi2_p("x", "k").alias("c"), tails.f_p("x", "k", F.lit(7)).alias("f")).collect()
    assert got[0].t == got[1].t and abs(got[0].z - 0.04999579029644087) < 1e-12 and got[1].f == got[1].c == 1
    assert [(r.t, r.c, r.f) for r in got[2:5]] == [(None, None, None)] * 3 and got[5].t == got[5].f == 0
    assert [r.z for r in got[2:4]] == [None, None]


def test_adjusted_by_group_with_ties_and_nulls(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice([None, round(rng.random() ** 3, 2)])) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, g string, p double").repartition(7)
    for method in ("BH", "bonferroni", "none"):
        want = {}
        for g in "ab":
            own = sorted((p, i) for i, h, p in rows if h == g and p is not None)
            least = 1.0
            for rank in range(len(own), 0, -1):
                p, i = own[rank - 1]
                least = min(least, p * len(own) / rank)
                want[i] = least if method == "BH" else min(1.0, p * (len(own) if method == "bonferroni" else 1))
        got = {r.i: r for r in stats.p_adjust(df, "p", ["g"], method).collect()}
        assert len(got) == 300
        for i, _, p in rows:
            assert (got[i].p_adj is None and got[i].stars is None) if p is None else abs(got[i].p_adj - want[i]) < 1e-12
    assert stats.p_adjust(df.limit(0), "p").count() == 0


def test_power_of_ordered_classes(spark):
    counts = {"a": 30, "b": 50, "c": 15, "d": 5}
    df = spark.createDataFrame([(c,) for c, n in counts.items() for _ in range(n)] + [(None,)], "c string")
    odds, upto, shifted = 2.0, 0.0, []
    for n in counts.values():
        upto += n / 100
        shifted.append(odds * upto / (1 - upto + odds * upto))
    mean = [(n / 100 + s - before) / 2 for n, s, before in zip(counts.values(), shifted, [0, *shifted], strict=False)]
    classes = stats.shifted_classes(df, "c", odds)
    assert [abs(r.p_mean - m) < 1e-12 for r, m in zip(classes.orderBy("c").collect(), mean, strict=True)] == [True] * 4
    ps = 1 - sum(m**3 for m in mean)
    need = 12 * (1.959963984540054 + 1.2815515655446004) ** 2 / math.log(odds) ** 2 / ps
    got = stats.ordinal_power(classes, odds, p="p_mean").first()
    assert abs(got.n_needed - need) < 1e-9 and abs(got.ps - ps) < 1e-12 and abs(got.power - 0.9) < 0.002
    n = 80.0
    z = math.log(odds) * math.sqrt(n**3 / 4 * ps / 3 / (n + 1) ** 2) - 1.959963984540054
    assert abs(stats.ordinal_power(classes, odds, p="p_mean", n=F.lit(n)).first().power - math.erfc(-z / math.sqrt(2)) / 2) < 1e-12
