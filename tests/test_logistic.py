"""Grouped logistic fits against a plain Newton pass with step halving."""

import math
import random

from assaylake.operators import models


def plain(points):
    """Intercept, slope, their errors and the log likelihood of (x, y)."""
    a = b = 0.0

    def at(a, b):
        eta = [a + b * x for x, _ in points]
        return sum(y * e - max(e, 0) - math.log1p(math.exp(-abs(e))) for e, (_, y) in zip(eta, points, strict=True)), [1 / (1 + math.exp(-e)) for e in eta]

    ll, p = at(a, b)
    for _ in range(200):
        w = [q * (1 - q) for q in p]
        w0, w1, w2 = (sum(v * x**k for v, (x, _) in zip(w, points, strict=True)) for k in range(3))
        r0, r1 = (sum((y - q) * x**k for q, (x, y) in zip(p, points, strict=True)) for k in range(2))
        det = w0 * w2 - w1 * w1
        da, db = (w2 * r0 - w1 * r1) / det, (w0 * r1 - w1 * r0) / det
        if max(abs(da), abs(db)) < 1e-13 * (1 + max(abs(a), abs(b))):
            break
        while (found := at(a + da, b + db))[0] < ll - 1e-13 * abs(ll):
            da, db = da / 2, db / 2
        a, b, (ll, p) = a + da, b + db, found
    return a, b, math.sqrt(w2 / det), math.sqrt(w0 / det), ll


def test_groups_equal_a_plain_fit(spark):
    rng = random.Random(7)
    groups = {}
    for g, (a, b, n, spread) in {"flat": (0.2, 0.0, 60, 1), "steep": (-2, 3, 200, 2), "far": (-40, 0.4, 300, 60), "rare": (-5, 1, 800, 2), "offset": (-300, 0.1, 400, 30)}.items():
        at = 3000 if g == "offset" else 100 if g == "far" else 0
        groups[g] = [(x, int(rng.random() < 1 / (1 + math.exp(-(a + b * x))))) for x in (round(at + rng.gauss(0, spread), 2) for _ in range(n))]
    groups["outlier"] = [(float(i), i % 2) for i in range(20)] + [(1e6, 1)]
    groups[None] = [(float(i % 5), int(i % 3 == 0)) for i in range(30)]
    rows = [(g, x, y) for g, points in groups.items() for x, y in points]
    rows += [("few", 1.0, 1), ("few", 2.0, 0)] + [("one class", float(i), 1) for i in range(15)] + [("one value", 2.0, i % 2) for i in range(15)]
    rows += [("separated", float(i), int(i > 9)) for i in range(20)] + [("touching", float(i), int(i >= 9)) for i in range(20)] + [("touching", 9.0, 0), ("down", 1.0, 1)] + [("down", float(i), int(i < 5)) for i in range(12)]
    rows += [("flat", None, 1), ("flat", 1.0, None)]
    got = {r.g: r for r in models.logistic_by_group(spark.createDataFrame(rows, "g string, x double, y int").repartition(5), "g", "x", "y").collect()}
    assert {g: got[g].status for g in ("few", "one class", "one value", "separated", "touching", "down")} == {"few": "few rows", "one class": "one class", "one value": "one value", "separated": "separated", "touching": "separated", "down": "separated"}
    assert all(got[g].slope is None and got[g].midpoint is None for g in ("few", "separated", "one class"))
    for g, points in groups.items():
        middle = sum(x for x, _ in points) / len(points)
        a, b, _, sb, ll = plain([(x - middle, y) for x, y in points])  # centred, as it is well conditioned
        sa = plain(points)[2] if g not in ("offset", "outlier") else None
        r = got[g]
        assert r.status == "converged" and r.n == len(points) and 0 < r.steps < 60
        assert abs(r.slope - b) <= 1e-8 * (1 + abs(b)) and abs(r.intercept - (a - b * middle)) <= 1e-8 * (1 + abs(a - b * middle)), g
        assert abs(r.log_likelihood - ll) <= 1e-8 * abs(ll) and abs(r.se_slope - sb) <= 1e-6 * sb
        assert sa is None or abs(r.se_intercept - sa) <= 1e-6 * sa
        assert abs(r.midpoint + r.intercept / r.slope) <= 1e-9 * abs(r.midpoint)
    assert len(got) == len(groups) + 6


def test_no_rows(spark):
    assert models.logistic_by_group(spark.createDataFrame([], "g string, x double, y int"), "g", "x", "y").count() == 0
