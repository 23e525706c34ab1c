"""Trees on cells: bins, growth and scores against plain loops, and no more cells for more rows."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from assaylake.operators import forests as T
from assaylake.operators import models


def test_bins_count_smaller_cuts(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.integers(5)), float(rng.normal()), 7.0) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    at = T.cuts(df, ["a", "b", "c"])
    assert at[0] == [0.5, 1.5, 2.5, 3.5] and len(at[1]) == 31 and at[2] == []
    for r in T.binned(df, ["a", "b", "c"], at).collect():
        assert [r._b0, r._b1, r._b2] == [sum(c < x for c in some) for some, x in zip(at, (r.a, r.b, r.c), strict=True)]
    sizes = [r["count"] for r in T.binned(df, ["a", "b", "c"], at).groupBy("_b1").count().collect()]
    assert len(sizes) == 32 and max(sizes) < 3000 / 32 * 1.5


def gini(labels):
    return 1 - sum((np.mean(labels == c)) ** 2 for c in set(labels.tolist())) if len(labels) else 0.0


def plain_tree(x, y, depth):
    """Node to (variable, cut), greedily; every row once."""
    found, todo = {}, [(1, np.arange(len(y)))]
    for node, at in todo:
        if node >= 1 << depth:
            continue
        best = (0.0, None)
        for f in range(x.shape[1]):
            for c in range(T.BINS - 1):
                left = at[x[at, f] <= c]
                if 0 < len(left) < len(at):
                    right = np.setdiff1d(at, left)
                    gain = gini(y[at]) - len(left) / len(at) * gini(y[left]) - len(right) / len(at) * gini(y[right])
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, c))
        if best[1]:
            found[node] = best[1]
            f, c = best[1]
            todo += [(2 * node, at[x[at, f] <= c]), (2 * node + 1, at[x[at, f] > c])]
    return found


def test_growth_equals_a_plain_tree(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (400, 2))
    y = ((x[:, 0] > 2).astype(int) + (x[:, 1] > 3) * (x[:, 0] > 1) + (rng.random(400) < 0.1)) % 3
    rows = [(int(a), int(b), int(c)) for (a, b), c in zip(x, y, strict=True)]
    cells = T.cells(spark.createDataFrame(rows, "_b0 int, _b1 int, label int"), 2)
    drawn = T.with_draws(cells, 2, "once", lambda rng, n: np.full(1, n), 1)

    def impurity(s):
        w = s.sum(axis=-1)
        return w, 1 - (s * s).sum(axis=-1) / np.maximum(w * w, 1e-300)

    stats = lambda b, bins: [(b.column("label").to_numpy()[:, None], b.column("draws").flatten().to_numpy().reshape(-1, 1))]
    got = T.grow(drawn, 2, 1, 3, 3, stats, impurity, 2, 1)
    assert {i: (int(got.feature[0, i]), int(got.cut[0, i])) for i in np.flatnonzero(got.feature[0] >= 0)} == plain_tree(x, y, 3)


def made(spark, copies=1):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(1500):
        a, b = float(rng.integers(40)), float(rng.normal())
        rows.append((i, a, b, "no" if rng.random() < (0.8 if a > 25 else 0.3) + 0.1 * (b > 0) else "yes"))
    return spark.createDataFrame([(j * 1500 + i, *r) for j in range(copies) for i, *r in rows], "key long, x double, y double, cls string")


def test_chances_are_those_of_a_forest_on_rows(spark):
    df = made(spark)
    got = {(r.value, r.cls): r.mean_probability for r in models.partial_dependence(df, ["x", "y"], "cls", "x", [5.0, 35.0], trees=40).collect()}
    rows = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df.withColumn("label", (F.col("cls") == "yes").cast("double")))
    model = RandomForestClassifier(numTrees=40, seed=1).fit(rows)
    for v in (5.0, 35.0):
        at = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df.withColumn("x", F.lit(v)))
        want = model.transform(at).agg(F.avg(vector_to_array("probability")[1])).first()[0]
        assert got[v, 1] == pytest.approx(want, abs=0.03) and got[v, 0] + got[v, 1] == pytest.approx(1)


def test_trees_see_cells_whatever_the_rows(spark, monkeypatch):
    """Rows eight times over are the same cells, each of eight times the rows."""
    seen = []
    grow = T.grow
    monkeypatch.setattr(T, "grow", lambda cells, *a: seen.append(cells.agg(F.count("*").alias("c"), F.sum("n").alias("n")).first()) or grow(cells, *a))
    for copies in (1, 8):
        models.partial_dependence(made(spark, copies), ["x", "y"], "cls", "x", [5.0], trees=3).count()
    assert seen[1]["n"] == 8 * seen[0]["n"] == 12000 and seen[1]["c"] < 1.2 * seen[0]["c"]
    models.random_forest_importance(made(spark, 8), "key", ["x", "y"], "cls", trees=3)
    assert seen[2]["c"] < 1.2 * seen[0]["c"]


def test_boosting_finds_the_classes_cut(spark):
    """All gains are those of the variable that parts the classes."""
    gains = T.boost(T.cells(spark.createDataFrame([(i % 4, j % 3, int(i % 4 > 1)) for i in range(40) for j in range(3)], "_b0 int, _b1 int, label int"), 2), 2, 2, 3, 2, 0.1, 1.0, 1)
    assert len(gains) == 2 and all(g[0] == pytest.approx(1) and g[1] == pytest.approx(0) for g in gains)


def test_boosting_sees_cells_whatever_the_rows(spark, monkeypatch):
    seen = []
    grow = T.grow
    monkeypatch.setattr(T, "grow", lambda cells, *a: seen.append(cells.agg(F.count("*").alias("c"), F.sum("n").alias("n")).first()) or grow(cells, *a))
    for copies in (1, 8):
        got = {(r.cls, r.variable): r.gain for r in models.boosted_importance(made(spark, copies), ["x", "y"], "cls", rounds=1, depth=2).collect()}
        assert got[0, "x"] > got[0, "y"] and got[1, "x"] > got[1, "y"]
    assert seen[1]["n"] == 8 * seen[0]["n"] and seen[1]["c"] < 1.2 * seen[0]["c"]


def test_many_rounds_are_those_of_passes(spark, monkeypatch):
    """A task for each class and passes over dealt cells give the same gains, where all rows take part."""
    rng = np.random.default_rng(8)
    rows = [(int(a), int(b), int((a > 9) + (rng.random() < 0.3) * (b % 3))) for a, b in rng.integers(0, [20, 7], (3000, 2))]
    cells = T.cells(spark.createDataFrame(rows, "_b0 int, _b1 int, label int"), 2).persist()
    got = T.boost(cells, 2, 4, 5, 3, 0.1, 1.0, 1)
    monkeypatch.setattr(T, "PLACES", 1)
    for a, b in zip(got, T.boost(cells, 2, 4, 5, 3, 0.1, 1.0, 1), strict=True):
        assert a == pytest.approx(b, abs=1e-9)
    cells.unpersist()


def test_boosted_importance_grows_all_rounds(spark, monkeypatch, tmp_path):
    """The registered query grows the reference's 300 rounds."""
    from assaylake.plans import learned

    seen = []
    monkeypatch.setattr(learned.M.forests, "boost", lambda cells, d, k, rounds, *a: seen.append(rounds) or [np.zeros(d)] * k)
    flags = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame([(i, 1, float(i), 1.0, 0.1 * i, 0.0, "AN"[i % 2]) for i in range(20)], flags).write.parquet(f"{tmp_path}/lineitem.parquet")
    learned.boosted_importance(spark, str(tmp_path)).collect()
    assert seen == [300]
