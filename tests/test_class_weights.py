"""Weights of classes against their definition, and a forest that they make find a rare class."""

import random

from pyspark.sql import functions as F

from assaylake.operators import models


def test_weights_are_inverse_frequencies(spark):
    n = {"a": 50, "b": 10, "c": 1}
    df = spark.createDataFrame([(c, i) for c, k in n.items() for i in range(k)] + [(None, 0)], "c string, i int")
    got = {r.c: (r.w, r.n) for r in models.class_weights(df, "c", "w").groupBy("c").agg(F.max("w").alias("w"), F.count("*").alias("n")).collect()}
    whole = sum(1 / k for k in n.values())
    assert got[None] == (None, 1) and all(abs(got[c][0] - 1 / k / whole) < 1e-12 and got[c][1] == k for c, k in n.items())
    assert models.class_weights(df.limit(0), "c").count() == 0


def test_a_rare_class_counts(spark):
    rng = random.Random(2)
    rows = [(i, float(x := rng.random()), rng.random(), "rare" if x > 0.9 and rng.random() < 0.4 else "often") for i in range(1500)]
    df = spark.createDataFrame(rows, "key long, x double, y double, cls string")
    plain, even = (models.random_forest_importance(df, "key", ["x", "y"], "cls", trees=12, balanced=b).collect() for b in (False, True))
    for got in (plain, even):
        by = {r.variable: r for r in got}
        assert by["x"].importance > by["y"].importance and len({r.accuracy for r in got}) == 1
    assert plain[0].accuracy > even[0].accuracy > 0.8  # even classes give up frequent rows for rare ones
    assert {r.variable: r.loss for r in even}["x"] > 0.02
