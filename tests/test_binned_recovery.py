"""Bins of means that lie on an edge: the same whatever the order of rows and the partitions."""

import functools
import itertools
import operator

from pyspark.sql import functions as F

from assaylake.operators import metrics


def test_means_on_an_edge_are_binned_alike_in_any_order(spark):
    parts = [0.02, 0.12, 0.7, 0.96]  # 0.45 on average; doubles come to less in most orders
    sums = {functools.reduce(operator.add, p) / 4 for p in itertools.permutations(parts)}
    assert len(sums) > 1 and min(sums) < 0.45
    rows = [("A", f"r{i}|x", x, i * 4 + j) for i, p in enumerate(itertools.permutations(parts)) for j, x in enumerate(p)]
    table = spark.createDataFrame(rows, "tool string, hits string, reference_coverage double, at int")
    for placed in (table.coalesce(1).sortWithinPartitions("at"), table.repartition(5, "at")):
        got = metrics.binned_recovery(metrics.recovery_table(placed, ["tool"], exact=True), "mean_cov", [0, 0.45, 0.5, 1], ["tool"])
        assert [(r.bin, r.n) for r in got.collect()] == [("[0.45,0.5)", 24)]


def test_exact_means_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", 0.1), ("a", 0.2), ("a", None), ("b", inf), ("b", 0.5), ("c", nan), ("d", None), ("e", 1e300), ("e", 3e300)]
    got = {r.k: r.m for r in spark.createDataFrame(rows, "k string, x double").groupBy("k").agg(metrics.exact_mean(F.col("x")).alias("m")).collect()}
    assert got["a"] == 0.15 and got["b"] == inf and got["c"] != got["c"] and got["d"] is None and got["e"] == 2e300
