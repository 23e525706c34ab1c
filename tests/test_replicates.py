"""Bootstraps of many replicates against plain loops over the same weights."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from assaylake.operators import folds
from assaylake.operators import replicates as R


def test_weights_are_poisson_to_the_end():
    cdf = R.poisson_cdf()
    assert len(cdf) > 15 and abs(cdf[0] - math.exp(-1)) < 1e-16 and abs(cdf[2] - 2.5 * math.exp(-1)) < 1e-15
    w = R.weights(np.arange(500), 4000)
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01 and 7 <= w.max() <= 12
    for k in range(5):
        assert abs((w == k).mean() - math.exp(-1) / math.factorial(k)) < 0.002
    assert np.array_equal(w[3:5, :10], R.weights(np.array([3, 4]), 10)) and not np.array_equal(w[:, :10], R.weights(np.arange(500), 10, seed=2))
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.15 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.05


def keys(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "id long").select("id", F.xxhash64(F.col("id").cast("string")).alias("h")).collect()
    return {r.id: r.h for r in rows}


def test_entropies_equal_a_plain_bootstrap(spark):
    rng = random.Random(3)
    rows = [(g, i, "".join(rng.choice("ab") for _ in range(4)), rng.randint(1, 5)) for i in range(300) for g in [rng.choice("xy")] for _ in range(rng.randrange(9))]
    rows = [(*k, n) for k, n in {(g, i, w): n for g, i, w, n in rows}.items()] + [("lone", 7000, "aaaa", 3), ("lone", 7000, "bbbb", 3)]
    df = spark.createDataFrame(rows, "g string, id long, kmer string, n long").repartition(5)
    got = {(r.g, r.replicate): r for r in R.replicate_entropy(df, "g", "id", 40, kmers=3).collect()}
    h = keys(spark, sorted({r[1] for r in rows}))
    drawn = {i: R.weights(np.array([k]), 40)[0] for i, k in h.items()}
    assert len(got) == 3 * 40
    for (g, b), r in got.items():
        n = Counter()
        for group, i, w, c in rows:
            if group == g:
                n[w] += c * int(drawn[i][b - 1])
        total = sum(n.values())
        assert r.total == total
        if total:
            assert abs(r.shannon + sum(c / total * math.log(c / total) for c in n.values() if c)) < 1e-9
        else:
            assert g == "lone" and r.shannon is None
    assert R.replicate_entropy(df.limit(0), "g", "id", 5).count() == 0


def test_interval_of_many_replicates(spark):
    """The mean of the replicates is near the sample's entropy, and their spread is what the delta method gives."""
    rng = random.Random(5)
    rows = [("g", i, rng.choice("aabc"), 1) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, id long, kmer string, n long")
    p = [n / 400 for n in Counter(r[2] for r in rows).values()]
    entropy = -sum(x * math.log(x) for x in p)
    got = R.replicate_entropy(df, "g", "id", 10_000).agg(F.count("*").alias("n"), F.avg("shannon").alias("m"), F.stddev("shannon").alias("s")).first()
    sd = math.sqrt((sum(x * math.log(x) ** 2 for x in p) - entropy**2) / 400)
    assert got.n == 10_000 and abs(got.m - (entropy - 2 / 800)) < 0.002 and abs(got.s / sd - 1) < 0.05


def test_counts_by_group(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else "ab"[i % 2]) for i in range(500)], "id long, g string").repartition(6)
    got = {(r.g, r.replicate): (r.rows, r.n) for r in R.replicate_counts(df, "g", "id", 30).collect()}
    h = keys(spark, range(500))
    w = R.weights(np.array([h[i] for i in range(500)]), 30)
    groups = np.array([None if i % 7 == 0 else "ab"[i % 2] for i in range(500)], object)
    assert got == {(g, b + 1): (int((w[groups == g, b] > 0).sum()), int(w[groups == g, b].sum())) for g in ("a", "b", None) for b in range(30)}


def test_exploded_weights_have_no_cap(spark):
    w = folds.bootstrap_weights(spark.range(2000), "id", 20)
    got = w.agg(F.sum("weight").alias("n"), F.max("weight").alias("m")).first()
    assert abs(got.n / 40_000 - 1) < 0.03 and got.m >= 5


def test_large_counts_and_all_steps_of_the_distribution(spark):
    """Counts beyond 16 bits, in one sequence or added up, and weights by table equal to those by comparison with every step."""
    w, steps = R.weights(np.arange(40), 3000), R.poisson_cdf()
    x = np.arange(40).astype(np.uint64)[:, None] + ((np.arange(1, 3001, dtype=np.uint64) + np.uint64(1 << 32)) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    assert np.array_equal(w, sum((u >= c).astype(int) for c in steps))
    rows = [("g", i, k, n) for i in range(60) for k, n in (("aaa", 70_000 if i % 20 == 0 else 9_000), ("bbb", 1 + i % 3), ("ccc", 4_000_000_000 * (i == 7) + 1))]
    got = {r.replicate: r for r in R.replicate_entropy(spark.createDataFrame(rows, "g string, id long, kmer string, n long"), "g", "id", 20).collect()}
    drawn = {i: R.weights(np.array([k]), 20)[0] for i, k in keys(spark, range(60)).items()}
    for b in range(20):
        n = Counter()
        for _, i, k, c in rows:
            n[k] += c * int(drawn[i][b])
        total = sum(n.values())
        assert got[b + 1].total == total and abs(got[b + 1].shannon + sum(c / total * math.log(c / total) for c in n.values())) < 1e-9


def test_counts_in_parts_and_of_all_sizes(spark):
    """Parts of a sequence's counts add up like their sums; frequent, rare and very large counts meet in one block."""
    rng = random.Random(11)
    rows = [("g", i, w, rng.randint(1, 4)) for i in range(400) for w in ("often", "mostly", "half") if w != "half" or i % 2] + [("g", i, f"rare{i % 7}", 2) for i in range(0, 400, 40)]
    rows += [("g", 3, "often", 1 << 23), ("g", 4, "large", 70_000), ("g", 5, "rare0", 60_000), ("g", 6, "rare0", 60_000), (None, 1, "often", 5)]
    df = spark.createDataFrame([(g, i, w, n) for g, i, w, n in rows for n in ((n // 2, n - n // 2) if n > 1 else (n,))], "g string, id long, kmer string, n long").repartition(3)
    h = keys(spark, range(400))
    drawn = np.stack([R.weights(np.array([h[i]]), 50)[0] for i in range(400)]).astype(float)
    got = {(r.g, r.replicate): r for r in R.replicate_entropy(df, "g", "id", 50).collect()}
    assert len(got) == 100
    for b in range(50):
        n = Counter()
        for g, i, w, c in rows:
            n[w] += c * drawn[i, b] if g else 0
        total = sum(n.values())
        assert got["g", b + 1].total == total and abs(got["g", b + 1].shannon + sum(c / total * math.log(c / total) for c in n.values() if c)) < 1e-9


def test_kmers_of_parts_give_the_same_intervals(spark):
    from assaylake.operators import kmers

    rng = random.Random(12)
    df = spark.createDataFrame([(i, "".join(rng.choice("abc") for _ in range(rng.choice([2, 30, 60])))) for i in range(40)], "id long, s string").selectExpr("'g' g", "id", "s")
    whole, parts = (R.replicate_entropy(kmers.kmer_counts(df, ["g", "id"], "s", [3], summed=x), "g", "id", 20) for x in (True, False))
    a, b = ({(r.g, r.replicate): (r.total, r.shannon) for r in x.collect()} for x in (whole, parts))
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and abs(a[k][1] - b[k][1]) < 1e-9 for k in a)
