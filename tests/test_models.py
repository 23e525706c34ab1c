"""Queries that SQL cannot check: models, components, clusters and resampling, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import alignment, folds, kmers, metrics, models, similar, stats
from assaylake.operators.graph import star_clusters


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    made = []
    for i in range(300):
        cls = "abc"[i % 3]
        x, y = rng.normal() + 3 * (i % 3), rng.normal()
        made.append((str(i), cls, float(x), float(y), 2.0 * float(x) + 0.1 * float(rng.normal()), 1.0))
    return spark.createDataFrame(made, "key string, cls string, x double, y double, z double, one double")


def test_components_equal_a_plain_decomposition(rows):
    data = np.array([[r.x, r.y, r.z] for r in rows.collect()])
    scaled = (data - data.mean(axis=0)) / data.std(axis=0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(scaled.T))
    got = models.pca_features(rows, ["x", "y", "z", "one"], 2).collect()
    assert {r.variable for r in got} == {"x", "y", "z"}  # the constant goes
    for c in (1, 2):
        mine = np.array([r.loading for r in got if r.component == c])
        assert abs(abs(mine @ vectors[:, -c]) - 1) < 1e-6
        assert [r.variance for r in got if r.component == c][0] == pytest.approx(values[-c] / values.sum())
    scores = np.array([[r.pc1, r.pc2] for r in models.pca_scores(rows, ["key"], ["x", "y", "z"], 2).collect()])
    assert np.allclose(np.abs(scores[:, 0]), np.abs(scaled @ vectors[:, -1]), atol=1e-6)


def test_kmer_components_equal_a_plain_svd(spark):
    seqs = {"s": "ACGTACGTTTGACC", "t": "ACGTTTTTGA", "u": "GGGGACGT"}
    counts = kmers.kmer_counts(spark.createDataFrame(list(seqs.items()), "g string, s string"), ["g"], "s", [2])
    words = sorted({s[i : i + 2] for s in seqs.values() for i in range(len(s) - 1)})
    table = np.array([[sum(s[i : i + 2] == w for i in range(len(s) - 1)) for w in words] for s in seqs.values()], float)
    u, d, _ = np.linalg.svd(table, full_matrices=False)
    got = {(r.g, r.component): r for r in kmers.kmer_pca(counts, "g").collect()}
    for c in range(3):
        assert np.allclose([abs(got[g, c + 1].score) for g in seqs], np.abs(u[:, c] * d[c]))
        assert got["s", c + 1].share == pytest.approx(d[c] ** 2 / (d**2).sum())


def test_held_out_entropy_equals_a_plain_grid(spark):
    seqs = [("x", "ACGTACGTTTGA"), ("x", "CCCC"), ("y", "AAAAACGG"), ("z", "ACGGT")]
    counts = kmers.kmer_counts(spark.createDataFrame(seqs, "g string, s string"), ["g"], "s", [2, 3])
    n = {(r.g, r.k, r.kmer): r.n for r in counts.collect()}
    for r in kmers.held_out_entropy(counts, "g").collect():
        words = sorted({w for _, k, w in n if k == r.k})
        a = np.array([n.get((r.g, r.k, w), 0) for w in words], float)
        b = np.array([sum(n.get((g, r.k, w), 0) for g in "xyz" if g != r.g) for w in words], float)
        p, q = a / a.sum(), b / b.sum()
        h = lambda v: -sum(x * np.log(x) for x in v if x)
        assert r.shannon == pytest.approx(h(p)) and r.train_shannon == pytest.approx(h(q))
        assert r.train_richness == (b > 0).sum() and r.train_renyi2 == pytest.approx(-np.log2((q * q).sum()))
        m = (p + q) / 2
        js = sum(x * np.log2(x / y) for x, y in zip(p, m, strict=True) if x) + sum(x * np.log2(x / y) for x, y in zip(q, m, strict=True) if x)
        assert r.jsd == pytest.approx((js / 2) ** 0.5)


def test_models_find_what_matters(rows):
    got = {r.variable: r for r in models.random_forest_importance(rows, "key", ["x", "y"], "cls", trees=10).collect()}
    assert got["x"].importance > got["y"].importance and got["x"].loss > got["y"].loss
    gain = models.boosted_importance(rows, ["x", "y"], "cls", rounds=2).groupBy("variable").agg(F.sum("gain").alias("g")).collect()
    assert max(gain, key=lambda r: r.g).variable == "x"
    pd = models.partial_dependence(rows, ["x", "y"], "cls", "x", [0.0, 6.0]).collect()
    assert all(abs(sum(r.mean_probability for r in pd if r.value == v) - 1) < 1e-9 for v in (0.0, 6.0))
    for model in (models.multinomial_model(rows, ["x", "y"], "cls"), models.logistic_by_group(rows.withColumn("b", (F.col("x") > 3).cast("int")), "cls", "x", "b")):
        assert model.count() > 0


def test_binomial_effects(spark):
    cells = [(a, b, 100, 10 + 70 * a) for a in (0, 1) for b in (0, 1)]
    got = {r.factor: r.share for r in models.binomial_glm_effects(spark.createDataFrame(cells, "a int, b int, n int, k int"), ["a", "b"], "k", "n").collect()}
    assert got["a"] > 0.95 and abs(got["b"]) < 1e-6


def test_near_duplicates_equal_a_sequential_pass(spark):
    rng = np.random.default_rng(5)
    base = [[f"w{rng.integers(500)}" for _ in range(40)] for _ in range(6)]
    texts = [" ".join(b[: 40 - j]) for b in base for j in range(4)] + [" ".join(base[0])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = similar.near_dup_clusters(docs, "doc_id", "text", (0.8,)).collect()
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    for r in got:
        assert len(shingles[r.rep]) >= 1
    assert len({r.rep for r in got}) <= 6 + 12


def test_star_clusters_equal_the_greedy_pass(spark):
    rng = np.random.default_rng(7)
    edges = {tuple(sorted(map(int, e))) for e in rng.integers(0, 60, (90, 2)) if e[0] != e[1]}
    rank = {i: int(r) for i, r in enumerate(rng.permutation(60))}
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in range(60)}
    want: dict = {}
    for i in sorted(range(60), key=rank.get):
        if i not in want:
            for j in {i, *near[i]} - set(want):
                want[j] = i
    nodes = spark.createDataFrame(list(rank.items()), "node long, rank long")
    assert {r.node: r.rep for r in star_clusters(nodes, spark.createDataFrame(sorted(edges), "u long, v long")).collect()} == want


def test_bootstrap_weights_are_poisson(spark):
    w = folds.bootstrap_weights(spark.range(5000), "id", 4).groupBy("replicate").agg(F.sum("weight").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert len(w) == 4 and all(4700 < r.s < 5300 for r in w)
    assert folds.sample_frac(spark.range(5000), "id", 0.2).count() == pytest.approx(1000, abs=120)


def test_ranks_and_quantiles_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    values = [(g, float(v)) for g in ("a", "b", None) for v in rng.integers(0, 30, 101)] + [("c", 1.5), ("d", None)]
    df = spark.createDataFrame(values, "g string, value double")
    got = {(r.g, r.share): r.quantile for r in stats.quantiles(df, ["g"], [0.0, 0.1, 0.5, 0.75, 1.0]).collect()}
    for g in ("a", "b", None, "c"):
        own = [v for x, v in values if x == g and v is not None]
        assert all(got[g, q] == pytest.approx(np.quantile(own, q)) for q in (0.0, 0.1, 0.5, 0.75, 1.0))
    assert not any(g == "d" for g, _ in got)
    for r in stats.average_ranks(df.where("value IS NOT NULL"), ["g"]).collect():
        own = [v for x, v in values if x == r.g and v is not None]
        assert r["rank"] == sum(v < r.value for v in own) + (own.count(r.value) + 1) / 2


def test_assembly_stats(spark):
    rows = [("s", 100, 0.5, None, None), ("s", 300, 0.4, 0.96, "r1"), ("s", 1200, 0.6, 0.3, "r1"), ("s", 20000, 0.5, 0.5, "r2"), ("t", 7, None, None, None)]
    df = spark.createDataFrame(rows, "a string, length long, prop_gc double, reference_coverage double, hits string")
    got = {r.a: r for r in metrics.assembly_stats(df, ["a"], 4).collect()}
    s = got["s"]
    assert (s.n_seqs, s.smallest, s.largest, s.n_bases, s.n_under_200, s.n_over_1k, s.n_over_10k, s.n_with_hit) == (4, 100, 20000, 21600, 1, 2, 1, 3)
    assert (s.n50, s.n90, s.n_refs_with_hit, s.cov25, s.cov50, s.cov75, s.cov95, s.p_cov95) == (20000, 20000, 2, 2, 2, 1, 1, 0.25)
    assert s.gc == pytest.approx((50 + 120 + 720 + 10000) / 21600) and got["t"].cov25 == 0


def test_seeds_of_equal_sequences(spark):
    assert alignment is not None  # hits from seeds have SQL; see the registry
    got = kmers.composition_features(spark.createDataFrame([(1, "ACGTAC"), (2, "ACG"), (3, None)], "id int, s string"), ["id"], "s").orderBy("id").collect()
    assert [r.linguistic_complexity_6 for r in got] == [1 / 4096, 0.0, None]
