"""Mixing by Poisson replication, and nearest neighbours against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from assaylake.llm import mixing, vector_search
from assaylake.llm.registry import ORACLE_SQL, QUERIES


def test_mixing(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 == 9, None).otherwise("small").alias("source"), F.lit("t").alias("text"), F.lit(1).alias("copies"))
    rates = {r.source: r for r in mixing.source_rates(docs, weights={"big": 1.0, "small": 3.0}).collect()}
    assert math.isclose(rates["small"].rate, 0.75 * 4000 / 800) and rates[None].rate == 0
    mixed = mixing.mix_sources(docs, weights={"big": 1.0, "small": 3.0})
    got = mixed.collect()
    share = sum(r.source == "small" for r in got) / len(got)
    assert abs(share - 0.75) < 0.03 and all(r.source for r in got)
    keys = [r.mix_key for r in got]
    assert keys == sorted(keys) and len(set((r.doc_id, r.copy) for r in got)) == len(got)
    again = mixing.mix_sources(docs.repartition(7), weights={"big": 1.0, "small": 3.0}).collect()
    assert [(r.doc_id, r.copy) for r in again] == [(r.doc_id, r.copy) for r in got]


def test_poisson_draws(spark):
    us = [0.0, 1e-9, 0.1, 0.5, 0.9, 0.999999]
    for rate in (0.0, 0.3, 4.0, 900.0):
        got = [r.n for r in spark.createDataFrame([(u,) for u in us], "u double").select(mixing.poisson_draw(F.lit(rate), F.col("u")).alias("n")).collect()]
        cum, terms = 0.0, []
        for k in range(1200):
            cum += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else 1.0
            terms.append(cum)
        assert got == [sum(c <= u for c in terms) if rate else 0 for u in us]


def test_mixing_with_large_rates(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    got = mixing.mix_sources(docs, total=60_000.0).groupBy("doc_id").count().collect()
    assert len(got) == 3 and all(19_000 < r["count"] < 21_000 for r in got)


def test_rates_beyond_the_broadcast_bound_give_the_same_rows(spark, odd_docs, no_docs):
    want = sorted(map(str, mixing.mix_sources(odd_docs).collect()))
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert sorted(map(str, mixing.mix_sources(odd_docs).collect())) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert mixing.mix_sources(no_docs).count() == 0


def brute(rows, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in fine:
        if q % 20 == 0:
            scored = sorted((-float(np.add.accumulate(x * y)[-1]), i) for i, y in fine if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "PART", 64)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * 10.0 ** rng.integers(-3, 4)]) for i in range(400)]
    rows += [(400 + i, rows[20][1]) for i in range(60)]  # ties beyond k
    rows += [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [None] * 8), (504, [float("inf")] * 8), (None, [1.0] * 8), (520, [1.0, 2.0]), (521, [3.0, 1.0]), (540, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in vector_search.nearest_neighbours(df, F.col("id") % 20 == 0, query_block=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: v for q, v in brute(rows, 20).items() if v}
    assert vector_search.nearest_neighbours(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(30, 16)), rng.normal(size=(40, 16)) * 100
    near, error = vector_search.Int8Block(a).bounds(vector_search.Int8Block(b))
    assert (np.abs(near - a @ b.T) <= error).all()


def test_registry_names():
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in QUERIES}
    assert set(ORACLE_SQL) <= set(QUERIES)
