"""One key that holds half of the rows: the same results as a plain pass, and no range of many times the usual size."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from assaylake.operators import hits, sets, stats


@pytest.fixture
def dealt(monkeypatch):
    """Rows of each range of every table that is dealt out."""
    sizes = []

    def watched(df, name, **how):
        made = written(df, name, **how)
        if "_p" in made.columns:
            sizes.append([r["count"] for r in made.groupBy("_p").count().collect()])
        return made

    written = stats.materialise
    monkeypatch.setattr(stats, "materialise", watched)
    monkeypatch.setattr(hits, "materialise", watched)
    return sizes


def evenly(dealt):
    return dealt and all(len(s) == 4 and max(s) <= 4 * median(s) for s in dealt)


@pytest.fixture(scope="module")
def intervals(spark):
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        s = rng.randint(1, 4000)
        a, b = s, s + rng.randint(0, 12)
        rows.append(("hot" if i % 2 else f"k{i % 700}", f"q{i}", *((a, b) if i % 5 else (b, a)), 4100))
    return rows, spark.createDataFrame(rows, "sseqid string, qseqid string, sstart long, send long, slen long").repartition(7)


def test_coverage_of_a_hot_subject(intervals, dealt):
    rows, df = intervals
    want = {}
    for k, _, a, b, _ in rows:
        want.setdefault(k, set()).update(range(min(a, b), max(a, b) + 1))
    got = hits.reference_coverage(df, ["sseqid"])
    assert {r.sseqid: r.covered for r in got.collect()} == {k: len(v) for k, v in want.items()}
    assert evenly(dealt)


def test_depth_of_a_hot_subject(intervals, dealt):
    rows, df = intervals
    depth = {}
    for k, _, a, b, _ in rows:
        for p in range(min(a, b), max(a, b) + 1):
            depth[k, p] = depth.get((k, p), 0) + 1
    got = hits.interval_depth(df, "sseqid", "sstart", "send").collect()
    assert {(r.sseqid, p): r.depth for r in got for p in range(r.pos, r.next_pos)} == depth
    assert evenly(dealt)
    assert hits.interval_depth(df.limit(0), "sseqid", "sstart", "send").count() == 0


def test_running_results_both_ways(spark, dealt):
    rng = random.Random(7)
    rows = [("hot" if i % 2 else rng.choice("abc"), i, rng.choice([None, rng.randint(0, 99)])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, i long, x long").repartition(5)
    runs = {"sum": stats.running_sum("x"), "most": stats.Run("x", F.max, F.greatest, own=False), "least": stats.Run("x", F.min, F.least, back=True), "later": stats.Run("i", F.min, F.least, back=True, own=False)}
    known = lambda xs: [x for x in xs if x is not None]
    for r in stats.over_ranges(df, ["g"], ["i"], runs).collect():
        own = [(i, x) for g, i, x in rows if g == r.g]
        before, after = known(x for i, x in own if i < r.i), known(x for i, x in own if i >= r.i)
        assert (r["sum"], r.most, r.least, r.later) == (sum(known(x for i, x in own if i <= r.i)), max(before, default=None), min(after, default=None), min((i for i, _ in own if i > r.i), default=None))
    assert evenly(dealt)


def test_n_and_l_of_a_hot_group(spark, dealt):
    rng = random.Random(8)
    rows = [("hot" if i % 2 else rng.choice("ab"), rng.randint(1, 5000)) for i in range(1200)]
    got = {(r.g, r.x): (r.n, r.l) for r in stats.nx_lx(spark.createDataFrame(rows, "g string, w long"), ["g"], "w", [10, 50, 90]).collect()}
    for g in ("hot", "a", "b"):
        widths = sorted((w for k, w in rows if k == g), reverse=True)
        for x in (10, 50, 90):
            total, at = 0, 0
            while total < sum(widths) * x / 100:
                total += widths[at]
                at += 1
            assert got[g, x] == (widths[at - 1], at)
    assert evenly(dealt)


def test_chunks_of_shuffled_rows_with_ties(spark, dealt):
    df = spark.createDataFrame([(i % 50, i) for i in range(1000)], "o long, i long").repartition(9, "i")
    got = sets.chunk_rows(df, "o", 30, ["i"]).collect()
    order = sorted((i % 50, i) for i in range(1000))
    assert {r.i: r.chunk for r in got} == {i: at // 30 + 1 for at, (_, i) in enumerate(order)}
    assert evenly(dealt)


def test_annotation_with_a_hot_subject(intervals):
    rows, df = intervals
    scored = df.withColumns({"length": F.lit(10), "bitscore": F.lit(1.0), "pident": F.lit(90.0), "max_coverage": F.lit(0.9)})
    got = {r.qseqid: r.max_contigs_per_subject for r in hits.hit_category(scored).collect()}
    n = {}
    for k, q, *_ in rows:
        n.setdefault(k, set()).add(q)
    assert got == {q: len(n[k]) for k, q, *_ in rows}
