"""Long k-mers counted minimizer by minimizer, in turns where a minimizer has many, against plain loops."""

import random
from collections import Counter

import numpy as np

from assaylake.operators import kmers as K


def texts(rng):
    made = ["".join(rng.choice("acgté\U0001f600") for _ in range(n)) for n in (20, 21, 22, 300, 900)]
    return [None, "", "short", *made, made[-1][100:700] + "x", "a" * 300, *[made[-2]] * 3]


def test_spectrum_in_small_turns(spark, monkeypatch):
    rows = [(i % 2 or None, t) for i, t in enumerate(texts(random.Random(8)))]
    df = spark.createDataFrame(rows, "g int, s string").repartition(3)
    for at_once, stretch in ((1 << 20, 1 << 16), (40, 16)):
        monkeypatch.setattr(K, "AT_ONCE", at_once)
        monkeypatch.setattr(K, "STRETCH", stretch)
        for k, m in ((21, 7), (4, 3)):
            want = Counter((g, t[at : at + k]) for g, t in rows if t for at in range(len(t) - k + 1))
            assert {(r.g, r.kmer): r.n for r in K.long_kmer_counts(df, ["g"], "s", k, m).collect()} == dict(want)
            spectrum = Counter((g, n) for (g, _), n in want.items())
            assert {(r.g, r.multiplicity): r.n_kmers for r in K.long_kmer_spectrum(df, ["g"], "s", k, m).collect()} == dict(spectrum)


def test_one_hash_of_different_kmers(monkeypatch):
    monkeypatch.setattr(K, "_hashed", lambda codes, k: np.zeros(max(len(codes) - k + 1, 0), np.uint64))
    got = [("".join(map(chr, w)), n, g) for of, letters, ns in K.count_runs(["abcabc", "abcd"], np.array([0, 1]), np.array([2, 5]), 3) for g, w, n in zip(of.tolist(), letters, ns.tolist(), strict=True)]
    assert sorted(got) == [("abc", 4, 0), ("abc", 5, 1), ("bca", 2, 0), ("bcd", 5, 1), ("cab", 2, 0)]


def test_no_kmer_leaves_the_task_that_counts_it(spark):
    df = spark.createDataFrame([(1, "abcdefabcdef")], "g int, s string")
    plan = K.long_kmer_spectrum(df, ["g"], "s", 3)._jdf.queryExecution().executedPlan().toString()
    assert "kmer#" not in plan and "Generate" not in plan and plan.count("MapInArrow") >= 2


def test_groups_of_a_kmer_are_dealt_once(spark, monkeypatch):
    """Counts of nested shares shuffle k-mers once for all cells, and a task counts a cell's pieces together."""
    df = spark.createDataFrame([(i, "abcabd") for i in range(40)], "id long, s string")
    plans = []
    whole = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **b: plans.append(self._jdf.queryExecution().executedPlan().toString()) or whole(self, *a, **b))
    assert K.nested_assessment(df, "id", "s", [3], 4, [0.5, 0.9]).count() == 8
    assert plans[-1].count("Exchange hashpartitioning") == 1 and "Sort [_g0" in plans[0]


def test_runs_are_packed_by_group_and_bucket():
    """Runs of a task travel in a row for each group and bucket, in a fraction of their letters, and come out with their counts."""
    rng = random.Random(10)
    own = ["".join(rng.choice("acgté\U0001f600") for _ in range(rng.randrange(21, 40))) for _ in range(400)] + ["x" * 70_000]
    rows = [(g, sum(map(ord, t)) % 50 - 25, t, 1 + i % 3) for i, t in enumerate(own) for g in ("a", None)]
    half = [K.pa.table([list(c) for c in zip(*some, strict=True)], names=["_g0", "_m", "_run", "_n"]) for some in (rows, rows[:500])]
    want = Counter()
    for g, m, t, n in [*rows, *rows[:500]]:
        want[g, t] += n
    got, places = Counter(), set()
    for b in K._packed(half, ["_g0"], 4):
        for r in b.to_pylist():
            runs, n = K._unpacked(r["_size"], r["_runs"])
            assert (r["_g0"], r["_b"]) not in places and 0 <= r["_b"] < 4
            places.add((r["_g0"], r["_b"]))
            got.update(dict(zip([(r["_g0"], t) for t in runs.to_pylist()], n.tolist(), strict=True)))
            assert len(r["_runs"]) < sum(len(t) for t in runs.to_pylist())
    assert got == want and len(places) == 8
