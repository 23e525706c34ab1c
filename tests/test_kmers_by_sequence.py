"""k-mers counted by a million letters at a time, and sums of sequences that shuffle no k-mer, against plain loops."""

import random
from collections import Counter

import numpy as np

from assaylake.operators import kmers as K


def plain(texts, k):
    return Counter((i % 3, t[at : at + k]) for i, t in enumerate(texts) for at in range(len(t) - k + 1))


def test_counts_of_any_letters():
    rng = random.Random(1)
    texts = ["", "a", "\0\0a\0", "é\U0001f600b" * 9, *["".join(rng.choice("abé\U0001f600") for _ in range(n)) for n in (3, 40, 300)], "".join(map(chr, range(200, 1500))) * 2]
    for k in (1, 3, 8, 21):
        of, letters, n = K.count_kmers(texts, [i % 3 for i in range(len(texts))], k)
        found = list(zip(of.tolist(), K._strings(letters).to_pylist(), strict=True))
        assert dict(zip(found, n.tolist(), strict=True)) == plain(texts, k) and found == sorted(found)
    assert len(K.count_kmers(["ab"], [0], 3)[0]) == 0 and np.array_equal(K.count_kmers(["aaaa"], [7], 2)[2], [3])


def rows(rng):
    texts = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    return [(i if i < 36 else None if i > 37 else 5, t) for i, t in enumerate(texts)] + [(77, "ab" * 200), (78, None), (79, "")]


def test_sums_of_sequences(spark, monkeypatch):
    monkeypatch.setattr(K, "LONG", 64)
    monkeypatch.setattr(K, "AT_ONCE", 100)
    made = rows(random.Random(2))
    want = {}
    for key, t in made:
        for at in range(len(t or "") - 2):
            want.setdefault(key, Counter())[t[at : at + 3]] += 1
    df = spark.createDataFrame(made, "e int, s string").repartition(3)
    got = {r.e: (r.total, r.richness, r.singletons, r._max, r.low, r.high) for r in K.sums_by_sequence(df, "e", "s", 3).collect()}
    assert got == {e: (sum(c.values()), len(c), sum(n == 1 for n in c.values()), max(c.values()), min(c), max(c)) for e, c in want.items()}
    plainly = {r.e: tuple(r) for r in K.kmer_assessment(df, ["e"], "s", [3]).collect()}
    for r in K.kmer_assessment_by_sequence(df, "e", "s", 3).collect():
        assert all(x == y or abs(x - y) < 1e-12 for x, y in zip(r, plainly[r.e], strict=True) if x is not None)
    assert K.sums_by_sequence(df.limit(0), "e", "s", 3).count() == 0


def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(K, "LONG", 16)
    texts = [t for _, t in rows(random.Random(3)) if t]
    df = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)], "g int, s string")
    for ks in ([2, 4, 5], [3]):
        got = {(r.g, r.k, r.kmer): r.n for r in K.kmer_counts(df, ["g"], "s", ks).collect()}
        assert got == {(g, k, w): n for k in ks for (g, w), n in plain(texts, k).items()}


def test_rolling_up_shuffles_nothing_more(spark):
    df = spark.createDataFrame([(1, "abcdef")], "g int, s string")
    plan = K.kmer_counts(df, ["g"], "s", [2, 3, 4])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
