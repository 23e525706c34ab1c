"""k-mers of several lengths from one cut, nested shares of folds, and sparse rank correlation, against plain loops."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from assaylake.operators import kmers as K


def test_shorter_kmers_are_rolled_up(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "ab", "abc", "abcd", "aaaaaaaaaa", "é\U0001f600b" * 7, *["".join(rng.choice("abc") for _ in range(n)) for n in (5, 511, 512, 513, 516, 1030)]]
    df = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)], "g int, s string")
    for ks in ([2, 3, 5], [4, 1], [6, 6]):
        want = Counter((i % 3, k, t[at : at + k]) for i, t in enumerate(texts) if t for k in set(ks) for at in range(len(t) - k + 1))
        got = K.kmer_counts(df, ["g"], "s", ks)
        assert {(r.g, r.k, r.kmer): r.n for r in got.collect()} == dict(want)
    plan = K.kmer_counts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), ["lang"], "text", [4, 5, 6])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert K.kmer_counts(df.limit(0), ["g"], "s", [2, 3]).count() == 0


def test_runs_of_a_minimizer_hold_every_kmer_once(spark):
    rng = random.Random(9)
    texts = [None, "", "short", "é\U0001f600b" * 20, "a" * 200, *["".join(rng.choice("acgt") for _ in range(n)) for n in (20, 21, 22, 500, 3000)]]
    texts += [texts[-1][100:900] + "x"]
    df = spark.createDataFrame([(i % 2 or None, t) for i, t in enumerate(texts)], "g int, s string").repartition(4)
    for k, m in ((21, 7), (5, 7), (1, 1)):
        want = Counter((i % 2 or None, t[at : at + k]) for i, t in enumerate(texts) if t for at in range(len(t) - k + 1))
        assert {(r.g, r.kmer): r.n for r in K.long_kmer_counts(df, ["g"], "s", k, m).collect()} == dict(want)
    assert K.long_kmer_counts(df, [], "s", 21).count() == len({t[at : at + 21] for t in texts if t for at in range(len(t) - 20)})
    runs = [len(r) for _, r in K.minimizer_runs(texts[-2], 21, 7)]
    assert sum(n - 20 for n in runs) == 2980 and len(runs) < 2980 / 5  # rows that are shuffled, against k-mers
    plan = K.long_kmer_counts(df, ["g"], "s", 21)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert K.long_kmer_counts(df.limit(0), ["g"], "s", 21).count() == 0


def test_stretches_of_long_texts(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("acgt") for _ in range(700))
    monkeypatch.setattr(K, "STRETCH", 64)
    got = Counter(run[i : i + 21] for _, run in K.minimizer_runs(text, 21, 7) for i in range(len(run) - 20))
    assert got == Counter(text[i : i + 21] for i in range(len(text) - 20))
    by_kmer = {}
    for least, run in K.minimizer_runs(text, 21, 7):
        for i in range(len(run) - 20):
            assert by_kmer.setdefault(run[i : i + 21], least) == least


def unit(seed, key):
    return int(hashlib.md5(f"{seed}-{key}".encode()).hexdigest()[:13], 16) / 2**52


def test_nested_shares_equal_a_loop_over_cells(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "".join(rng.choice("abc") for _ in range(rng.randrange(30)))])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, s string").repartition(5)
    shares = [0.2, 0.5, 0.9]
    got = {(r.fold, r.fraction, r.k): r for r in K.nested_assessment(df, "id", "s", [2, 3], 4, shares).collect()}
    seen = 0
    for fold in range(1, 5):
        for share in shares:
            for k in (2, 3):
                n = Counter(t[at : at + k] for i, t in rows if t and int(unit(1, i) * 4) + 1 != fold and unit(2, i) < share for at in range(len(t) - k + 1))
                total = sum(n.values())
                if not total:
                    assert (fold, share, k) not in got
                    continue
                seen += 1
                r = got[fold, share, k]
                h = -sum(c / total * math.log(c / total) for c in n.values())
                assert (r.total, r.richness) == (total, len(n)) and abs(r.shannon - h) < 1e-9 and (len(n) == 1 or abs(r.evenness - h / math.log(len(n))) < 1e-9)
    assert seen == len(got) > 20
    assert K.nested_assessment(df.limit(0), "id", "s", [2], 4, shares).count() == 0


def plain_ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def test_correlation_of_sparse_profiles(spark):
    rng = random.Random(4)
    words = [a + b for a in "abcdef" for b in "abcdef"]
    profiles = {s: {w: rng.randint(1, 4) for w in rng.sample(words, n)} for s, n in zip("pqrst", (5, 20, 30, 1, 12), strict=True)}
    profiles["t"] = {"zz": 3, "yy": 1}  # shares nothing
    df = spark.createDataFrame([(s, w, n) for s, p in profiles.items() for w, n in p.items()], "s string, kmer string, n long")
    universe = sorted({w for p in profiles.values() for w in p})
    got = {(r.a, r.b): r.rho for r in K.sample_correlation(df.withColumnRenamed("s", "sample"), "sample").collect()}
    assert len(got) == 10
    for (a, b), rho in got.items():
        x, y = (plain_ranks([profiles[s].get(w, 0) for w in universe]) for s in (a, b))
        m = (len(universe) + 1) / 2
        want = sum((i - m) * (j - m) for i, j in zip(x, y, strict=True)) / math.sqrt(sum((i - m) ** 2 for i in x) * sum((j - m) ** 2 for j in y))
        assert abs(rho - want) < 1e-9
    assert K.sample_correlation(df.where(F.lit(False)), "s").count() == 0


def test_words_travel_packed_and_are_rolled_up():
    """Counted words, some of fewer letters, in a row for each group and bucket of first letters; whatever their letters, they come out as they were."""
    rng = random.Random(13)
    for letters in ("abc", "aÿþ", "a\uffff\ufffe", "a\U0001f600\x00", "".join(map(chr, range(60, 500)))):
        words = Counter({(rng.randrange(2), "".join(rng.choice(letters) for _ in range(rng.choice([2, 3, 8, 8, 8])))): rng.choice([1, 254, 255, 256, 65_535, 70_000]) for _ in range(300)})
        rows = np.full((len(words), 8), K.NONE)
        for row, (_, w) in zip(rows, words, strict=True):
            row[: len(w)] = [ord(c) for c in w]
        got, places = Counter(), []
        for g, b, packed in K._packed_words(np.array([g for g, _ in words]), rows, np.array(list(words.values())), 2, 5):
            places.append((g, b))
            for k, found, n in K.rolled_up(*K._unpacked_words(packed, 8), [2, 3, 8]):
                got.update({(g, k, "".join(map(chr, w))): m for w, m in zip(found.tolist(), n.tolist(), strict=True)})
        want = Counter()
        for (g, w), n in words.items():
            for k in (2, 3, 8):
                if k <= len(w):
                    want[g, k, w[:k]] += n
        assert got == want and len(places) == len(set(places))


def test_lengths_shuffle_no_row_for_a_word(spark):
    df = spark.createDataFrame([(i % 2, "abcabdabe") for i in range(20)], "g int, s string")
    plan = K.kmer_counts(df, ["g"], "s", [2, 3])._jdf.queryExecution().executedPlan().toString()
    assert "_words" in plan and "Generate" not in plan.split("MapInArrow")[0] and plan.count("Exchange hashpartitioning") == 1
