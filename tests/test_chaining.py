"""Chains of anchors against quadratic chaining, and hits with planted mismatches, gaps and reversals."""

import random
from itertools import groupby

import numpy as np
from pyspark.sql import functions as F

from assaylake.operators import alignment as A
from assaylake.operators import chaining as C


def quadratic(rows, match, gap):
    score, prior = [0] * len(rows), [-1] * len(rows)
    for j in sorted(range(len(rows)), key=lambda j: (rows[j][0], j)):
        qs, qe, ss, se = rows[j]
        best = max(((score[i] - gap * ((qs - b - 1) + (ss - d - 1)), -i) for i, (_, b, _, d) in enumerate(rows) if b < qs and d < ss), default=(0, 1))
        score[j] = match * (qe - qs + 1) + max(best[0], 0)
        prior[j] = -best[1] if best[0] > 0 else -1
    return score, prior


def test_scores_equal_quadratic_chaining():
    rng = random.Random(8)
    for trial in range(200):
        rows = set()
        for _ in range(rng.choice([1, 2, 10, 60])):
            q, s, n = rng.randint(1, 80), rng.randint(1, 80), rng.randint(1, 9)
            rows.add((q, q + n - 1, s, s + n - 1))
        rows = sorted(rows)
        match, gap = rng.choice([(2, 1), (1, 0), (5, 2), (1, 3)])
        assert C.chain_scores(np.array(rows), match, gap) == quadratic(rows, match, gap)
        chains = C.best_chains(np.array(rows), match, gap, 0)
        flat = [i for c, _ in chains for i in c]
        assert len(flat) == len(set(flat)) and max(s for _, s in chains) == max(quadratic(rows, match, gap)[0])
        for chain, score in chains:  # scores are those of what is in the chain
            own = [rows[i] for i in chain]
            assert all(a[1] < b[0] and a[3] < b[2] for a, b in zip(own, own[1:], strict=False))
            assert score == sum(match * (r[1] - r[0] + 1) for r in own) - sum(gap * (b[0] - a[1] - 1 + b[2] - a[3] - 1) for a, b in zip(own, own[1:], strict=False))


def plain_anchors(q, s, n):
    cells = {(i, j) for i in range(len(q) - n + 1) for j in range(len(s) - n + 1) if q[i : i + n] == s[j : j + n]}
    made = []
    for _, own in groupby(sorted(cells, key=lambda c: (c[0] - c[1], c[0])), key=lambda c: c[0] - c[1]):
        own = list(own)
        starts = [c for k, c in enumerate(own) if not k or own[k - 1][0] != c[0] - 1]
        for i, j in starts:
            m = 0
            while (i + m, j + m) in cells:
                m += 1
            made.append((i + 1, i + m + n - 1, j + 1, j + m + n - 1))
    return sorted(made)


def test_hits_equal_a_plain_version(spark):
    rng = random.Random(9)
    vocabulary = [f"w{c}{d}" for c in "abcde" for d in "xy"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    subjects = {i: text(rng.choice([3, 40, 60])) for i in range(6)}
    queries = {}
    for i in range(12):
        own = list(subjects[rng.randrange(6)])
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = text(rng.randrange(3))
        queries[i] = own if i % 3 else own[::-1]
    frame = lambda d: spark.createDataFrame([(k, " ".join(v)) for k, v in d.items()] + [(99, None), (98, "")], "id long, text string")
    clean = lambda ws: ["w" + w[1:] for w in ws]
    found = A.maximal_matches(frame(queries), frame(subjects), "id", "id", "text", "text", n=3, both_ways=True)
    got = sorted((r.qseqid, r.sseqid, r.qstart, r.qend, r.sstart, r.send, r.matched, r.bitscore) for r in C.chained_hits(found, least=6).collect())
    want = []
    for q, a in queries.items():
        for s, b in subjects.items():
            for back in (False, True):
                rows = plain_anchors(clean(a), clean(b[::-1] if back else b), 3)
                for chain, score in C.best_chains(np.array(rows), 2, 1, 6) if rows else []:
                    own = [rows[i] for i in chain]
                    start, end = own[0][2], own[-1][3]
                    place = (len(b) + 1 - start, len(b) + 1 - end) if back else (start, end)
                    want.append((q, s, own[0][0], own[-1][1], *place, sum(r[1] - r[0] + 1 for r in own), float(score)))
    assert got == sorted(want) and any(r[4] > r[5] for r in got)


def test_mismatches_and_gaps_lower_the_identity(spark):
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in "aeiou"]
    changed = [*words[:10], "zz", *words[11:25], *words[27:40], "yy", "xx", *words[40:]]
    q = spark.createDataFrame([("gaps", " ".join(changed)), ("back", " ".join(words[::-1])), ("none", "nothing is shared here at all")], "id string, text string")
    s = spark.createDataFrame([("s", " ".join(words))], "id string, text string")
    got = {r.qseqid: r for r in C.chained_hits(A.maximal_matches(q, s, "id", "id", "text", "text", n=4, both_ways=True)).collect()}
    assert set(got) == {"gaps", "back"}
    r = got["gaps"]
    assert (r.qstart, r.qend, r.sstart, r.send, r.n_anchors, r.matched, r.length) == (1, 50, 1, 50, 4, 47, 50) and r.pident == 94.0
    assert (got["back"].sstart, got["back"].send, got["back"].pident) == (50, 1, 100.0)
    assert C.chained_hits(A.maximal_matches(q.limit(0), s, "id", "id", "text", "text")).count() == 0


def test_a_passage_that_many_share_makes_a_row_for_each_two_texts(spark):
    """Not one for each of its words: places within it have one neighbour, so their classes never meet."""
    rng = random.Random(1)
    letters = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(letters() for _ in range(300))
    frame = lambda n: spark.createDataFrame([(i, f"{letters()} {letters()} {passage} {letters()}") for i in range(n)], "id long, text string")
    q, s = A._places(frame(40), "id", "text", 4), A._places(frame(30), "id", "text", 4).withColumn("back", F.lit(False))
    assert q.join(s, "seed").count() == 297 * 40 * 30
    assert A._ends(q, s, "before").count() == A._ends(q, s, "after").count() == 40 * 30
    got = A.maximal_matches(frame(40), frame(30), "id", "id", "text", "text", n=4).collect()
    assert len(got) == 40 * 30 and {(r.qstart, r.qend, r.sstart, r.send) for r in got} == {(3, 302, 3, 302)}


def test_one_way(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "id long, text string")
    r = A.maximal_matches(d, d.select("id", F.lit("f e d c b a").alias("text")), "id", "id", "text", "text", n=4)
    assert r.count() == 0


def test_places_without_a_shared_seed_are_not_joined(spark, monkeypatch):
    from assaylake.operators import alignment as A

    written = {}
    monkeypatch.setattr(A, "materialise", lambda df, name: written.setdefault(name, df), raising=False)
    docs = spark.createDataFrame([(i, " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(20))) for i in range(10)], "d long, t string")
    items = spark.createDataFrame([(7, "x x " + " ".join(f"w{chr(97 + 3)}{chr(97 + j)}" for j in range(5, 11)) + " y y")], "i long, t string")
    got = A.maximal_matches(docs, items, "d", "i", "t", "t", n=4).collect()
    assert [(r.qseqid, r.sseqid, r.qstart, r.qend, r.sstart, r.send) for r in got] == [(3, 7, 6, 11, 3, 8)]
    assert written["query-places"].count() == 3
