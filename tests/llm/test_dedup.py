"""Exact, substring and near dedup against brute force."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from assaylake.llm import content_dedup, simhash, substring_dedup
from assaylake.llm.common import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_duplicates(odd_docs, no_docs):
    got = content_dedup.exact_duplicates(odd_docs, keep="max").collect()
    groups: dict = {}
    for r in odd_docs.collect():
        groups.setdefault((r.text or "").translate(LOWER), []).append(r.doc_id)
    want = sorted((str(i), max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert content_dedup.exact_duplicates(no_docs).count() == 0


def test_hot_text_crosses_partitions(spark):
    texts = ["same"] * 300 + [f"t{i}" for i in range(50)] + ["Same"] * 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    for keep, want in (("max", 649), ("min", 0)):
        got = content_dedup.exact_duplicates(docs, keep=keep)
        assert got.where("group_size = 600 AND keep_id = %d" % want).count() == 600
        assert got.where("kept").count() == 51
        kept = content_dedup.drop_exact_duplicates(docs, keep=keep).collect()
        assert len(kept) == 51 and want in {r.doc_id for r in kept}


def test_drop_keeps_columns(odd_docs, no_docs):
    kept = content_dedup.drop_exact_duplicates(odd_docs, keep="max")
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "5", "6", "7", "8", "4"][:0] + sorted(["2", "4", "5", "6", "7", "8", "None"])
    assert content_dedup.drop_exact_duplicates(no_docs).count() == 0


def removed_by_force(rows, window):
    first: dict = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        keep = [True] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                keep[p : p + window] = [False] * window
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out.append((str(i), len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD", 15)  # so that large keys are split
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 150)  # and there are many shards, waves and parts of waves
    monkeypatch.setattr(substring_dedup, "WAVE_BYTES", 20_000)
    rnd = random.Random(3)
    passages = [[f"p{k}_{j}" for j in range(n)] for k, n in enumerate((14, 12, 30))]
    rows = []
    for i in range(120):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(30))]
        for k, p in enumerate(passages):
            if i % (k + 2) == 0:
                at = rnd.randrange(len(w) + 1)
                w[at:at] = p[: rnd.choice([len(p), len(p) - 3])]
        if i % 10 == 3:
            w = ["a"] * 40
        rows.append((rnd.choice([i * 7 % 101, None]) if i % 20 == 0 else 1000 - i * 3, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeat_digests(docs, window=12).collect())
    assert got == removed_by_force(rows, 12)
    assert sum(r[2] for r in got) > 100
    texts = substring_dedup.remove_repeats(docs, window=12)
    assert sorted(len((r.text or "").split()) for r in texts.collect()) == sorted(n - k for _, n, k, _ in got)


def test_substring_dedup_odd(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeat_digests(odd_docs).collect())
    assert got == removed_by_force(rows, 50)
    out = substring_dedup.remove_repeats(odd_docs)
    assert out.columns == odd_docs.columns and {r.text for r in out.where("doc_id = 7").collect()} == {"end"}
    assert substring_dedup.repeat_digests(no_docs).count() == 0


def test_automaton_against_scan():
    rnd = random.Random(5)
    for _ in range(20):
        refs = [[rnd.choice([b"a", b"b"]) for _ in range(rnd.randrange(1, 30))] for _ in range(rnd.randrange(1, 12))]
        auto = substring_dedup.SuffixAutomaton()
        for i, r in enumerate(refs):
            auto.add(r, 10 * i)
        matcher = substring_dedup.Matcher(auto.pack())
        for _ in range(30):
            q = [rnd.choice([b"a", b"b", b"c"]) for _ in range(25)]
            for n in (1, 3, 6):
                for doc in (0, 35, 1000):
                    hit = [any(10 * i < doc and r[j : j + n] == q[p : p + n] for i, r in enumerate(refs) for j in range(len(r))) for p in range(len(q) - n + 1)]
                    want = {x for p, h in enumerate(hit) if h for x in range(p, p + n)}
                    got = matcher.spans(q, n, doc)
                    assert {x for a, e in got for x in range(a, e)} == want
                    assert all(e < a for (_, e), (a, _) in zip(got, got[1:], strict=False)) or n > 1
    assert substring_dedup.Matcher(substring_dedup.SuffixAutomaton().pack()).spans([b"a"], 1, 5) == []


def components_by_force(ids, fps):
    near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= 3
    label = np.array([np.inf if i is None else i for i in ids])
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return label
        label = new


def test_simhash_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 6)  # so that keys are compared in parts
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    fps = list(base)
    for b in base[:12]:
        x = int(b)
        for _ in range(15):
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            x = x - (1 << 64) if x >> 63 == 1 else x
            fps.append(((x + (1 << 63)) % (1 << 64)) - (1 << 63))
    fps = np.array(fps, np.int64)
    ids = rng.permutation(len(fps))
    df = spark.createDataFrame([(int(i), int(f)) for i, f in zip(ids, fps, strict=True)], "doc_id long, fp long")
    links = simhash.near_links(df, block=6)
    roots = {r.node: r.root for r in components(links).collect()}
    label = components_by_force(ids.tolist(), fps)
    by_root: dict = {}
    for f, want in zip(fps.tolist(), label.tolist(), strict=True):
        by_root.setdefault(roots.get(f, f), set()).add(want)
    assert all(len(v) == 1 for v in by_root.values()) and len(by_root) == len(set(label.tolist()))


def test_simhash_odd(odd_docs, no_docs):
    got = simhash.simhash_components(odd_docs).collect()
    ids = [r.doc_id for r in got]
    label = components_by_force(ids, np.array([r.fp for r in got], np.int64))
    assert [r.component_id for r in got] == [None if x == np.inf else int(x) for x in label]
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fp == by_id[2].fp and by_id[3].fp == by_id[4].fp == by_id[5].fp == 0
    assert by_id[6].component_id == by_id[7].component_id == 6
    assert simhash.drop_near_duplicates(odd_docs.where("doc_id > 1")).columns == odd_docs.columns
    assert simhash.simhash_components(no_docs).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
    assert components(edges.where(F.lit(False))).count() == 0


def test_fingerprint_equals_a_plain_version():
    import xxhash

    for text in ["One two THREE four five", "a a a a", "Ünï Code x", "one two", "", " \t\n", " a\x1cb c d", "word " * 3000, None]:
        words = [w for w in (text or "").translate(LOWER).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) % (1 << 64) == want
