"""Language profiles, Merkle manifests and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import language_id, merkle, registry, spelling

SF = "/root/testdata/sf0.001"
SF_LARGER = "/root/testdata/sf0.01"


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# Language profiles


def plain_profile(text):
    made, s = np.zeros(language_id.DIMENSIONS), (text or "").lower()
    for i, c in enumerate(s):
        if c.isalpha():
            near = [s[j] if 0 <= j < len(s) and s[j].isalpha() else " " for j in (i - 1, i, i + 1)]
            v = [language_id.letter_vector(ord(x)).astype(int) for x in near]
            made += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    return made


TEXTS = ["The thing is", None, "", "123 !", "a", "Größe über été İstanbul \U0001d49c", "一个人在中文 word", "x" * 300 + " y"]


def test_profiles_equal_a_plain_loop(monkeypatch):
    want = np.stack([plain_profile(t) for t in TEXTS])
    assert np.array_equal(language_id.profiles(TEXTS), want)
    monkeypatch.setattr(language_id, "AT_ONCE", 3)
    assert np.array_equal(language_id.profiles(TEXTS), want)
    for characters in (1, 2, 7, 50):  # texts cut anywhere, and several of them together
        monkeypatch.setattr(language_id, "CHARACTERS", characters)
        assert np.array_equal(language_id.profiles(TEXTS), want)
    assert not language_id.profiles([None, ""]).any() and language_id.profiles([]).shape[0] == 0


def test_letter_vectors_are_nearly_orthogonal():
    v = np.stack([language_id.letter_vector(ord(c)) for c in "abcdefghij"]).astype(int)
    gram = v @ v.T / language_id.DIMENSIONS
    assert set(np.unique(v)) == {-1, 1} and abs(gram - np.eye(10)).max() < 0.12


def test_language_query_equals_a_plain_version(spark):
    got = {r.doc_id: r for r in registry.op11_language_id(spark, SF).collect()}
    rows = documents(spark, SF).select("doc_id", "text", "lang").collect()
    vectors = {r.doc_id: plain_profile(r.text) for r in rows}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    sums = defaultdict(lambda: np.zeros(language_id.DIMENSIONS))
    for r in rows:
        if not held[r.doc_id] and vectors[r.doc_id].any():
            sums[r.lang] += np.rint(vectors[r.doc_id] / np.linalg.norm(vectors[r.doc_id]) * language_id.UNIT)
    assert len(got) == len(rows)
    for r in rows:
        v = vectors[r.doc_id]
        cosines = {lang: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for lang, p in sums.items()} if v.any() else {"und": 0.0}
        best = max(sorted(cosines), key=cosines.get)
        assert (got[r.doc_id].held_out, got[r.doc_id].lang_pred) == (held[r.doc_id], best)
        assert abs(got[r.doc_id].score - max(cosines[best], 0)) < 1e-9


def test_language_of_held_out_documents(spark):
    got = registry.op11_language_id(spark, SF_LARGER).join(documents(spark, SF_LARGER).select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.99 * len(got) > 100


def test_language_of_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    train = language_id.train(odd_docs)
    found = [(r.text, r.lang_pred, r.score) for r in language_id.identify(odd_docs, train).collect()]
    assert len(found) == odd_docs.count()
    assert all((p, s) == ("und", 0.0) for t, p, s in found if not t or not t.strip()) and all(p != "und" and 0 < s <= 1 for t, p, s in found if t and t.strip())
    monkeypatch.setattr(language_id, "BLOCK", 2)  # more languages than a block holds
    again = language_id.train(odd_docs)
    assert again.count() == train.count() == 3
    assert sorted(found, key=str) == sorted([(r.text, r.lang_pred, r.score) for r in language_id.identify(odd_docs, again).collect()], key=str)
    untrained = language_id.identify(odd_docs, language_id.train(no_docs))
    assert {(r.lang_pred, r.score) for r in untrained.collect()} == {("und", 0.0)}
    assert language_id.identify(no_docs, train).count() == 0
    clash = odd_docs.withColumns({"score": F.lit("x"), "vector": F.lit(1), "a.b": F.lit(2)})
    out = language_id.identify(clash, train)
    assert out.columns == [*[c for c in clash.columns if c != "score"], "lang_pred", "score"] and out.first()["a.b"] == 2


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes, fanout):
    """The root, and of each node its (siblings before, siblings after) by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = i - i % fanout
            paths[leaf].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + fanout])))
            at[leaf] = i // fanout
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain_manifest(rows, fanout=3):
    """Rows (doc_id, source, lang, n_chars, text) to the contract's columns."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fanout) for s in names}
    root, over = plain_tree([trees[s][0] for s in names], fanout)
    made = []
    for s, above in zip(names, over, strict=True):
        for (_, _, leaf, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            whole = [*path, *above]
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            node = plain_leaf([*r[:4], r[4].replace("\n", "")]) if cut else leaf
            for before, after in whole:
                node = H(before, node, after)
            made.append((r[0], leaf, trees[s][0], root, H(*[b + a for b, a in whole]), node, node == root))
    return made


def test_manifest_query_equals_a_plain_version(spark):
    for sf in (SF, SF_LARGER):
        want = plain_manifest([tuple(r) for r in documents(spark, sf).select("doc_id", "source", "lang", "n_chars", "text").collect()])
        got = [tuple(r) for r in registry.op12_merkle_manifest(spark, sf).collect()]
        assert sorted(got) == sorted(want)
        assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("levels", [1, 2])
@pytest.mark.parametrize("fanout", [2, 3, 4])
def test_butterfly_over_many_blocks(spark, fanout, levels):
    rows = [(i, f"s{n}", None, i, f"t{i}") for n, size in enumerate([1, 2, 3, 4, 5, 7, 9, 10, 26, 27, 28, 55, 82, 100]) for i in range(size * 1000, size * 1000 + size)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    got = merkle.manifest(docs, "doc_id", "source", fields, fanout=fanout, levels=levels).withColumn("digest", merkle.proof_digest(F.col("proof"))).withColumn("fold", merkle.folded(F.col("leaf"), F.col("proof")))
    want = plain_manifest(rows, fanout)
    found = got.collect()
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, r.digest) for r in found) == sorted(r[:5] for r in want)
    assert all(r.fold == r.root for r in found)


def test_manifest_of_odd_rows(spark, odd_docs, no_docs):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = odd_docs.withColumns({"n_chars": F.length("text"), "g": F.lit(1), "rank": F.lit(2), "row.key": F.lit(3)})
    rows = [tuple(r) for r in docs.select(*fields).collect()]
    got = merkle.manifest(docs, "doc_id", "source", fields).withColumn("digest", merkle.proof_digest(F.col("proof")))
    assert sorted(map(str, [(r.doc_id, r.leaf, r.subroot, r.root, r.digest) for r in got.collect()])) == sorted(str(r[:5]) for r in plain_manifest(rows))
    empty = merkle.manifest(no_docs.withColumn("n_chars", F.lit(1)), "doc_id", "source", fields)
    assert empty.count() == 0


# Spelling variants


def edits(word, letters):
    places = range(len(word) + 1)
    return {word[:i] + word[i + 1 :] for i in places if i < len(word)} | {word[:i] + c + word[i + 1 :] for i in places if i < len(word) for c in letters} | {word[:i] + c + word[i:] for i in places for c in letters}


def plain_words(rows, drop_every):
    counts = Counter()
    for key, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{key}:{run}".encode())
            if drop_every and key is not None and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(counts, ratio=10):
    letters, forms, made = {c for w in counts for c in w}, {}, {}
    near = {w: [x for x in edits(w, letters) if x in counts and x != w] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        made[w] = (forms[w], root, n, len(near[w]), counts.get(forms[w]))
    return made


def test_spelling_query_equals_a_plain_version(spark):
    for sf in (SF, SF_LARGER):
        counts = plain_words([tuple(r) for r in documents(spark, sf).select("doc_id", "text").collect()], 31)
        got = {r.word: tuple(r)[1:] for r in registry.op13_spelling_variants(spark, sf).collect()}
        assert got == plain_variants(counts) and any(r[0] for r in got.values())


def test_small_cells_lose_no_pair(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcdeé") for _ in range(rng.choice([4, 5, 5, 6]))) for _ in range(4000)}
    words |= {"z" * 2500, "z" * 2499 + "y", "z" * 2501, "a", "ab", "b"}
    counts = {w: rng.choice([2, 3, 30, 400, 5000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(df, cell=64).collect()}
    assert got == plain_variants(counts)


def test_trees_hold_every_point_once_and_reach_all():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 4, (700, 6)).astype(np.int32)
    tree = spelling.Tree.grow(points, 16)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(700)) and len(tree.leaves) > 30
    reached = {(int(r), int(p)) for leaf, rows in tree.reach(points, 1, 1) for r in rows for p in tree.leaves[leaf]}
    for i in range(0, 700, 13):
        apart = points - points[i]
        near = np.flatnonzero((np.maximum(apart, 0).sum(1) <= 1) & (np.maximum(-apart, 0).sum(1) <= 1))
        assert {(i, int(j)) for j in near} <= reached
    assert len(reached) < 700 * 700 / 3
    same = spelling.Tree.grow(np.ones((50, 3), np.int32), 4)
    assert len(same.leaves) == 1


def test_spelling_of_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    for every in (None, 2):
        got = {r.word: r.n for r in spelling.corpus_words(odd_docs.withColumns({"word": F.lit(1), "run": F.lit(2)}), drop_every=every, least_length=4).collect()}
        counts = Counter()
        for key, text in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]{4,}", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
                h = zlib.crc32(f"{key}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if every and key is not None and h % every == 0 else run] += 1
        assert got == {w: n for w, n in counts.items() if n >= 2 and len(w) >= 4}
    assert spelling.group_variants(spelling.corpus_words(no_docs)).count() == 0
