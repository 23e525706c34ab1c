"""Bounds of memory and output, errors that are named, and plain versions of the toxicity model and of token lengths."""

import math
import time
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

from assaylake.llm import content_dedup, html_text, simhash, token_counts, token_store, toxicity, vector_search


@pytest.mark.parametrize("depth", [0, 9])
@pytest.mark.parametrize("rows", ["<tr>" + "<td>x</td>" * 50_000 + "</tr>" + "<tr><td>y</td></tr>" * 50_000, "<tr>" + "<td>x</td>" * 50_000 + "<td>" + "z<br>" * 50_000 + "</td></tr>"])
def test_wide_and_tall_tables_are_linear(rows, depth):
    page = "<table><tr><td>" * depth + f"<table>{rows}</table>" + "</table>" * depth
    began = time.process_time()
    text = html_text.html_to_text(page)
    assert time.process_time() - began < 12 and len(text) < 40 * len(page)
    assert text.count("x") == 50_000 and text.count("y") + text.count("z") == 50_000


def test_small_tables_stay_aligned():
    assert html_text.html_to_text("<table><tr><td>a<td>bbbb<td>c<tr><td>dd<td><td>e</table>") == "a   bbbb  c\ndd        e"


def test_tiles_bound_what_a_task_holds():
    rng = np.random.default_rng(3)
    asking = vector_search.QueryBlock(np.arange(vector_search.QUERY_BLOCK), rng.normal(size=(vector_search.QUERY_BLOCK, 256)), 20)
    x = rng.normal(size=(vector_search.TILE, 256))
    tracemalloc.start()
    asking.meet(np.arange(10_000, 10_000 + len(x)), x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6


def plain_buckets(text):
    s, made = (text or "").lower(), []
    for n in toxicity.GRAMS:
        for i in range(len(s) - n + 1):
            h = ord(s[i])
            for c in s[i + 1 : i + n]:
                h = (h * 0x01000193 + ord(c)) % 2**32
            made.append(((h ^ n) * 0x9E3779B1 % 2**32) >> (32 - toxicity.BITS))
    return made


def test_toxicity_equals_a_plain_fit(spark):
    """Ratios of naive Bayes, scaled features and the regularised optimum, all recomputed."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(260):
        toxic = i % 3 == 0
        text = " ".join(rng.choice(["tolu", "mera", "ZÜRB"] if toxic and rng.random() < 0.9 else ["tolu", "mera", "sind"], 12))
        rows.append((i, text))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    taught = [(t, labels[i][1]) for i, t in rows if not spark_held_out(i)]
    n = Counter(y for _, y in taught)
    counts = {y: Counter(b for t, own in taught if own == y for b in set(plain_buckets(t))) for y in (0, 1)}
    share = n[1] / len(taught)
    ratios = {b: math.log((counts[1][b] + toxicity.SMOOTHING * share) / n[1]) - math.log((counts[0][b] + toxicity.SMOOTHING * (1 - share)) / n[0]) for b in counts[0] | counts[1]}
    ratios = {b: r for b, r in ratios.items() if abs(r) >= toxicity.LEAST_RATIO}
    assert set(np.flatnonzero(model.weights).tolist()) == set(ratios) and len(ratios) > 20
    order = sorted(ratios)
    x = np.zeros((len(taught), len(order) + 1))
    x[:, -1] = 1
    for i, (t, _) in enumerate(taught):
        times = Counter(plain_buckets(t))
        for j, b in enumerate(order):
            x[i, j] = toxicity.SCALE * times[b] / (sum(times.values()) + toxicity.PAD) * ratios[b]
    y, w = np.array([v for _, v in taught]), np.zeros(len(order) + 1)
    ridge = np.diag([1e-4] * len(order) + [0.0])

    def loss(w):
        z = x @ w
        return np.mean(np.logaddexp(0, z) - y * z) + w @ ridge @ w / 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge + 1e-12 * np.eye(len(w)), x.T @ (y - p) / len(y) - ridge @ w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-14:
            step /= 2
        w = w + step
    fitted = np.array([model.weights[b] / (toxicity.SCALE * ratios[b]) for b in order] + [model.intercept])
    assert loss(fitted) - loss(w) <= 0.03 * (loss(0 * w) - loss(w))  # the fit ends after 30 steps
    best = [1 / (1 + math.exp(-float(r @ w))) for r in x]
    assert np.mean(np.abs(np.array([model.score(t) for t, _ in taught]) - best)) < 0.03


def spark_held_out(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


def test_labels_other_than_0_and_1_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i, ("vile zorgblat " if i % 2 else "calm words here ") * 8) for i in range(80)], "doc_id long, text string")
    base = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    odd = spark.createDataFrame([(i, 2 if i % 2 else -1) for i in range(80)], "doc_id long, toxic int")
    a, b = toxicity.train(docs, base), toxicity.train(docs, odd)
    assert a.score("vile zorgblat vile zorgblat") > 0.5 > a.score("calm words here calm words") and abs(a.score("zorgblat") - b.score("zorgblat")) < 1e-6
    again = toxicity.train(docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.where("doc_id < 40")), base)
    assert abs(again.score("zorgblat zorgblat") - a.score("zorgblat zorgblat")) < 1e-6


def test_token_lengths_are_the_library_s(spark, odd_docs):
    path = P.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    got = token_counts.token_lengths(odd_docs, path, P.PATTERN).select("text", "n_tokens").collect()
    assert len(got) == odd_docs.count() and all(r.n_tokens == len(plain.encode_ordinary(r.text or "")) for r in got)


def test_ids_that_the_format_does_not_hold(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(Exception, match="token id 70000 of document 1"):
        token_store.write_tokens(docs, P.path("byte_bpe_50k.json"), end=70_000).collect()


def test_checksum_of_decoded_ids():
    ids = np.arange(700, dtype=np.uint32) % 50
    code = token_store.checked(token_store.encode_blocks([ids])[0], ids)
    assert np.array_equal(token_store.opened([code], [700])[0], ids)
    with pytest.raises(ValueError, match="other ids"):
        token_store.opened([bytes([code[0] ^ 1]) + code[1:]], [700])


def test_a_document_longer_than_one_flush(spark, monkeypatch):
    monkeypatch.setattr(token_store, "LANES", 2)  # in this process only: the file's blocks are the same
    docs = spark.createDataFrame([(1, "ab cd " * 4000), (2, None), (3, "x")], "doc_id long, text string")
    got = token_store.token_digests(docs, P.path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    n = got[0].n_tokens
    assert n > 2 * token_store.BLOCK and [(r.start, r.n_tokens) for r in got[1:]] == [(n, 1), (n + 1, 2)]


def test_a_hot_ring_key_that_a_fifth_segment_does_not_cut(spark):
    rng = np.random.default_rng(2)
    near = [int(x) for x in {0x0123456789ABCDEF ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 14, (400, 2))}]
    fps = spark.createDataFrame([(x,) for x in near], "fp long")
    from assaylake.llm.common import components

    links = simhash.near_links(fps, block=4)
    assert all((r.u ^ r.v).bit_count() <= 3 for r in links.collect())
    roots = {r.node: r.root for r in components(links).collect()}
    plain = {x: x for x in near}

    def top(x):
        while plain[x] != x:
            x = plain[x]
        return x

    for i, a in enumerate(near):
        for b in near[:i]:
            if (a ^ b).bit_count() <= 3:
                lo, hi = sorted((top(a), top(b)))
                plain[hi] = lo
    assert {x: roots.get(x, x) for x in near} == {x: top(x) for x in near}


def test_groups_of_equal_texts_in_any_partitioning(spark):
    docs = spark.createDataFrame([(i, ("A" if i % 2 else "a") * 60 + str(i % 5)) for i in range(300)], "doc_id long, text string").repartition(9)
    got = content_dedup.exact_duplicates(docs, keep="max").collect()
    assert len(got) == 300 and all(r.keep_id == max(j for j in range(300) if j % 5 == r.doc_id % 5) and r.group_size == 60 for r in got)
    assert F is not None
