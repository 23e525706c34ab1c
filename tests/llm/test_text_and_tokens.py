"""Extraction, token counts, token files, pieces and toxicity."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F

from assaylake.llm import piece_codec, token_counts, token_store, toxicity


def test_token_counts(spark, odd_docs, no_docs):
    lengths = token_counts.token_lengths(odd_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = [r.n_tokens for r in lengths.collect()]
    table = token_counts.length_table(lengths)
    for r in table.collect():
        assert r.n_docs == got.count(r.n_tokens)
        assert r.docs_at_least == sum(x >= r.n_tokens for x in got)
        assert r.tokens_at_least == sum(x for x in got if x >= r.n_tokens)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in got)
        assert r.total_tokens == sum(got) and r.quantile == sum(x <= r.n_tokens for x in got) / len(got)
    for r in token_counts.truncated_totals(table, [0, 3, 10**6]).collect():
        assert (r.truncated_total, r.n_longer) == (sum(min(x, r.limit) for x in got), sum(x > r.limit for x in got))
    assert token_counts.length_quantiles(table, [0.5]).first().n_tokens == sorted(got)[len(got) // 2 - 1]
    assert token_counts.length_table(token_counts.token_lengths(no_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)).count() == 0


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    blocks = [rng.zipf(1.2, n).clip(0, 65535) for n in (0, 1, 2, 700, 4096)]
    blocks += [np.full(500, 7), np.tile([1, 2, 3, 65535], 300), rng.integers(0, 65536, 900)]
    blocks = [b.astype(np.int64) for b in blocks]
    codes = token_store.encode_blocks(blocks)
    for want, got in zip(blocks, token_store.decode_blocks(codes, [len(b) for b in blocks]), strict=True):
        assert (want == got).all()
    assert len(codes[5]) < 100 and len(codes[6]) < 200  # it learns
    packed = token_store.pack(codes[3], 700, [(5, 700), (None, 3)])
    assert token_store.unpack(packed) == (codes[3], 700, [(5, 700), (None, 3)])
    with pytest.raises(ValueError, match="damaged"):
        token_store.unpack(packed[:-1] + bytes([packed[-1] ^ 1]))


def test_token_files(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = ["a  b\n\n c ", " lead", "trail \n", "x\ty z", "it's  won't\n  ok", "\x1cq \x85 r", "a\n b", "", "  ", "\n"]
    v = token_store.Vocabulary(path, remembered=4)
    for x in texts:
        assert v.ids(x).tolist() == t.encode(x, add_special_tokens=False).ids
    got = token_store.token_digests(odd_docs, path).collect()
    start, want = 0, []
    for r in sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id)):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == sorted(w for w in want if w[0] is not None)
    assert Counter(r.start for r in got) == Counter(w[1] for w in want)
    assert token_store.token_digests(no_docs, path).count() == 0


def test_token_files_of_the_query(spark, odd_docs, tmp_path):
    """The query's ids are those of an untouched tokenizer, also where a text holds an added token's string."""
    from tokenizers import Tokenizer

    from assaylake.llm.registry import QUERIES

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "a<|endoftext|>b c\n", "<|endoftext|>", "<|endoftext|><|endoftext|> \tx", "<|endof text|> d", "plain  words\n"]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id not in (1, None)]
    rows += [(20 + i, x) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start, want = 0, []
    for i, x in sorted((i, x or "") for i, x in rows):
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert t.encode(texts[0], add_special_tokens=False).ids.count(50256) == 1
    assert sorted(tuple(r) for r in QUERIES["op6_token_ids"](spark, str(tmp_path)).collect()) == want


def test_pieces(spark, odd_docs, no_docs):
    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = piece_codec.encode_pieces(odd_docs, path).collect()
    for r in got:
        text = r.text or ""
        assert r.piece_ids == sp.encode(text, add_bos=True, add_eos=True)
        raw = text.encode()
        assert r.piece_ends[-1] == len(raw) and r.piece_ends[:-1] == r.piece_starts[1:]
        for i, a, b in zip(r.piece_ids[1:-1], r.piece_starts[1:-1], r.piece_ends[1:-1], strict=True):
            piece = sp.id_to_piece(i)
            if not sp.is_byte(i) and "▁" not in text:
                assert raw[a:b].decode() == piece.replace("▁", " ")[-len(raw[a:b].decode()) :] or piece == "▁"
    back = piece_codec.decode_pieces(piece_codec.encode_pieces(odd_docs, path), path).collect()
    assert all(r.decoded == sp.decode(r.piece_ids) for r in back)
    digests = {r.doc_id: r for r in piece_codec.piece_digests(odd_docs, path).collect()}
    ids = sp.encode("Ünïcode ▁ \U0001f600 <|endoftext|> é x", add_bos=True, add_eos=True)
    assert digests[8].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert digests[8].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert digests[4].n_tokens == 2 and piece_codec.piece_digests(no_docs, path).count() == 0
    for text in ["▁▁a", "a ", "  ", "▁", " \n ", "a" * 50, "\x00b"]:
        assert piece_codec.codec(path).encode(text)[0].tolist() == sp.encode(text, add_bos=True, add_eos=True)


def test_character_map():
    """Normalisation through a compiled map agrees with the library's, and its alignment points into the source."""
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name="nfkc")
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(normaliser.serialized_model_proto())
    own = piece_codec.PieceCodec(P.path("piece_bpe_32k.model"))
    own.map, own.spec = piece_codec.CharMap(proto.normalizer_spec.precompiled_charsmap), proto.normalizer_spec
    for text in ["ﬁne ①② ｶﾞ x", "áb", "㍿ Å ½"]:
        norm, source = own.normalise(text)
        assert norm.decode() == normaliser.normalize(text)
        assert len(source) == len(norm) + 1 and source[0] == 0 and source[-1] == len(text.encode())
        assert (np.diff(source) >= 0).all()


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("aeioutnrsl"), 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(vocabulary, 60))
        if toxic := i % 4 == 0:
            for _ in range(3):
                words[rng.integers(60)] = rng.choice(["zorgblat", "quxvile"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "zorgblat zorgblat zorgblat zorgblat")], "doc_id long, text string")
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, truth)
    got = toxicity.score_toxicity(docs, model).withColumn("held_out", toxicity.is_held_out(F.col("doc_id"))).collect()
    known = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in known and r.doc_id is not None]
    assert len(held) > 40 and np.mean([(r.toxicity_score >= 0.5) == bool(known[r.doc_id]) for r in held]) > 0.95
    assert all(0 <= r.toxicity_score <= 1 for r in got)
    by_id = {r.doc_id: r.toxicity_score for r in got}
    assert by_id[1000] == by_id[1001] < 0.5 < by_id[None]
    assert by_id[7] == model.score(rows[7][1])
    kept = toxicity.drop_toxic(docs, truth)
    assert kept.columns == docs.columns and kept.count() < len(rows)
    one_class = toxicity.train(docs, truth.where("toxic = 0"))
    assert one_class.score("zorgblat") < 0.5
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_without_evidence(spark):
    """No label, only held-out ones, only toxic ones, or classes that nothing tells apart: no document goes."""
    docs = spark.createDataFrame([(i, f"plain words of document {i}") for i in range(40)], "doc_id long, text string")
    ids = docs.withColumn("held_out", toxicity.is_held_out(F.col("doc_id")))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    held = ids.where("held_out").select("doc_id", F.lit(1).alias("toxic"))
    toxic = ids.where("NOT held_out").select("doc_id", F.lit(1).alias("toxic"))
    alike = docs.select("doc_id", F.lit("the same text").alias("text"))
    both = toxic.withColumn("toxic", (F.col("doc_id") > 3).cast("int"))
    for texts, labels in ((docs, none), (docs, held), (docs, toxic), (alike, both)):
        scores = {r.toxicity_score for r in toxicity.score_toxicity(texts, toxicity.train(texts, labels)).collect()}
        assert len(scores) == 1 and scores.pop() < 0.5
        assert toxicity.drop_toxic(texts, labels).count() == 40


def test_toxicity_labels_of_other_documents_take_no_place(spark):
    """The bounded sample is taken among the labels that have documents, however many others there are."""
    rows = [(i, "zorgblat quxvile flomcrit " * 8 if i % 2 else "plain gentle words " * 8) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    others = spark.range(10_000, 40_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic"))
    model = toxicity.train(docs, own.unionByName(others), max_train=100)
    assert model.score(rows[0][1]) < 0.5 < model.score(rows[1][1])
    want = toxicity.train(docs, own, max_train=100)
    assert (model.weights == want.weights).all() and model.intercept == want.intercept
