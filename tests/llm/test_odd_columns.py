"""Every operator on a table whose extra columns bear the names that operators use inside, dots included."""

import re
from pathlib import Path

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from assaylake.llm import content_dedup, html_text, language_id, merkle, mixing, piece_codec, simhash, spelling, substring_dedup, token_counts, token_store, toxicity, vector_search

LLM = Path(html_text.__file__).parent
#: Every name in quotes that the operators' code holds, whatever it stands for there.
INSIDE = sorted({n for f in LLM.glob("*.py") for n in re.findall(r"[\"' ]([a-z_][a-z_0-9]{0,20})[\"' ]", f.read_text())} - {"doc_id", "text", "source", "html"})


@pytest.fixture(scope="module")
def clashing(odd_docs):
    rows = odd_docs.select("doc_id", "text", "source")
    return rows.select("*", *[F.lit(i).alias(n) for i, n in enumerate([*INSIDE, "a.b", "text.x"])])


def test_names_are_many():
    assert {"row", "id", "_id", "kept", "norm", "key", "u", "src", "copies", "th", "label"} <= set(INSIDE) and len(INSIDE) > 100


def same(out, docs, added=()):
    """Input columns stay, in order and with their values."""
    kept = [c for c in docs.columns if c not in added]
    assert [c for c in out.columns if c not in added] == kept
    values = [(c, i) for i, c in enumerate([*INSIDE, "a.b", "text.x"]) if c not in added]
    r = out.first()
    assert all(r[c] == i for c, i in values)


def test_clashing_names(clashing):
    same(mixing.mix_sources(clashing), clashing, mixing.ADDED)
    same(content_dedup.drop_exact_duplicates(clashing), clashing)
    assert content_dedup.exact_duplicates(clashing).count() == clashing.count()
    same(simhash.drop_near_duplicates(clashing), clashing)
    same(substring_dedup.remove_repeats(clashing), clashing)
    assert substring_dedup.repeat_digests(clashing).count() == clashing.count()
    labels = clashing.withColumn("toxic", F.lit(1))
    same(toxicity.drop_toxic(clashing, labels), clashing)
    same(toxicity.score_toxicity(clashing, toxicity.train(clashing, labels)), clashing, ["toxicity_score"])
    path = P.path("piece_bpe_32k.model")
    pieces = piece_codec.encode_pieces(clashing, path)
    same(pieces, clashing, ["piece_ids", "piece_starts", "piece_ends"])
    same(piece_codec.decode_pieces(pieces, path), clashing, ["piece_ids", "piece_starts", "piece_ends", "decoded"])
    assert piece_codec.piece_digests(clashing, path).count() == clashing.count()
    same(token_counts.token_lengths(clashing, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), clashing, ["n_tokens"])
    assert token_store.token_digests(clashing, P.path("byte_bpe_50k.json")).count() == clashing.count()
    same(html_text.extract_text(clashing, "text", "out.text"), clashing, ["out.text"])
    tongues = clashing.withColumn("lang", F.lit("en"))
    same(language_id.identify(tongues, language_id.train(tongues)), tongues, [*language_id.ADDED, "lang"])
    assert merkle.manifest(clashing, "doc_id", "source", ["doc_id", "text"]).count() == clashing.count()
    assert spelling.group_variants(spelling.corpus_words(clashing, least_length=4)).count() > 0
    vectors = clashing.withColumn("vec_id", F.col("doc_id")).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    assert vector_search.nearest_neighbours(vectors, F.col("id") % 20 == 0).count() == 0


def test_null_ids(odd_docs, spark):
    docs = spark.createDataFrame([(None, "same words here"), (None, "same words here"), (3, "same words here"), (2, "same words here"), (2, "same words here")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash.drop_near_duplicates(docs).collect()) == ["2", "2", "None", "None"]
    assert sorted(str(r.doc_id) for r in content_dedup.drop_exact_duplicates(docs).collect()) == ["2"]
    assert simhash.drop_near_duplicates(docs.where("doc_id IS NULL")).count() == 2
