"""The queries of the training-data operators over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import content_dedup, html_text, language_id, merkle, mixing, piece_codec, simhash, spelling, substring_dedup, token_counts, token_store, toxicity, vector_search
from .common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url and the visible text of every page."""
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole mixed corpus: sources weighted by the square root of their sizes, as many documents as before on average."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model that learns from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 50 words that also start in a document of smaller id, as digests."""
    return substring_dedup.repeat_digests(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each length in tokens that occurs, with the answers for the context limit of that length."""
    docs = table(spark, sf_dir, "documents").select("text")
    return token_counts.length_table(token_counts.token_lengths(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that the tokenizer's file gives by default: the string of an added token in a text is that token."""
    return token_store.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint of three-word shingles, and the smallest doc_id of its links."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all other vectors for every twentieth id."""
    return vector_search.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the piece ids and of the decoded text of every document."""
    return piece_codec.piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document; the largest doc_id of each stays."""
    return content_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by profiles of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.is_held_out(F.col("doc_id"))
    found = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof digest of every document, and the root that its proof gives for a text without line ends where its id's crc32 is even."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = merkle.leaf_hash(*[F.replace("text", F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in fields])
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = merkle.manifest(table(spark, sf_dir, "documents"), "doc_id", "source", fields, F.when(even, tampered))
    rows = rows.withColumn("folded_root", merkle.folded(F.coalesce("payload", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus, with one in 31 of its places in documents misspelt, and the word whose variant it is."""
    words = spelling.corpus_words(table(spark, sf_dir, "documents"), drop_every=31)
    return spelling.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_text, op2_mix_sources, op3_toxicity, op4_substring_dedup, op5_token_counts, op6_token_ids, op7_simhash, op8_nearest_neighbours, op9_pieces, op10_exact_dedup, op11_language_id, op12_merkle_manifest, op13_spelling_variants)
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": """
        WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        rates AS (SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts),
        terms AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
                  FROM rates, range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1) AS t(k)),
        drawn AS (SELECT *, ('0x' || md5('mix-' || doc_id)[1:13])::BIGINT / 4503599627370496.0 AS u FROM documents),
        copied AS (SELECT d.*, (SELECT count(*) FROM terms t WHERE t.source IS NOT DISTINCT FROM d.source AND t.cdf <= d.u)::INT AS copies FROM drawn d)
        SELECT doc_id, text, lang, source, n_chars, c::INT AS copy, copies,
               ('0x' || md5('mix-order-' || doc_id || '-' || c)[1:13])::BIGINT / 4503599627370496.0 AS mix_key
        FROM copied, range(0, copies) AS r(c)""",
    "op8_nearest_neighbours": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256 FROM t""",
}
