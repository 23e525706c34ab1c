"""A corpus pipeline of five of the training-data operators: filter, dedup, near-dedup, mix, encode."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assaylake.llm import content_dedup, mixing, piece_codec, simhash, toxicity
from assaylake.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, scores 0.5 or more go.

    Null texts count as empty and stay, as empty ones score below 0.5; null ids are scored, not learned from; repeated
    rows go or stay alike; without labels all stay; no rows give none.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one of the largest doc_id stays.

    Null and empty texts are equal; a null id is smaller than any other; of rows that repeat id and text one stays; no
    rows give none.
    """
    return content_dedup.drop_exact_duplicates(docs, keep="max").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, that of the smallest doc_id.

    Texts without words have one fingerprint and are one group; rows of a null id all stay; no rows give none.
    """
    return simhash.drop_near_duplicates(docs).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at the weights of the square roots of their sizes; a document may come several times or not at all.

    A null source is a source of its own; how often a row comes follows from its id, so repeated rows come equally often;
    texts play no part; no rows give none.
    """
    return mixing.mix_sources(docs).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids, decoded text and spans, a row for each copy; null texts count as empty, no rows give none."""
    return piece_codec.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("sentencepiece", encode),
]

#: A trained classifier and tokenizers are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
