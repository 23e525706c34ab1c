"""Token counts: an exact length histogram whose suffix sums answer totals, quantiles and truncated totals."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, materialise

#: Lengths for each block of the suffix sums.
BLOCK = 1024


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, the length of each whole text in the byte-level vocabulary at ``path``.

    Null and empty texts have none. Repeated rows give a row each; an input column n_tokens is replaced; no rows give no rows.
    """

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        encode = _encoding(path, pattern).encode_ordinary
        return pd.Series([0 if t is None else len(encode(t)) for t in texts], dtype="int64")

    return docs.withColumn("n_tokens", n_tokens(col(text)))


def length_table(lengths: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """A row for each length that occurs: n_tokens, n_docs, and for the context limit of that length

    docs_at_least and tokens_at_least (suffix sums of the histogram), truncated_total (tokens left
    when every document is cut to the limit), total_tokens, and quantile (share of documents that
    are no longer). Null lengths count as 0, repeated rows count again; an empty table gives no rows. The suffix sums run
    within blocks of ``BLOCK`` lengths and over block totals, so no task sees the whole histogram, and a task of many
    lengths holds that many rows at most, whatever the corpus.
    """
    hist = lengths.groupBy(F.coalesce(n_tokens, F.lit(0)).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    hist = materialise(hist, "length-histogram")  # else every use of it would encode the corpus again
    hist = hist.withColumn("_b", F.floor(F.col("n_tokens") / BLOCK)).withColumn("_t", F.col("n_tokens") * F.col("n_docs"))
    blocks = hist.groupBy("_b").agg(F.sum("n_docs").alias("_bd"), F.sum("_t").alias("_bt"))
    later = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of lengths
    whole = Window.partitionBy()
    blocks = blocks.select("_b", F.coalesce(F.sum("_bd").over(later), F.lit(0)).alias("_d0"), F.coalesce(F.sum("_bt").over(later), F.lit(0)).alias("_t0"), F.sum("_bd").over(whole).alias("_docs"), F.sum("_bt").over(whole).alias("total_tokens"))
    inside = Window.partitionBy("_b").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    at = hist.join(blocks, "_b").withColumn("docs_at_least", F.sum("n_docs").over(inside) + F.col("_d0")).withColumn("tokens_at_least", F.sum("_t").over(inside) + F.col("_t0"))
    return at.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        "total_tokens",
        ((F.col("_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("_docs")).alias("quantile"),
    )


def truncated_totals(table: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, n_longer, truncated_total) for any context limits, from ``length_table``: one pass over the histogram."""
    limit = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit")
    return table.select(limit, "n_tokens", "n_docs").groupBy("limit").agg(
        F.sum(F.when(F.col("n_tokens") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("n_longer"),
        F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("truncated_total"),
    )


def length_quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of documents does not exceed."""
    share = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    return table.select(share, "n_tokens", "quantile").where("quantile >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
