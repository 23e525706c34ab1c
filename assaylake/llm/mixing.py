"""Mixing sources to target weights by Poisson replication; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, materialise, packed, unit_hash

ADDED = ("copy", "copies", "mix_key")


def source_rates(docs: DataFrame, source: str = "source", weights: Mapping[str, float] | None = None, temperature: float = 0.5, total: float | None = None) -> DataFrame:
    """(source, n_docs, weight, rate): the mean number of copies that brings a source to its weight.

    Weights are those given (a source without one gets no copies) or n_docs ** temperature, both
    scaled to sum to one; rate = weight * total / n_docs, total being the number of documents unless given.
    """
    counts = docs.groupBy(col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        raw = F.pow(F.col("n_docs").cast("double"), F.lit(float(temperature)))
    else:
        given = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]
        raw = F.coalesce(F.try_element_at(F.create_map(*given), F.col("source")), F.lit(0.0)) if given else F.lit(0.0)
    sums = counts.select(F.sum(raw).alias("_w"), F.sum("n_docs").alias("_n"))  # one row
    shared = counts.withColumn("_raw", raw).crossJoin(F.broadcast(sums))
    weight = F.coalesce(F.try_divide(F.col("_raw"), F.col("_w")), F.lit(0.0))
    goal = F.col("_n") if total is None else F.lit(float(total))
    return shared.select("source", "n_docs", weight.alias("weight"), (weight * goal / F.col("n_docs")).alias("rate"))


def poisson_draw(rate: Column, u: Column) -> Column:
    """The Poisson distribution of mean ``rate`` inverted at ``u``: how many of P(X <= 0), P(X <= 1), ... do not exceed it.

    Walks as far as doubles tell the sum from one, which is about as far as the copies that the row gets; in logarithms,
    so that large rates work.
    """
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("logp"), F.exp(-rate).alias("cum"), (F.exp(-rate) <= u).cast("int").alias("n"))

    def step(acc: Column, k: Column) -> Column:
        logp = acc["logp"] + F.ln(rate) - F.ln(k.cast("double"))
        cum = acc["cum"] + F.exp(logp)
        return F.struct(logp.alias("logp"), cum.alias("cum"), (acc["n"] + (cum <= u).cast("int")).alias("n"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["n"])).otherwise(0)


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: Mapping[str, float] | None = None, temperature: float = 0.5, total: float | None = None, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every document as often as its Poisson draw says, in one global random order.

    The draw inverts the Poisson distribution of the source's rate at a hash of seed and id, so it
    does not depend on partitioning. Adds copy (from 0), copies (the draw) and mix_key, by which rows
    are globally sorted. A null source is a source of its own; a null id draws as the empty string; repeated rows
    draw alike; an empty table gives an empty table; input columns stay whatever their names, but for those of the
    three added names. The table of rates is written first, so Spark knows its size: it is broadcast where that is
    within the session's bound, else joined by shuffles, whose hot sources Spark splits.
    """
    key = F.coalesce(col(doc_id).cast("string"), F.lit(""))
    rows = packed(docs, ADDED, key=key, id=col(doc_id), source=col(source), u=unit_hash(seed, key))
    rates = materialise(source_rates(docs, source, weights, temperature, total).select(F.col("source").alias("src"), "rate"), "source-rates")
    drawn = rows.join(rates, F.col("source").eqNullSafe(F.col("src"))).withColumn("copies", poisson_draw(F.col("rate"), F.col("u"))).where("copies > 0")
    copied = drawn.select("row", "key", "id", "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    keyed = copied.withColumn("mix_key", unit_hash(f"{seed}-order", F.col("key"), F.col("copy")))
    return keyed.orderBy("mix_key", "id", "copy").select("row.*", *ADDED)
