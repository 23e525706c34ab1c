"""The engine's tables bound to the driver's: as DataFrames, and as the SQL that oracles start from.

Order lines stand for assembled sequences and their alignments to suppliers as references (nations
are families); documents stand for sequences by source and language. All rows of the tables are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    none = F.col("l_tax") == 0
    return li.select(
        F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("contig_name"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("sample_id"),
        F.col("l_returnflag").alias("tool"), F.col("l_linestatus").alias("mode"), F.col("l_linenumber").alias("fold"), F.col("l_extendedprice").alias("length"),
        F.when(~none, F.col("l_quantity") / 50).alias("reference_coverage"), F.when(~none, F.concat(F.lit("ref"), F.col("l_suppkey").cast("string"))).alias("hits"),
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    named = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # both fixed
    return s.join(F.broadcast(named), s.s_nationkey == named.n_nationkey).select(F.concat(F.lit("ref"), F.col("s_suppkey").cast("string")).alias("ref_id"), F.col("n_name").alias("family"), F.col("r_name").alias("clade"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") % 100 + 1
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("hit_id"), F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("qseqid"), F.concat(F.lit("ref"), F.col("l_suppkey").cast("string")).alias("sseqid"),
        (F.lit(70.0) + F.col("l_discount") * 300).alias("pident"), F.col("l_quantity").cast("long").alias("length"), start.alias("sstart"), (start + F.col("l_quantity").cast("long") - 1).alias("send"),
        F.lit(60).cast("long").alias("qlen"), F.lit(150).cast("long").alias("slen"), (F.col("l_quantity") * 2 + F.col("l_tax")).alias("bitscore"), (F.col("l_quantity") * 2).alias("qcovs"),
    )


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.col("text").alias("sequence"), F.col("source").alias("family"), F.col("lang").alias("organism"))


CONTIGS = """contigs AS (SELECT l_orderkey || '_' || l_linenumber AS contig_name, 's' || l_linenumber AS sample_id, l_returnflag AS tool, l_linestatus AS mode,
  l_linenumber AS fold, l_extendedprice AS length, CASE WHEN l_tax <> 0 THEN l_quantity / 50 END AS reference_coverage,
  CASE WHEN l_tax <> 0 THEN 'ref' || l_suppkey END AS hits FROM lineitem)"""
REFS = """refs AS (SELECT 'ref' || s_suppkey AS ref_id, n_name AS family, r_name AS clade FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
HITS = """hits AS (SELECT l_orderkey * 10 + l_linenumber AS hit_id, 'q' || l_orderkey AS qseqid, 'ref' || l_suppkey AS sseqid, 70.0::DOUBLE + l_discount * 300 AS pident,
  l_quantity::BIGINT AS length, l_partkey % 100 + 1 AS sstart, l_partkey % 100 + 1 + l_quantity::BIGINT - 1 AS send, 60::BIGINT AS qlen, 150::BIGINT AS slen,
  l_quantity * 2 + l_tax AS bitscore, l_quantity * 2 AS qcovs FROM lineitem)"""
SEQS = """seqs AS (SELECT doc_id AS entry_id, text AS sequence, source AS family, lang AS organism FROM documents)"""
