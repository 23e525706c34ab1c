"""Folds, samples and hold-outs; all follow from hashes of ids, so they do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaylake.functions.expressions import hash_order, hash_unit

from .replicates import poisson_cdf
from .stats import cumulative


def vfold_split(df: DataFrame, key: str, v: int = 12, seed: int = 1) -> DataFrame:
    """Fold 1 to v of each row, by hash: no global order, sizes equal on average. A fold's analysis set is ``fold <> f``."""
    return df.withColumn("fold", F.floor(hash_unit(seed, F.col(key)) * v).cast("int") + 1)


def stratified_vfold(df: DataFrame, strata: Sequence[str], key: str, v: int = 12, seed: int = 1) -> DataFrame:
    """Folds of equal sizes within strata. Rows are numbered within ranges of (stratum, hash), so a large stratum is many tasks' work."""
    rows = df.withColumns({"_h": hash_order(seed, F.col(key)), "_one": F.lit(1)})
    numbered = cumulative(rows, strata, ["_h", key], "_one", "_r")
    return numbered.withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(v)).cast("int") + 1).drop("_h", "_one", "_r")


def fold_strata_counts(folds: DataFrame, stratum: str, v: int) -> DataFrame:
    """Rows of each stratum in each analysis set: totals less the fold's own, no row is repeated."""
    own = folds.groupBy(stratum, "fold").agg(F.count(F.lit(1)).alias("n"))
    all_ = own.groupBy(stratum).agg(F.sum("n").alias("_t")).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(v))))
    return all_.join(own, [stratum, "fold"], "left").select(stratum, "fold", (F.col("_t") - F.coalesce("n", F.lit(0))).alias("n_analysis"))


def loso_manifest(df: DataFrame, label: str, min_size: int = 5, min_train: int = 50) -> DataFrame:
    """A fold for each label of ``min_size`` rows: test and train sizes, log10 and share of the test set; small labels are always trained on."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_test"))
    whole = counts.agg(F.sum("n_test").alias("_all"))  # one row
    got = counts.crossJoin(F.broadcast(whole)).withColumn("n_train", F.col("_all") - F.col("n_test")).where((F.col("n_test") >= min_size) & (F.col("n_train") >= min_train))
    ord_ = F.row_number().over(Window.orderBy(label))  # a row for each label
    return got.select(ord_.alias("fold_id"), F.col(label).alias("held_out"), "n_test", "n_train", F.log10("n_test").alias("log10_n_test"), (F.col("n_test") / F.col("_all")).alias("p_test"))


def loso_split(df: DataFrame, label: str, min_size: int = 5, min_train: int = 50) -> DataFrame:
    """Each row with the fold that holds it out (null: in every train set). A fold trains on rows whose fold is another or null."""
    m = loso_manifest(df, label, min_size, min_train).select("fold_id", "held_out")
    return df.join(m, F.col(label) == F.col("held_out"), "left").drop("held_out")


def manifest_check(manifest: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """Manifest entries whose counts are not those found."""
    got = manifest.join(counted.withColumnRenamed("n", "n_found"), key, "left")
    return got.where(F.coalesce("n_found", F.lit(0)) != F.col("n_test")).select(key, "n_test", F.coalesce("n_found", F.lit(0)).alias("n_found"))


def fraction_subsample(df: DataFrame, key: str, fractions: Sequence[float], seed: int = 1) -> DataFrame:
    """Every row once for each fraction it falls into; smaller fractions are within larger ones."""
    u = hash_unit(seed, F.col(key))
    return df.withColumn("_u", u).withColumn("fraction", F.explode(F.filter(F.array(*[F.lit(float(f)) for f in fractions]), lambda f: F.col("_u") < f))).drop("_u")


def sample_frac(df: DataFrame, key: str, fraction: float, seed: int = 1) -> DataFrame:
    """The share of rows whose keys hash below ``fraction``; rows of one key stay together."""
    return df.where(hash_unit(seed, F.col(key)) < fraction)


def group_sample_n(df: DataFrame, by: Sequence[str], key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows of each group, those of the smallest hashes."""
    w = Window.partitionBy(*by).orderBy(hash_order(seed, F.col(key)), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def read_subsample(df: DataFrame, read_id: str, p: float, seed: int = 1) -> DataFrame:
    """Reads at proportion p; mates share an id, so they stay together."""
    return df.where(hash_unit(seed, F.col(read_id)) < p)


def cluster_holdout_split(clusters: DataFrame, cluster: str, member: str, rep: str, seed: int = 1) -> DataFrame:
    """One member other than the representative of each cluster is tested, all else is reference.

    The tested one has the least hash, found by an aggregate.
    """
    other = F.col(member) != F.col(rep)
    pick = clusters.where(other).groupBy(cluster).agg(F.min(F.struct(hash_order(seed, F.col(member)).alias("h"), F.col(member).alias("m"))).alias("p")).select(F.col(cluster).alias("_c"), F.col("p.m").alias("_m"))
    return clusters.join(pick, (F.col(cluster) == F.col("_c")) & (F.col(member) == F.col("_m")), "left").withColumn("role", F.when(F.col("_m").isNotNull(), "test").otherwise("reference")).drop("_c", "_m")


def bootstrap_weights(df: DataFrame, key: str, replicates: int, seed: int = 1) -> DataFrame:
    """Each row for each replicate with a Poisson(1) weight of its hash; rows of weight 0 are left out."""
    u = hash_unit(seed, F.concat_ws("-", F.col("replicate").cast("string"), F.col(key).cast("string")))
    weight = sum((F.when(F.col("_u") >= c, 1).otherwise(0) for c in poisson_cdf()), F.lit(0))
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_u", u).withColumn("weight", weight).where("weight > 0").drop("_u")
