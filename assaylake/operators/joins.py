"""Joins of contigs, references, annotations and fold context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_loso_context(metrics: DataFrame, metadata: DataFrame, manifest: DataFrame) -> DataFrame:
    """Metrics with sample metadata (by sample_id) and the fold manifest (by held-out family), left joins."""
    held = manifest.withColumnRenamed("held_out_superfamily", "superfamily")
    return metrics.join(metadata, "sample_id", "left").join(held, "superfamily", "left")


def join_reference_labels(contigs: DataFrame, refs: DataFrame, hit: str = "hits", ref_id: str = "ref_id") -> DataFrame:
    """Contigs with their reference's labels; a contig without hit keeps nulls."""
    return contigs.join(refs, F.col(hit) == F.col(ref_id), "left")


def join_annotations(contigs: DataFrame, annotations: DataFrame, keys: Sequence[str]) -> DataFrame:
    return contigs.join(annotations, list(keys), "left")


def reference_completeness(contigs: DataFrame, refs: DataFrame, by: Sequence[str], hit: str = "hits", ref_id: str = "ref_id") -> DataFrame:
    """References and those never recovered, by label: a right outer join on distinct hits."""
    found = contigs.select(F.col(hit).alias("_hit")).where("_hit IS NOT NULL").distinct()
    return found.join(refs, F.col("_hit") == F.col(ref_id), "right").groupBy(*by).agg(F.count(F.lit(1)).alias("n_refs"), F.count_if(F.col("_hit").isNull()).alias("n_missing"))


def recovered_vs_missing(refs: DataFrame, contigs: DataFrame, least: float = 0.95, ref_id: str = "ref_id", hit: str = "hits", cov: str = "reference_coverage") -> DataFrame:
    """Each reference labelled by whether any contig covers it so far."""
    found = contigs.where(F.col(cov) >= least).select(F.col(hit).alias("_hit")).distinct()
    return refs.join(found, F.col(ref_id) == F.col("_hit"), "left").withColumn("status", F.when(F.col("_hit").isNotNull(), f">= {least:.0%} alignment").otherwise("Not Assembled")).drop("_hit")


def superfamily_concordance(predicted: DataFrame, truth: DataFrame, keys: Sequence[str], labels: str = "predicted", actual: str = "family") -> DataFrame:
    """Predicted labels, joined by '_', against the true one: Concordance, Ambiguous, or null where either is unknown."""
    each = predicted.select(*keys, F.explode(F.split(labels, "_")).alias("label"))
    got = each.join(truth, list(keys), "right").withColumn("concordance", F.when(F.col("label") == F.col(actual), "Concordance").when(F.col("label") != F.col(actual), "Ambiguous"))
    return got.select(*keys, actual, "label", "concordance").distinct()


def join_recovery_nri(recovery: DataFrame, nri: DataFrame, keys: Sequence[str] = ("test_id",)) -> DataFrame:
    return recovery.join(nri, list(keys))


def prediction_grid(tools: DataFrame, grids: Mapping[str, Sequence[float]]) -> DataFrame:
    """Every tool at every combination of grid values: explodes of short literals."""
    for name, values in grids.items():
        tools = tools.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return tools


def integrate_contig_db(contigs: DataFrame, refs: DataFrame, annotations: DataFrame, classifier: DataFrame) -> DataFrame:
    """Contigs with reference labels and annotation, right-joined to classifier rows that name a region."""
    db = contigs.join(refs, F.col("hits") == F.col("ref_id"), "left").join(annotations, "contig_name", "left")
    return db.join(classifier.where(F.col("region").isNotNull()), ["contig_name"], "right")


def key_set_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, n): ids only in a, in both, only in b; one full outer join of distinct ids."""
    x, y = a.select(F.col(key).alias("x")).distinct(), b.select(F.col(key).alias("y")).distinct()
    side = F.when(F.col("y").isNull(), "only_a").when(F.col("x").isNull(), "only_b").otherwise("both")
    return x.join(y, F.col("x") == F.col("y"), "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def complete_grid(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Every combination of the keys' distinct values, missing ones at 0."""
    grid = df.select(keys[0]).distinct()
    for k in keys[1:]:
        grid = grid.crossJoin(df.select(k).distinct())
    return grid.join(df, list(keys), "left").withColumn(value, F.coalesce(value, F.lit(0)))
