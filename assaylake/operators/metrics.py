"""Recovery metrics: how much of a reference set each tool's sequences recover, at coverage thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaylake.functions.expressions import coverage_band, safe_ratio

from .stats import cumulative, nx_lx


def threshold_cross(df: DataFrame, thresholds: Sequence[float], name: str = "threshold") -> DataFrame:
    """Every row once for each threshold: an explode, so no join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))


def _n_ref(n_ref: int | DataFrame | None) -> tuple[DataFrame | None, Column]:
    return (None, F.lit(n_ref).cast("long")) if not isinstance(n_ref, DataFrame) else (n_ref, F.col("n_ref"))


def coverage_metrics(contigs: DataFrame, by: Sequence[str], thresholds: Sequence[float], n_ref: int | DataFrame | None, cov: str = "reference_coverage", hit: str = "hits", fn_mode: str = "abs", phantom_null: bool = False) -> DataFrame:
    """By group and threshold: rawcontigs, TP distinct references at the threshold, FP partly covered, TN uncovered, FN.

    ``n_ref`` is a number or a one-row table with column n_ref. ``phantom_null`` counts a group
    with any unknown coverage as one more true positive.
    """
    c, t = F.col(cov), F.col("threshold")
    tp = F.count_distinct(F.when(c >= t, F.col(hit)))
    if phantom_null:
        tp = tp + F.max(c.isNull().cast("int"))
    one, n = _n_ref(n_ref)
    got = threshold_cross(contigs.select(*by, cov, hit), thresholds).groupBy(*by, "threshold").agg(
        F.count(F.lit(1)).alias("rawcontigs"), tp.alias("TP"), F.count_if((c > 0) & (c < t)).alias("FP"), F.count_if((c <= 0) | c.isNull()).alias("TN")
    )
    if one is not None:
        got = got.crossJoin(F.broadcast(one))  # one row
    fn = F.lit(0).cast("long") if n_ref is None else F.abs(n - F.col("TP")) if fn_mode == "abs" else F.greatest(n - F.col("TP"), F.lit(0))
    return got.withColumn("FN", fn).drop("n_ref")


def coverage_metrics_behera(contigs: DataFrame, by: Sequence[str], thresholds: Sequence[float], n_ref: int | DataFrame, cov: str = "reference_coverage", hit: str = "hits") -> DataFrame:
    """By group and threshold: sequence-level TP and FP (partial and without hit), references found and missed, precision, sensitivity, F1."""
    c, t = F.col(cov), F.col("threshold")
    one, n = _n_ref(n_ref)
    got = threshold_cross(contigs.select(*by, cov, hit), thresholds).groupBy(*by, "threshold").agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(c >= t).alias("TP"), F.count_if((c > 0) & (c < t)).alias("FP_partial"),
        F.count_if(c.isNull() | (c <= 0)).alias("FP_nohit"), F.count_distinct(F.when(c >= t, F.col(hit))).alias("TP_refs"),
    )
    if one is not None:
        got = got.crossJoin(F.broadcast(one))  # one row
    got = got.withColumn("FP", F.col("FP_partial") + F.col("FP_nohit")).withColumn("FN", F.greatest(n - F.col("TP_refs"), F.lit(0))).drop("n_ref")
    precision, sensitivity = safe_ratio(F.col("TP"), F.col("TP") + F.col("FP")), safe_ratio(F.col("TP_refs"), F.col("TP_refs") + F.col("FN"))
    return got.withColumn("precision", precision).withColumn("sensitivity", sensitivity).withColumn("F1", safe_ratio(2 * F.col("precision") * F.col("sensitivity"), F.col("precision") + F.col("sensitivity")))


def coverage_metrics_family(contigs: DataFrame, by: Sequence[str], thresholds: Sequence[float], family_sizes: DataFrame, family: str = "family", cov: str = "reference_coverage", hit: str = "hits") -> DataFrame:
    """By family, group and threshold: TP distinct references, FP all sequences below the threshold or without hit, FN by family size.

    ``family_sizes``: (family, n_ref), a row for each family.
    """
    c, t = F.col(cov), F.col("threshold")
    got = threshold_cross(contigs.select(family, *by, cov, hit), thresholds).groupBy(family, *by, "threshold").agg(
        F.count(F.lit(1)).alias("rawcontigs"), F.count_distinct(F.when(c >= t, F.col(hit))).alias("TP"), F.count_if((c < t) | c.isNull()).alias("FP")
    )
    return got.join(family_sizes, family, "left").withColumn("FN", F.greatest(F.coalesce("n_ref", F.lit(0)) - F.col("TP"), F.lit(0))).drop("n_ref")


def derived_scores(metrics: DataFrame) -> DataFrame:
    """Ratio, Accuracy, Precision, Sensitivity and Fscore of counts TP, FP, FN."""
    tp, fp, fn = F.col("TP"), F.col("FP"), F.col("FN")
    return metrics.withColumns({"Ratio": safe_ratio(tp, fp), "Accuracy": safe_ratio(tp, tp + fn + fp), "Precision": safe_ratio(tp, tp + fp), "Sensitivity": safe_ratio(tp, tp + fn), "Fscore": safe_ratio(2 * tp, 2 * tp + fp + fn)})


def additive_method(contigs: DataFrame, tools: Sequence[str], label: str, tool: str = "tool") -> DataFrame:
    """The rows, and those of ``tools`` once more as a joint pseudo-tool: an explode of labels, one scan."""
    labels = F.when(F.col(tool).isin(list(tools)), F.array(F.col(tool), F.lit(label))).otherwise(F.array(F.col(tool)))
    return contigs.withColumn(tool, F.explode(labels))


def three_way_classify(metrics: DataFrame, leak: DataFrame, keys: Sequence[str], leak_col: str = "leak") -> DataFrame:
    """Splits false positives by leakage: paralogs of training references, and spurious ones; precision of both kinds."""
    summed = leak.groupBy(*keys).agg(F.sum(leak_col).alias("leak"))
    over = F.col("raw") - F.col("TP")
    got = metrics.join(summed, list(keys), "left").withColumn("FP_paralog", F.least(over, F.coalesce("leak", F.lit(0)))).withColumn("FP_spurious", F.greatest(over - F.col("FP_paralog"), F.lit(0)))
    return got.withColumn("precision_ood", safe_ratio(F.col("TP"), F.col("TP") + F.col("FP_paralog") + F.col("FP_spurious"))).withColumn("precision_combined", safe_ratio(F.col("TP") + F.col("FP_paralog"), F.col("raw")))


def compute_cif(three_way: DataFrame, by: Sequence[str]) -> DataFrame:
    """Inflation factor, combined over out-of-distribution precision: n, median, mean, sd by group."""
    cif = safe_ratio(F.col("precision_combined"), F.col("precision_ood"))
    return three_way.withColumn("cif", cif).groupBy(*by).agg(
        F.count("cif").alias("n"), F.median("cif").alias("median_cif"), F.avg("cif").alias("mean_cif"), F.stddev_samp("cif").alias("sd_cif"),
        F.avg("precision_ood").alias("mean_ood"), F.avg("precision_combined").alias("mean_combined"),
    )


def per_family_summary(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, mean and sd of precision and F1, mean sensitivity by group."""
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("precision").alias("mean_precision"), F.stddev_samp("precision").alias("sd_precision"), F.avg("sensitivity").alias("mean_sensitivity"), F.avg("F1").alias("mean_f1"), F.stddev_samp("F1").alias("sd_f1"))


def ood_tool_summary(family_summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """A second roll-up, over families."""
    return family_summary.groupBy(*by).agg(F.count(F.lit(1)).alias("n_families"), F.avg("mean_precision").alias("mean_precision"), F.stddev_samp("mean_precision").alias("sd_precision"), F.avg("mean_f1").alias("mean_f1"))


def assembly_summary(contigs: DataFrame, by: Sequence[str], cov: str = "reference_coverage", hit: str = "hits") -> DataFrame:
    """n_contigs, n_hits, hit_fraction, mean and sd coverage by group."""
    n = F.count(F.lit(1))
    return contigs.groupBy(*by).agg(n.alias("n_contigs"), F.count(hit).alias("n_hits"), safe_ratio(F.count(hit), n).alias("hit_fraction"), F.avg(cov).alias("mean_cov"), F.stddev_samp(cov).alias("sd_cov"))


def leakage_audit(hits: DataFrame, by: Sequence[str], pident: float = 90, qcov: float = 80) -> DataFrame:
    """Hits against training references: all of them, and those of high identity and query coverage."""
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("total_hits"), F.count_if((F.col("pident") >= pident) & (F.col("qcovs") >= qcov)).alias("high_hits"), F.max_by("sseqid", F.struct("bitscore", "sseqid")).alias("top_target"))


def leakage_stats(audit: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median, mean and maximum of high hits by group, and the share without any."""
    return audit.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median("high_hits").alias("median_high"), F.avg("high_hits").alias("mean_high"), F.max("high_hits").alias("max_high"), F.avg((F.col("high_hits") == 0).cast("int")).alias("share_none"))


def exact_mean(x: Column) -> Column:
    """Mean of doubles as they are written (14 places), the same in any order of rows; that of the doubles if some cannot be written so."""
    written = x.try_cast("decimal(28,14)")
    return F.when(F.count(written) == F.count(x), F.avg(written).cast("double")).otherwise(F.avg(x))


def recovery_table(contigs: DataFrame, by: Sequence[str], hit: str = "hits", cov: str = "reference_coverage", least: float = 0.9, exact: bool = False) -> DataFrame:
    """Best and mean coverage of each reference (its id up to a bar), and whether it is recovered. ``exact``: means that are to be compared, see ``exact_mean``."""
    ref = F.substring_index(F.col(hit), "|", 1)
    mean = exact_mean(F.col(cov)) if exact else F.avg(cov)
    return contigs.where(F.col(hit).isNotNull()).groupBy(*by, ref.alias("test_id")).agg(F.max(cov).alias("best_cov"), mean.alias("mean_cov")).withColumn("recovered", (F.col("best_cov") >= least).cast("int"))


def binned_recovery(table: DataFrame, x: str, breaks: Sequence[float], by: Sequence[str] = (), recovered: str = "recovered") -> DataFrame:
    """Left-closed bins of ``x``, the last one closed: n, recovered, sensitivity and its binomial standard error."""
    edges = list(zip(breaks[:-1], breaks[1:], strict=True))
    b = F.lit(None).cast("string")
    for i, (lo, hi) in reversed(list(enumerate(edges))):
        last = i == len(edges) - 1
        b = F.when((F.col(x) >= lo) & ((F.col(x) <= hi) if last else (F.col(x) < hi)), F.lit(f"[{lo:g},{hi:g}{']' if last else ')'}")).otherwise(b)
    got = table.withColumn("bin", b).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(recovered).alias("recovered"))
    p = F.col("sensitivity")
    return got.withColumn("sensitivity", safe_ratio(F.col("recovered"), F.col("n"))).withColumn("se", F.sqrt(p * (1 - p) / F.col("n")))


def full_length_effort(contigs: DataFrame, dataset: str, depth: str, least: float = 0.95, cov: str = "reference_coverage") -> DataFrame:
    """Sequences at full length by data set and depth, then mean and sd over data sets."""
    per = contigs.groupBy(dataset, depth).agg(F.count_if(F.col(cov) >= least).alias("n_full"))
    return per.groupBy(depth).agg(F.count(F.lit(1)).alias("n_sets"), F.avg("n_full").alias("mean_full"), F.stddev_samp("n_full").alias("sd_full"))


def band_counts(contigs: DataFrame, by: Sequence[str], cov: str = "reference_coverage") -> DataFrame:
    """Sequences by group and coverage band."""
    return contigs.groupBy(*by, coverage_band(F.col(cov)).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def band_share(contigs: DataFrame, tool: str, fold: str, cov: str = "reference_coverage") -> DataFrame:
    """Share of each band among a tool's sequences of a fold, then mean and standard error over folds."""
    w = Window.partitionBy(tool, fold)
    share = band_counts(contigs, [tool, fold], cov).withColumn("share", safe_ratio(F.col("n"), F.sum("n").over(w)))
    return share.groupBy(tool, "band").agg(F.count(F.lit(1)).alias("n_folds"), F.avg("share").alias("mean_share"), (F.stddev_samp("share") / F.sqrt(F.count(F.lit(1)))).alias("se_share"))


def coverage_ecdf(contigs: DataFrame, tool: str, cov: str = "reference_coverage") -> DataFrame:
    """Empirical distribution of coverage by tool, on distinct values, from running counts over ranges of values."""
    counts = contigs.where(F.col(cov).isNotNull()).groupBy(tool, cov).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy(tool).agg(F.sum("n").alias("_all")).withColumnRenamed(tool, "_tool")
    upto = cumulative(counts, [tool], cov, "n", "_upto").join(whole, F.col(tool).eqNullSafe(F.col("_tool")))
    return upto.select(tool, cov, "n", safe_ratio(F.col("_upto"), F.col("_all")).alias("ecdf"))


def running_pr_auc(metrics: DataFrame, by: Sequence[str], x: str = "sensitivity", y: str = "precision") -> DataFrame:
    """Trapezoid area under precision against sensitivity."""
    w = Window.partitionBy(*by).orderBy(x, y)
    area = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return metrics.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_a", area).groupBy(*by).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("auc"))


def assembly_stats(contigs: DataFrame, by: Sequence[str], n_refs: int, width: str = "length", gc: str = "prop_gc", cov: str = "reference_coverage", ref: str = "hits", shares: Sequence[float] = (0.25, 0.5, 0.75, 0.85, 0.95)) -> DataFrame:
    """One row for each assembly: counts and sizes of its sequences, N10 to N90, GC, sequences with a hit, references with a
    hit and covered to at least each of ``shares``, with their proportions of ``n_refs``. Null coverage counts as none."""
    w = F.col(width)
    sizes = contigs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_seqs"), F.min(w).alias("smallest"), F.max(w).alias("largest"), F.sum(w).alias("n_bases"), F.avg(w).alias("mean_len"),
        F.count_if(w < 200).alias("n_under_200"), F.count_if(w > 1000).alias("n_over_1k"), F.count_if(w > 10000).alias("n_over_10k"),
        safe_ratio(F.sum(F.col(gc) * w), F.sum(w)).alias("gc"), F.count(ref).alias("n_with_hit"), F.avg(F.col(ref).isNotNull().cast("int")).alias("p_with_hit"),
    )
    xs = [10, 30, 50, 70, 90]
    nx = nx_lx(contigs, by, width, xs).groupBy(*by).agg(*[F.max(F.when(F.col("x") == x, F.col("n"))).alias(f"n{x}") for x in xs])
    best = contigs.where(F.col(ref).isNotNull()).groupBy(*by, ref).agg(F.coalesce(F.max(cov), F.lit(0.0)).alias("_best"))
    covered = best.groupBy(*by).agg(F.count(F.lit(1)).alias("n_refs_with_hit"), *[F.count_if(F.col("_best") >= x).alias(f"cov{round(100 * x)}") for x in shares])
    got = sizes.join(nx, list(by)).join(covered, list(by), "left").na.fill(0, ["n_refs_with_hit", *[f"cov{round(100 * x)}" for x in shares]])
    return got.withColumns({f"p_cov{round(100 * x)}": F.col(f"cov{round(100 * x)}") / n_refs for x in shares})
