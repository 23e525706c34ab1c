"""Alignment hits: filtering, annotation of queries, overlaps, depth and coverage of intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaylake.functions.expressions import safe_ratio

from .graph import materialise
from .stats import Run, over_ranges, quantiles_of_counts, running_sum


def filter_hits(hits: DataFrame, min_coverage: float = 0.5, min_identity: float = 80) -> DataFrame:
    """Adds coverage of query, subject and the larger of both; keeps hits at the minima."""
    q, s = safe_ratio(F.col("length"), F.col("qlen")), safe_ratio(F.col("length"), F.col("slen"))
    got = hits.withColumns({"cov_query": q, "cov_subject": s}).withColumn("max_coverage", F.greatest("cov_query", "cov_subject"))
    return got.where((F.col("max_coverage") >= min_coverage) & (F.col("pident") >= min_identity))


def _per_query(hits: DataFrame, contigs_per_subject: Column) -> DataFrame:
    """By query: hits, subjects, the most sequences that share one of its subjects, and whether any does. One join, on subjects."""
    per = materialise(hits.groupBy("sseqid").agg(contigs_per_subject.alias("_m")), "hits-of-subjects")  # written, so that Spark can split a hot subject
    joined = hits.join(per, "sseqid")
    return joined.groupBy("qseqid").agg(
        F.count(F.lit(1)).alias("n_hits"), F.count_distinct("sseqid").alias("n_unique_subjects"), F.max("_m").alias("max_contigs_per_subject"),
        F.max("bitscore").alias("best_bitscore"), F.max("pident").alias("best_pident"), F.max("max_coverage").alias("best_max_coverage"),
        F.max(F.struct("length", "sseqid", "slen")).alias("_longest"), F.max(F.struct("bitscore", "sseqid")).alias("_best"),
    )


def _category() -> Column:
    n, s, m = F.col("n_hits"), F.col("n_unique_subjects"), F.col("max_contigs_per_subject")
    return F.when(n == 0, "no hit").when((n == 1) & (s == 1) & (m == 1), "1->1").when((n > 1) & (m == 1), "m->1").when((n == 1) & (m > 1), "1->n").otherwise("m->n")


def hit_category(hits: DataFrame) -> DataFrame:
    """Per query: counts and how it relates to subjects (1->1, m->1, 1->n, m->n), by distinct queries of a subject."""
    return _per_query(hits, F.count_distinct("qseqid")).withColumn("prelim_cat", _category()).drop("_longest", "_best")


def annotate_hits(hits: DataFrame, coverage_threshold: float = 0.9) -> DataFrame:
    """Per query the category and its label full, fragment, chimera or multi, in closed form: aggregates, no self-join."""
    per = _per_query(hits, F.count_distinct("qseqid")).withColumn("prelim_cat", _category())
    cov = safe_ratio(F.col("_longest.length"), F.col("_longest.slen"))
    whole = F.when(cov >= coverage_threshold, "full").otherwise("fragment")
    label = F.when(F.col("prelim_cat") == "1->1", whole).when(F.col("prelim_cat") == "m->1", "fragment").when(F.col("prelim_cat") == "1->n", "chimera").when(F.col("n_unique_subjects") == 1, whole).otherwise("multi")
    return per.withColumn("final_annotation", label).withColumn("best_subject", F.col("_best.sseqid")).drop("_longest", "_best")


def _fewest(length: Column, threshold: float) -> Column:
    """The fewest shared positions that are more than the threshold's share of a length."""
    n = F.floor(length * threshold)
    over = lambda x: x / length > threshold
    return F.when(over(n), n).when(over(n + 1), n + 1).otherwise(n + 2)


def _overlapping(intervals: DataFrame, key: str, threshold: float) -> DataFrame:
    """Keys of ``intervals`` (key, owner, s, e) with two of different owners that share more than the threshold of the shorter one.

    A sweep in order of starts, without pairs. An interval meets an earlier one like this exactly if, of those with other
    owners, the one that reaches farthest shares enough for this one's length, or one shares enough for its own length. So
    the two best of different owners are carried along: the best so far, and the best of what it has displaced or held
    off. Ranges of (key, start) are swept by themselves and then see what the ranges before them end with, a row for each
    range and key, so no task sees a hot key whole. Positions are whole numbers; rows with a null take no part.
    """
    threshold = max(threshold, 0.0)
    parts = max(2, int(intervals.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = intervals.select(F.col(key).alias("key"), "owner", "s", "e").dropna().withColumn("need", _fewest(F.col("e") - F.col("s") + 1, threshold))
    dealt = materialise(rows.repartitionByRange(parts, "key", "s", "e", "owner").withColumn("_p", F.spark_partition_id()), "intervals")  # once: ranges are sampled
    earlier = Window.partitionBy("_p", "key").orderBy("s", "e", "owner").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    displaced = lambda a, b: F.when(a["owner"] != b["owner"], F.least(a, b))
    ways = {"far": F.col("e").cast("long"), "free": F.col("e") + 1 - F.col("need")}
    swept = dealt.withColumns({w: F.struct(x.alias("x"), "owner") for w, x in ways.items()})
    swept = swept.withColumns({f"{w}1": F.max(w).over(earlier) for w in ways})
    swept = swept.withColumns({f"{w}_off": displaced(F.col(f"{w}1"), F.col(w)) for w in ways})
    swept = swept.withColumns({f"{w}2": F.max(f"{w}_off").over(earlier) for w in ways})
    ends = swept.groupBy("_p", "key").agg(*[F.max(x).alias(f"end_{x}") for w in ways for x in (w, f"{w}_off")])
    ends = ends.withColumns({f"{w}_b1": F.max(f"end_{w}").over(before) for w in ways})
    ends = ends.withColumns({f"{w}_b_off": F.greatest(displaced(F.col(f"{w}_b1"), F.col(f"end_{w}")), F.col(f"end_{w}_off")) for w in ways})
    ends = ends.withColumns({f"{w}_b2": F.max(f"{w}_b_off").over(before) for w in ways}).select("_p", "key", *[f"{w}_b{i}" for w in ways for i in (1, 2)])
    other = lambda c: F.when(F.col(f"{c}1")["owner"] != F.col("owner"), F.col(f"{c}1")["x"]).otherwise(F.col(f"{c}2")["x"])
    meets = [c for at in ("", "_b") for c in (other(f"far{at}") - F.col("s") + 1 >= F.col("need"), other(f"free{at}") >= F.col("s"))]
    found = swept.join(ends, ["_p", "key"]).where(F.lit(threshold < 1) & F.coalesce(F.greatest(*meets), F.lit(False)))
    return found.select(F.col("key").alias(key)).distinct()


def _flagged(hits: DataFrame, key: str, owner: str, threshold: float) -> DataFrame:
    over = _overlapping(hits.dropna(subset=["sstart", "send"]).select(key, F.col(owner).alias("owner"), F.least("sstart", "send").alias("s"), F.greatest("sstart", "send").alias("e")), key, threshold)
    return hits.select(key).distinct().join(over.withColumn("overlaps", F.lit(True)), key, "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(False)))


def hit_overlap_selfjoin(hits: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per query: does any pair of its hits overlap on the subject axis by more than the threshold?"""
    return _flagged(hits, "qseqid", "hit_id", threshold)


def contig_overlap_selfjoin(hits: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per subject: does any pair of distinct queries overlap on it by more than the threshold?"""
    return _flagged(hits, "sseqid", "qseqid", threshold)


def annotation_summary(annotated: DataFrame) -> DataFrame:
    """Counts by label and by (category, label) with shares, in one pass of grouping sets."""
    got = annotated.groupingSets([[F.col("final_annotation")], [F.col("prelim_cat"), F.col("final_annotation")]], "prelim_cat", "final_annotation").agg(F.grouping("prelim_cat").alias("pooled"), F.count(F.lit(1)).alias("n"))
    return got.withColumn("share", safe_ratio(F.col("n"), F.sum("n").over(Window.partitionBy("pooled")))).select("prelim_cat", "final_annotation", F.col("pooled").cast("int").alias("pooled"), "n", "share")


def slice_max_one(df: DataFrame, by: str, value: str, tie: str) -> DataFrame:
    """The row of largest value in each group, one only: the smallest ``tie``."""
    w = Window.partitionBy(by).orderBy(F.col(value).desc(), tie)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reciprocal_best_hits(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Pairs that are each other's best hit; ties go to the smaller id."""
    f = slice_max_one(forward.groupBy("qseqid", "sseqid").agg(F.max("bitscore").alias("bitscore")), "qseqid", "bitscore", "sseqid")
    b = slice_max_one(backward.groupBy("qseqid", "sseqid").agg(F.max("bitscore").alias("bitscore")), "qseqid", "bitscore", "sseqid")
    b = b.select(F.col("qseqid").alias("sseqid"), F.col("sseqid").alias("qseqid"), F.col("bitscore").alias("back_bitscore"))
    return f.join(b, ["qseqid", "sseqid"])


def nearest_reference(hits: DataFrame, test_ids: DataFrame, test_id: str = "test_id") -> DataFrame:
    """The best hit of each test id by identity, then length, then id; identity 0 where there is none."""
    best = hits.groupBy(F.col("qseqid").alias(test_id)).agg(F.max(F.struct("pident", "length", "sseqid")).alias("b"))
    got = test_ids.join(best, test_id, "left")
    return got.select(test_id, F.col("b.sseqid").alias("nearest_ref_id"), F.coalesce("b.pident", F.lit(0.0)).alias("nri"), F.coalesce(F.col("b.length").cast("long"), F.lit(0)).alias("aln_len"))


def reference_coverage(hits: DataFrame, by: Sequence[str] = ("qseqid", "sseqid")) -> DataFrame:
    """Covered share of the subject: in order of starts, each hit adds what lies beyond the farthest end before it.

    Equal intervals are one row, ends before a range of the order come from the ranges before it, and sums are made
    before the shuffle: no task sees a hot subject whole.
    """
    h = hits.select(*by, F.least("sstart", "send").alias("s"), F.greatest("sstart", "send").alias("e"), "slen").groupBy(*by, "s", "e").agg(F.max("slen").alias("slen"))
    swept = over_ranges(h, by, ["s", "e"], {"reach": Run("e", F.max, F.greatest, own=False)})
    added = F.greatest(F.col("e") - F.greatest(F.col("s") - 1, F.col("reach")), F.lit(0))
    return swept.groupBy(*by).agg(F.sum(added).alias("covered"), F.max("slen").alias("slen")).withColumn("reference_coverage", safe_ratio(F.col("covered"), F.col("slen")))


def interval_depth(intervals: DataFrame, key: str, start: str = "s", end: str = "e") -> DataFrame:
    """Segments of constant depth (key, pos, next_pos, depth): starts and ends as events, a running sum over ranges, no row for each base."""
    lo, hi = F.least(start, end), F.greatest(start, end)
    events = intervals.select(key, F.explode(F.array(F.struct(lo.alias("pos"), F.lit(1).alias("d")), F.struct((hi + 1).alias("pos"), F.lit(-1).alias("d")))).alias("x")).select(key, "x.*")
    at = events.where("pos IS NOT NULL").groupBy(key, "pos").agg(F.sum("d").alias("d"))
    swept = over_ranges(at, [key], ["pos"], {"depth": running_sum("d"), "next_pos": Run("pos", F.min, F.least, back=True, own=False)})
    return swept.where("depth > 0").select(key, "pos", "next_pos", "depth")


def depth_stats(segments: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """Total and mean depth, bases with depth and without, covered share, from segments and lengths (key, slen)."""
    width = F.col("next_pos") - F.col("pos")
    per = segments.groupBy(key).agg(F.sum(width * F.col("depth")).alias("total_depth"), F.sum(width).alias("covered"))
    got = lengths.join(per, key, "left").withColumns({"total_depth": F.coalesce("total_depth", F.lit(0)), "covered": F.coalesce("covered", F.lit(0))})
    return got.select(key, "slen", "total_depth", safe_ratio(F.col("total_depth"), F.col("slen")).alias("mean_depth"), "covered", (F.col("slen") - F.col("covered")).alias("zero_bases"), safe_ratio(F.col("covered"), F.col("slen")).alias("covered_fraction"))


def pairwise_family_identity(hits: DataFrame, labels: DataFrame, seq_id: str = "ref_id", family: str = "family") -> DataFrame:
    """Five-number summary of identity for each pair of families, within or between."""
    q = labels.select(F.col(seq_id).alias("qseqid"), F.col(family).alias("query_family"))
    s = labels.select(F.col(seq_id).alias("sseqid"), F.col(family).alias("target_family"))
    by = ["query_family", "target_family"]
    counts = materialise(hits.join(q, "qseqid").join(s, "sseqid").groupBy(*by, "pident").agg(F.count(F.lit(1)).alias("_n")), "identities")
    p = lambda x: F.max(F.when(F.col("share") == x, F.col("quantile")))
    inner = quantiles_of_counts(counts.where("pident IS NOT NULL"), by, [0.25, 0.5, 0.75], "pident").groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(p(0.25).alias("q1"), p(0.5).alias("median"), p(0.75).alias("q3"))
    ends = counts.groupBy(*by).agg(F.sum("_n").alias("n"), F.min("pident").alias("min"), F.max("pident").alias("max"))
    got = ends.join(inner, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").select(*by, "n", "min", "q1", "median", "q3", "max")
    return got.withColumn("pair", F.when(F.col("query_family") == F.col("target_family"), "Within").otherwise("Between"))
