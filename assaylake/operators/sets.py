"""Overlaps between tools, dedup of sequences, and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaylake.functions.expressions import hash_order, safe_ratio

from .stats import cumulative


def joined_set(column: Column | str, sep: str = ",") -> Column:
    """Aggregate: distinct values without nulls, sorted, joined."""
    return F.array_join(F.array_sort(F.collect_set(column)), sep)


def set_combinations(df: DataFrame, item: str, member: str) -> DataFrame:
    """For each exact combination of members the number of items that have it, and whether it is of one member."""
    per = df.where(F.col(item).isNotNull()).groupBy(item).agg(joined_set(member).alias("combination"), F.count_distinct(member).alias("n_members"))
    return per.groupBy("combination", "n_members").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.when(F.col("n_members") == 1, "Unique").otherwise("Intersect"))


def combination_by_label(df: DataFrame, item: str, member: str, label: str) -> DataFrame:
    """Items by (combination, label), completed to the grid of both with zeros."""
    per = df.where(F.col(item).isNotNull()).groupBy(item).agg(joined_set(member).alias("combination"), F.min(label).alias(label))
    counts = per.groupBy("combination", label).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("combination").distinct().crossJoin(counts.select(label).distinct())  # combinations x labels, both few
    return grid.join(counts, ["combination", label], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def combination_coverage(df: DataFrame, item: str, member: str, cov: str) -> DataFrame:
    """Mean and sd, by combination, of each item's mean coverage."""
    per = df.where(F.col(item).isNotNull()).groupBy(item).agg(joined_set(member).alias("combination"), F.avg(cov).alias("_c"))
    return per.groupBy("combination").agg(F.count(F.lit(1)).alias("n"), F.avg("_c").alias("mean_cov"), F.stddev_samp("_c").alias("sd_cov"))


def combination_member_coverage(df: DataFrame, item: str, member: str, cov: str) -> DataFrame:
    """By combination and member: n, mean of each item's mean coverage, and sd over n."""
    kept = df.where(F.col(item).isNotNull())
    combos = kept.groupBy(item).agg(joined_set(member).alias("combination"))
    per = kept.groupBy(item, member).agg(F.avg(cov).alias("_c")).join(combos, item)
    return per.groupBy("combination", member).agg(F.count(F.lit(1)).alias("n"), F.avg("_c").alias("mean_cov"), (F.stddev_samp("_c") / F.count(F.lit(1))).alias("se_cov"))


def recovery_breadth(df: DataFrame, item: str, member: str, label: str) -> DataFrame:
    """By label and number of members that have an item: items."""
    per = df.where(F.col(item).isNotNull()).groupBy(item, label).agg(F.count_distinct(member).alias("n_members"))
    return per.groupBy(label, "n_members").agg(F.count(F.lit(1)).alias("n"))


def venn_regions(df: DataFrame, item: str, member: str, members: Sequence[str]) -> DataFrame:
    """Items by exact membership among up to four members, as a bit mask in their order."""
    bit = F.lit(0)
    for i, m in enumerate(members):
        bit = F.when(F.col(member) == m, 1 << i).otherwise(bit)
    return df.where(F.col(item).isNotNull() & F.col(member).isin(list(members))).groupBy(item).agg(F.bit_or(bit).alias("region")).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


def hit_rate_by_tool(df: DataFrame, tool: str, hit: str) -> DataFrame:
    """Rows with and without hit by tool, and distinct hits."""
    return df.groupBy(tool).agg(F.count(hit).alias("n_hit"), F.count_if(F.col(hit).isNull()).alias("n_no_hit"), F.count_distinct(hit).alias("n_refs"))


def exact_dedup_merge_ids(df: DataFrame, key: str, id_col: str, sep: str = "|") -> DataFrame:
    """One row for each sequence, its ids sorted and joined."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.col(id_col))).cast("array<string>"), sep).alias("merged_ids"), F.count(F.lit(1)).alias("n"))


def paired_dedup(df: DataFrame, nuc: str, prot: str, id_col: str, labels: Sequence[str] = ()) -> DataFrame:
    """One row for each pair of sequences: smallest id, rows collapsed, all ids, the smallest id's labels."""
    firsts = [F.min_by(c, id_col).alias(c) for c in labels]
    ids = F.array_join(F.array_sort(F.collect_list(F.col(id_col))).cast("array<string>"), "|")
    return df.groupBy(nuc, prot).agg(F.min(id_col).alias("rep_id"), F.count(F.lit(1)).alias("n_collapsed"), ids.alias("merged_ids"), *firsts)


def pairing_invariant(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids that one side has and the other lacks; no rows if the sides are paired."""
    x, y = a.select(key), b.select(key)
    return x.exceptAll(y).withColumn("missing_from", F.lit("b")).unionByName(y.exceptAll(x).withColumn("missing_from", F.lit("a")))


def distinct_projection(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def union_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; what a frame lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def unpivot_metrics(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(list(ids), list(values), "metric", "value")


def pivot_wide(df: DataFrame, by: Sequence[str], column: str, values: Sequence[str], agg: Column, fill: float = 0) -> DataFrame:
    """Named values of ``column`` as columns; the list of values saves a pass."""
    return df.groupBy(*by).pivot(column, list(values)).agg(agg).na.fill(fill, list(values))


def lower_triangle(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a) <= F.col(b))


def chunk_rows(df: DataFrame, order: str, size: int = 500, ties: Sequence[str] = ()) -> DataFrame:
    """Chunks of ``size`` rows in order, rows of one value by ``ties``. Rows are numbered within ranges of the order, not in one task."""
    numbered = cumulative(df.withColumn("_one", F.lit(1)), [], [order, *ties], "_one", "_r")
    return numbered.withColumn("chunk", F.floor((F.col("_r") - 1) / size) + 1).drop("_one", "_r")


def count_sorted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *columns)


def top_features(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The first n rows by value, ties by key."""
    return df.orderBy(F.col(value).desc(), key).limit(n)


def order_levels_by_stat(df: DataFrame, level: str, stat: Column) -> DataFrame:
    """Levels with their place by a statistic: a window over one row for each level."""
    per = df.groupBy(level).agg(stat.alias("stat"))
    return per.withColumn("ord", F.row_number().over(Window.orderBy(F.col("stat").desc(), level)))


def cap_sample(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """At most n rows, those of the smallest hashes."""
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def share_within(df: DataFrame, by: Sequence[str], n: str = "n") -> DataFrame:
    return df.withColumn("share", safe_ratio(F.col(n), F.sum(n).over(Window.partitionBy(*by))))


def classifier_consensus(df: DataFrame, key: str, regions: Sequence[str], label: str) -> DataFrame:
    """Regions unpivoted, '-' dropped, bracketed notes stripped; by key the regions, labels and their number; conflict if several labels."""
    long = df.select(key, label, F.explode(F.array(*[F.struct(F.lit(r).alias("region"), F.col(r).alias("call")) for r in regions])).alias("x")).select(key, label, "x.*")
    kept = long.where(F.col("call").isNotNull() & (F.col("call") != "-")).withColumn("call", F.regexp_replace("call", r"\s*\(.*\)", ""))
    return kept.groupBy(key).agg(joined_set("region", "_").alias("regions"), joined_set("call", "_").alias("calls"), F.count(F.lit(1)).alias("score"), (F.count_distinct("call") > 1).alias("conflict"))


def region_class(df: DataFrame, regions: str = "regions", complete: Sequence[str] = ("Mature", "Pro", "Signal")) -> DataFrame:
    """Complete where all named regions are there, else incomplete."""
    return df.withColumn("precursor", F.when(F.forall(F.array(*map(F.lit, complete)), lambda r: F.array_contains(F.split(regions, "_"), r)), "complete").otherwise("incomplete"))
