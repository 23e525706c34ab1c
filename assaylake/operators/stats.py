"""Statistics from grouped passes: rank tests, effect sizes, correlations, profiles. Ranks come from value counts."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaylake.functions.expressions import safe_ratio
from assaylake.functions.tails import chi2_p, f_p, normal_p, t_p

from .graph import materialise


def long_form(df: DataFrame, variables: Sequence[str], cls: Sequence[str] = ()) -> DataFrame:
    """(classes, variable, value) of numeric columns without nulls."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])
    return df.select(*cls, F.explode(pairs).alias("x")).select(*cls, "x.*").where("value IS NOT NULL")


class Run(NamedTuple):
    """A running ``f`` of a column; ``join`` puts the results of two stretches together. ``back``: from the end; ``own``: with the row itself."""

    column: str
    f: Callable
    join: Callable
    back: bool = False
    own: bool = True


def running_sum(column: str) -> Run:
    return Run(column, F.sum, lambda c, b: F.coalesce(c, F.lit(0)) + F.coalesce(b, F.lit(0)))


def over_ranges(rows: DataFrame, by: Sequence[str], order: Sequence[str], runs: dict[str, Run]) -> DataFrame:
    """``rows`` with a column for each of ``runs``, by group, in ``order``.

    Rows are dealt to ranges of (group, order), which are run through by themselves and then moved by what comes before
    (or after) them, so no task sees a group whole; between tasks go a row for each range and group.
    """
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialise(rows.repartitionByRange(parts, *by, *order).withColumn("_p", F.spark_partition_id()), "value-counts")  # once: ranges are sampled
    sums = dealt.groupBy("_p", *by).agg(*[r.f(r.column).alias(f"_s_{out}") for out, r in runs.items()])
    between = Window.partitionBy(*by).orderBy("_p")
    others = lambda r: between.rowsBetween(1, Window.unboundedFollowing) if r.back else between.rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("_p").alias("_p2"), *[F.col(c).alias(f"_by_{c}") for c in by], *[r.f(f"_s_{out}").over(others(r)).alias(f"_b_{out}") for out, r in runs.items()])
    inner = Window.partitionBy("_p", *by).orderBy(*order)
    own = lambda r: inner.rowsBetween(0 if r.own else 1, Window.unboundedFollowing) if r.back else inner.rowsBetween(Window.unboundedPreceding, 0 if r.own else -1)
    inside = dealt.select("*", *[r.f(r.column).over(own(r)).alias(f"_c_{out}") for out, r in runs.items()])
    on = [F.col("_p") == F.col("_p2"), *[F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]]
    return inside.join(before, on).select(*rows.columns, *[r.join(F.col(f"_c_{out}"), F.col(f"_b_{out}")).alias(out) for out, r in runs.items()])


def cumulative(counts: DataFrame, by: Sequence[str], value: str | Sequence[str], n: str | dict[str, str], out: str = "") -> DataFrame:
    """``counts`` with the running sum ``out`` of ``n`` over rows in order of ``value``, by group; ``n`` may also name several results' columns."""
    named = {out: n} if isinstance(n, str) else n
    return over_ranges(counts, by, [value] if isinstance(value, str) else value, {o: running_sum(c) for o, c in named.items()})


def average_ranks(long: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """(by, value, ties, rank): mean rank of each distinct value, however many values a group has."""
    counts = long.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    return cumulative(counts, by, value, "ties", "_upto").withColumn("rank", F.col("_upto") - (F.col("ties") - 1) / 2).drop("_upto")


def ranks_in_blocks(long: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """``average_ranks`` for many groups of a few rows each."""
    counts = long.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    return counts.withColumn("rank", F.sum("ties").over(Window.partitionBy(*by).orderBy(value)) - (F.col("ties") - 1) / 2)


def quantiles(long: DataFrame, by: Sequence[str], shares: Sequence[float], value: str = "value") -> DataFrame:
    """(by, share, quantile): exact quantiles, linear between neighbours, from running counts of values; nulls are passed over."""
    return quantiles_of_counts(long.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")), by, shares, value)


def quantiles_of_counts(counts: DataFrame, by: Sequence[str], shares: Sequence[float], value: str) -> DataFrame:
    """``quantiles`` of (by, value, _n), the counts of distinct values."""
    upto = cumulative(counts, by, value, "_n", "_upto")
    whole = counts.groupBy(*by).agg(F.sum("_n").alias("_all")).select(*[F.col(c).alias(f"_of_{c}") for c in by], "_all")
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] or [F.lit(True)]
    at = upto.join(whole, on).withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares]))).withColumn("_at", F.col("share") * (F.col("_all") - 1))
    holds = lambda i: (F.col("_upto") > i) & (F.col("_upto") - F.col("_n") <= i)
    low, high = F.floor("_at"), F.ceil("_at")
    ends = at.where(holds(low) | holds(high)).groupBy(*by, "share").agg(F.max(F.when(holds(low), F.col(value))).alias("_l"), F.max(F.when(holds(high), F.col(value))).alias("_h"), F.max(F.col("_at") - low).alias("_w"))
    return ends.select(*by, "share", (F.col("_l") + F.col("_w") * (F.col("_h") - F.col("_l"))).alias("quantile"))


def zscore(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / sd by group, 0 where sd is tiny; group moments are aggregated and joined."""
    m = df.groupBy(*by).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    got = df.join(m, list(by)) if by else df.crossJoin(F.broadcast(m))  # one row without groups
    return got.withColumn("z", F.when(F.col("_s") < 1e-10, 0.0).otherwise((F.col(column) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def iqr_outlier_mask(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Rows within 1.5 interquartile ranges of the quartiles of their group."""
    q = quantiles(df, by, [0.25, 0.75], column).groupBy(*by).agg(F.max(F.when(F.col("share") == 0.25, F.col("quantile"))).alias("_q1"), F.max(F.when(F.col("share") == 0.75, F.col("quantile"))).alias("_q3"))
    r = F.col("_q3") - F.col("_q1")
    return df.join(q, list(by)).where(F.col(column).between(F.col("_q1") - 1.5 * r, F.col("_q3") + 1.5 * r)).drop("_q1", "_q3")


def nx_lx(df: DataFrame, by: Sequence[str], width: str, xs: Sequence[int]) -> DataFrame:
    """N and L for each x percent: the width at which the longest sequences first pass x percent of all, and how many they are.

    Works on counts of widths, not on sequences.
    """
    counts = df.where(F.col(width).isNotNull()).groupBy(*by, width).agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumns({"_back": -F.col(width), "_mass": F.col(width) * F.col("c")})
    whole = counts.groupBy(*by).agg(F.sum("_mass").alias("all")).select(*[F.col(c).alias(f"_of_{c}") for c in by], "all")
    run = cumulative(counts, by, "_back", {"sum": "_mass", "upto": "c"}).withColumn("below", F.col("upto") - F.col("c"))
    run = run.join(whole, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] or [F.lit(True)])
    cut = run.withColumn("x", F.explode(F.array(*[F.lit(x) for x in xs]))).withColumn("goal", F.col("all") * F.col("x") / 100)
    reached = cut.where(F.col("sum") >= F.col("goal")).groupBy(*by, "x").agg(F.max(F.struct(F.col(width).alias("w"), "below", "sum", "goal", "c")).alias("r"))
    short = F.col("r.goal") - (F.col("r.sum") - F.col("r.w") * F.col("r.c"))
    return reached.select(*by, "x", F.col("r.w").alias("n"), (F.col("r.below") + F.greatest(F.ceil(short / F.col("r.w")), F.lit(1))).cast("long").alias("l"))


def summary_stats(df: DataFrame, variables: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n, mean, sd, se and five numbers of each variable by group."""
    long, keys = long_form(df, variables, by), [*by, "variable"]
    got = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    p = lambda x: F.max(F.when(F.col("share") == x, F.col("quantile")))
    q = quantiles(long, keys, [0.25, 0.5, 0.75]).groupBy(*keys).agg(p(0.25).alias("q1"), p(0.5).alias("median"), p(0.75).alias("q3"))
    q = q.select(*[F.col(c).alias(f"_q_{c}") for c in keys], "q1", "median", "q3")
    got = got.join(q, [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in keys])
    return got.select(*keys, "n", "mean", "sd", "min", "q1", "median", "q3", "max", (F.col("sd") / F.sqrt("n")).alias("se"))


def confusion_matrix(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Per class TP, FP, FN, precision, recall, F1: each pair is counted once, then dealt to its two classes."""
    pairs = df.groupBy(predicted, actual).agg(F.count(F.lit(1)).alias("n"))
    p, a = F.col(predicted), F.col(actual)
    each = pairs.select("n", F.explode(F.when(p == a, F.array(F.struct(p.alias("cls"), F.lit("tp").alias("kind")))).otherwise(F.array(F.struct(p.alias("cls"), F.lit("fp").alias("kind")), F.struct(a.alias("cls"), F.lit("fn").alias("kind"))))).alias("x")).select("n", "x.*")
    s = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k.upper())
    got = each.groupBy("cls").agg(s("tp"), s("fp"), s("fn"))
    return got.withColumn("precision", safe_ratio(F.col("TP"), F.col("TP") + F.col("FP"))).withColumn("recall", safe_ratio(F.col("TP"), F.col("TP") + F.col("FN"))).withColumn("F1", safe_ratio(2 * F.col("TP"), 2 * F.col("TP") + F.col("FP") + F.col("FN")))


def factorial_means(df: DataFrame, factors: Sequence[str], metric: str) -> DataFrame:
    """Means over the grid of factors with all margins."""
    return df.cube(*factors).agg(F.grouping_id().cast("int").alias("margin"), F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean"))


def cross_tab(df: DataFrame, target: str, secondary: str) -> DataFrame:
    counts = df.groupBy(target, secondary).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", safe_ratio(F.col("n"), F.sum("n").over(Window.partitionBy(secondary))))


def class_profile(df: DataFrame, variables: Sequence[str], cls: str) -> DataFrame:
    """Median by class and variable, and its z-score across classes."""
    med = quantiles(long_form(df, variables, [cls]), [cls, "variable"], [0.5]).select(cls, "variable", F.col("quantile").alias("median"))
    w = Window.partitionBy("variable")
    sd = F.stddev_samp("median").over(w)
    return med.withColumn("z", F.when(sd < 1e-10, 0.0).otherwise((F.col("median") - F.avg("median").over(w)) / sd))


def pearson_matrix(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(a, b, r) of every pair of variables in one pass."""
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[i + 1 :]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def spearman_matrix(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(a, b, r) of average ranks. All variables are ranked in one pass over counts of values, and ranks are joined to the rows."""
    df = df.select(*[F.col(v).cast("double").alias(v) for v in variables])
    ranks = materialise(average_ranks(long_form(df, variables), ["variable"]), "ranks")  # so that its size is known
    for v in variables:
        r = ranks.where(F.col("variable") == v).select(F.col("value").alias(f"_v_{v}"), F.col("rank").alias(f"_r_{v}"))
        df = df.join(r, F.col(v) == F.col(f"_v_{v}"), "left").drop(f"_v_{v}")
    got = pearson_matrix(df, [f"_r_{v}" for v in variables])
    return got.withColumns({"a": F.substring("a", 4, 1000), "b": F.substring("b", 4, 1000)})


def spearman_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """(rho, n, p) of rows that have both: p from t = rho sqrt((n - 2) / (1 - rho^2)), two-sided."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = both.agg(F.count(F.lit(1)).alias("n"))
    got = spearman_matrix(both, [x, y]).select(F.col("r").alias("rho")).crossJoin(F.broadcast(n))  # one row
    return got.withColumn("p", t_p(F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho"))), F.col("n") - 2))


def _between(long: DataFrame, cls: str) -> DataFrame:
    """(variable, k, N, F, eta2, p): classes against what varies within them, from group moments of (cls, variable, value)."""
    g = long.where(F.col(cls).isNotNull()).groupBy("variable", cls).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    n, m = F.col("n"), F.col("m")
    s = g.groupBy("variable").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"), F.sum(n * F.col("v")).alias("ssw"), (F.sum(n * m * m) - F.pow(F.sum(n * m), F.lit(2.0)) / F.sum(n)).alias("ssb"))
    got = s.select("variable", "k", "N", safe_ratio(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("N") - F.col("k"))).alias("F"), safe_ratio(F.col("ssb"), F.col("ssb") + F.col("ssw")).alias("eta2"))
    return got.withColumn("p", f_p("F", F.col("k") - 1, F.col("N") - F.col("k")))


def anova_eta2(df: DataFrame, variables: Sequence[str], cls: str) -> DataFrame:
    """One-way F, eta squared and p of each variable."""
    return _between(long_form(df, variables, [cls]), cls)


def _ranked_cells(long: DataFrame, cls: str) -> tuple[DataFrame, DataFrame]:
    """(variable, value, cls, n, rank, ties), and (variable, N, t), t being the sum of ties^3 - ties: from one count of the cells."""
    cells = materialise(long.where(F.col(cls).isNotNull()).groupBy("variable", "value", cls).agg(F.count(F.lit(1)).alias("n")), "rank-cells")
    counts = cells.groupBy("variable", "value").agg(F.sum("n").alias("ties"))
    ranks = materialise(cumulative(counts, ["variable"], "value", "ties", "_upto").withColumn("rank", F.col("_upto") - (F.col("ties") - 1) / 2).drop("_upto"), "ranks")
    ties = ranks.groupBy("variable").agg(F.sum("ties").alias("N"), F.sum(F.pow(F.col("ties").cast("double"), F.lit(3.0)) - F.col("ties")).alias("t"))
    return cells.join(ranks, ["variable", "value"]), ties


def kruskal_wallis(df: DataFrame, variables: Sequence[str], cls: str) -> DataFrame:
    """Tie-corrected H of each variable, and its p by chi squared."""
    cells, ties = _ranked_cells(long_form(df, variables, [cls]), cls)
    groups = cells.groupBy("variable", cls).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("R"))
    h = groups.groupBy("variable").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("R") * F.col("R") / F.col("n")).alias("s")).join(ties, "variable")
    N = F.col("N").cast("double")
    got = h.select("variable", "k", "N", safe_ratio(12 / (N * (N + 1)) * F.col("s") - 3 * (N + 1), 1 - F.col("t") / (N * N * N - N)).alias("H"))
    return got.withColumn("p", chi2_p("H", F.col("k") - 1))


def wilcoxon_rank_sum(df: DataFrame, variables: Sequence[str], cls: str, a: str, b: str, correct: bool = True) -> DataFrame:
    """U of class ``a`` against ``b``, its tie-corrected normal deviate, and the two-sided p, by default with half a rank's correction for continuity."""
    cells, ties = _ranked_cells(long_form(df, variables, [cls]).where(F.col(cls).isin(a, b)), cls)
    of = lambda x: F.sum(F.when(F.col(cls) == x, F.col("n")).otherwise(0)).cast("double")
    s = cells.groupBy("variable").agg(of(a).alias("na"), of(b).alias("nb"), F.sum(F.when(F.col(cls) == a, F.col("n") * F.col("rank"))).alias("ra")).join(ties, "variable")
    na, nb = F.col("na"), F.col("nb")
    u = F.col("ra") - na * (na + 1) / 2
    n = na + nb
    sd, off = F.sqrt(na * nb / 12 * (n + 1 - F.col("t") / (n * (n - 1)))), u - na * nb / 2
    half = F.when(off != 0, 0.5).otherwise(0.0) if correct else F.lit(0.0)
    got = s.select("variable", na.cast("long").alias("n_a"), nb.cast("long").alias("n_b"), u.alias("U"), safe_ratio(off, sd).alias("z"), safe_ratio(F.abs(off) - half, sd).alias("_c"))
    return got.withColumn("p", normal_p("_c")).drop("_c")


def pairwise_t(df: DataFrame, variable: str, cls: str, by: Sequence[str] = ()) -> DataFrame:
    """Welch's t, degrees of freedom and two-sided p for every pair of classes in each group, from moments."""
    m = df.where(F.col(cls).isNotNull()).groupBy(*by, cls).agg(F.count(variable).alias("n"), F.avg(variable).alias("m"), F.var_samp(variable).alias("v"))
    a = m.select(*by, F.col(cls).alias("a"), F.col("n").alias("na"), F.col("m").alias("ma"), F.col("v").alias("va"))
    b = m.select(*by, F.col(cls).alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"), F.col("v").alias("vb"))
    pairs = a.join(b, list(by)) if by else a.crossJoin(b)  # moments: a row for each class
    x, y = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    got = pairs.where("a < b").select(*by, "a", "b", safe_ratio(F.col("ma") - F.col("mb"), F.sqrt(x + y)).alias("t"), safe_ratio((x + y) * (x + y), x * x / (F.col("na") - 1) + y * y / (F.col("nb") - 1)).alias("df"))
    return got.withColumn("p", t_p("t", "df"))


def levene(df: DataFrame, variables: Sequence[str], cls: str) -> DataFrame:
    """Analysis of variance on absolute deviations from the class median."""
    long = long_form(df, variables, [cls])
    med = quantiles(long, ["variable", cls], [0.5]).select("variable", cls, F.col("quantile").alias("_m"))
    dev = long.join(med, ["variable", cls]).select("variable", cls, F.abs(F.col("value") - F.col("_m")).alias("value"))
    return _between(dev, cls).select("variable", "k", "N", "F", "p")


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """Chi squared of ranks within blocks, tie-corrected, and its p; one value for each block and treatment."""
    df = materialise(df, "blocks")  # rows meet their rank by their value
    ranks = ranks_in_blocks(df.select(block, F.col(value).alias("value")), [block])
    k = df.select(F.count_distinct(treatment).alias("k"), F.count_distinct(block).alias("b"))
    sums = df.join(ranks, (df[block] == ranks[block]) & (df[value] == ranks["value"])).groupBy(treatment).agg(F.sum("rank").alias("R"))
    ties = ranks.agg(F.sum(F.pow(F.col("ties").cast("double"), F.lit(3.0)) - F.col("ties")).alias("t"))
    one = sums.agg(F.sum(F.col("R") * F.col("R")).alias("s")).crossJoin(k).crossJoin(ties)  # one row each
    kk, b = F.col("k").cast("double"), F.col("b").cast("double")
    got = one.select("k", "b", safe_ratio(12 * F.col("s") / (b * kk * (kk + 1)) - 3 * b * (kk + 1), 1 - F.col("t") / (b * (kk * kk * kk - kk))).alias("chi2"))
    return got.withColumn("p", chi2_p("chi2", F.col("k") - 1))


def p_adjust(df: DataFrame, p: str, by: Sequence[str] = (), method: str = "BH") -> DataFrame:
    """``df`` with adjusted p-values (BH, bonferroni or none) and significance stars; a null p has neither and is not counted.

    BH takes for each distinct p the least of q n / (how many are up to q) over all q from p on: running counts and running
    minima over ranges of values, so a table of any number of tests is many tasks' work. The tests are written first: rows
    meet their adjusted value by their p, and an aggregate that is worked out twice need not give the same last bit.
    """
    df = materialise(df, "tests")
    key = [F.col(c) for c in by]
    counts = df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    if method == "BH":
        counts = cumulative(counts, by, "_q", "_n", "_upto")
    whole = counts.groupBy(*by).agg(F.sum("_n").alias("_all")).select(*[F.col(c).alias(f"_of_{c}") for c in by], "_all")
    counts = counts.join(whole, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] or [F.lit(True)])
    if method == "BH":
        counts = over_ranges(counts.withColumn("_x", F.col("_q") * F.col("_all") / F.col("_upto")), by, ["_q"], {"_least": Run("_x", F.min, F.least, back=True)})
        adj = F.col("_least")
    else:
        adj = F.col("_q") * (F.col("_all") if method == "bonferroni" else 1)
    found = counts.select(*[c.alias(f"_to_{n}") for c, n in zip(key, by, strict=True)], "_q", F.least(adj, F.lit(1.0)).alias("p_adj"))
    q = F.col("p_adj")
    got = df.join(found, [F.col(p) == F.col("_q"), *[F.col(c).eqNullSafe(F.col(f"_to_{c}")) for c in by]], "left").select(*df.columns, "p_adj")
    return got.withColumn("stars", F.when(q < 0.001, "***").when(q < 0.01, "**").when(q < 0.05, "*").when(q.isNotNull(), "ns"))


def equal_frequency_bins(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Bin 1 to n of each row by exact quantile cuts: one row of cuts, no global sort of rows."""
    cuts = quantiles(df, [], [i / n for i in range(1, n)], column).agg(F.array_sort(F.collect_list("quantile")).alias("_cuts"))  # n - 1 numbers
    return df.crossJoin(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("_cuts", lambda c: c < F.col(column))) + 1).drop("_cuts")


def mutual_information(df: DataFrame, variables: Sequence[str], cls: str, n: int = 10) -> DataFrame:
    """Nats between a variable's equal-frequency bins and a class."""
    out = None
    for v in variables:
        cells = equal_frequency_bins(df.where(F.col(v).isNotNull() & F.col(cls).isNotNull()), v, n).groupBy("bin", cls).agg(F.count(F.lit(1)).cast("double").alias("c"))
        x, y, t = (F.sum("c").over(Window.partitionBy(*k)) for k in (["bin"], [cls], []))
        mi = cells.withColumn("_t", F.col("c") / t * F.ln(F.col("c") * t / (x * y))).agg(F.sum("_t").alias("mi")).select(F.lit(v).alias("variable"), "mi")
        out = mi if out is None else out.unionByName(mi)
    return out


def quality_profile(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, mean, p10, q1, median, q3, p90) of a value, exactly; nulls are passed over."""
    names = {0.1: "p10", 0.25: "q1", 0.5: "median", 0.75: "q3", 0.9: "p90"}
    q = quantiles(df, by, list(names), value).groupBy(*[F.col(c).alias(f"_q_{c}") for c in by]).agg(*[F.max(F.when(F.col("share") == x, F.col("quantile"))).alias(n) for x, n in names.items()])
    means = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    return means.join(q, [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in by], "left").select(*by, "mean", *names.values())


def shifted_classes(df: DataFrame, label: str, odds: float, by: Sequence[str] = (), folds: int = 0) -> DataFrame:
    """(by, label, n, p, p_shifted, p_mean): the shares of ordered classes, what they become when all cumulative odds are multiplied, and the mean of the two.

    Classes ascend by ``label``, nulls left out. A cumulative share c becomes o c / (1 - c + o c), and differences of
    neighbours give the classes again. Windows run over classes, a row for each. With ``folds``, ``by`` is a fold from 1
    on, and the shares are those of all other folds: totals less the fold's own.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if folds:
        all_ = counts.groupBy(label).agg(F.sum("n").alias("_t")).select(label, "_t", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(folds).cast("long"))).alias("_f"))
        own = counts.select(F.col(by[0]).alias("_g"), F.col(label).alias("_l"), "n")
        got = all_.join(own, (F.col("_f") == F.col("_g")) & (F.col(label) == F.col("_l")), "left")
        counts = got.select(F.col("_f").alias(by[0]), label, (F.col("_t") - F.coalesce("n", F.lit(0.0))).alias("n")).where("n > 0")
    w = Window.partitionBy(*by)
    upto = lambda x: F.sum(x).over(w.orderBy(label).rowsBetween(Window.unboundedPreceding, 0))
    o = F.lit(float(odds))
    got = counts.withColumn("_all", F.sum("n").over(w)).withColumn("_c", upto("n") / F.col("_all")).withColumn("_e", o * F.col("_c") / (1 - F.col("_c") + o * F.col("_c")))
    got = got.withColumns({"p": F.col("n") / F.col("_all"), "p_shifted": F.col("_e") - F.coalesce(F.lag("_e").over(w.orderBy(label)), F.lit(0.0))})
    return got.select(*by, label, F.col("n").cast("long").alias("n"), "p", "p_shifted", ((F.col("p") + F.col("p_shifted")) / 2).alias("p_mean"))


def ordinal_power(classes: DataFrame, odds: float, by: Sequence[str] = (), p: str = "p", n: Column | str | None = None, fraction: float = 0.5, alpha: float = 0.05, power: float = 0.9) -> DataFrame:
    """(by, odds, ps, n_needed, power): proportional odds of two groups on ordered classes whose shares are ``p``.

    ps = 1 - sum p^3. ``n_needed`` rows in all, ``fraction`` of them in the first group, find the odds ratio with ``power``
    at level ``alpha``: 3 (za + zb)^2 / (fraction (1 - fraction) ln(odds)^2 ps). ``power`` is what ``n`` rows have that are
    dealt in the same way, ln(odds) having the variance 3 (n + 1)^2 / (n1 n2 n ps); by default ``n_needed`` rows, rounded.
    """
    normal = NormalDist()
    za, zb = normal.inv_cdf(1 - alpha / 2), normal.inv_cdf(power)
    lod, f = math.log(odds), fraction * (1 - fraction)
    got = classes.groupBy(*by).agg((1 - F.sum(F.pow(p, F.lit(3.0)))).alias("ps"))
    got = got.withColumn("n_needed", 3 * (za + zb) ** 2 / (f * lod * lod) / F.col("ps"))
    rows = F.round("n_needed") if n is None else (F.col(n) if isinstance(n, str) else n)
    at = abs(lod) * F.sqrt(rows * rows * rows * f * F.col("ps") / 3 / ((rows + 1) * (rows + 1))) - za
    reached = F.when(at >= 0, 1 - normal_p(at) / 2).otherwise(normal_p(at) / 2)
    return got.select(*by, F.lit(float(odds)).alias("odds"), "ps", "n_needed", reached.alias("power"))


def cluster_curve_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, standard error (0 for one), minimum and maximum."""
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(n.alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value) / F.sqrt(n), F.lit(0.0)).alias("se"), F.min(value).alias("min"), F.max(value).alias("max"))


def cumulative_error(df: DataFrame, by: Sequence[str], cycle: str, quality: str) -> DataFrame:
    """Running sum of 10^(-Q/10) over cycles."""
    w = Window.partitionBy(*by).orderBy(cycle)
    return df.withColumn("error", F.pow(F.lit(10.0), -F.col(quality) / 10)).withColumn("cumulative", F.sum("error").over(w))


def metric_correlation(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation, slope and intercept by group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
