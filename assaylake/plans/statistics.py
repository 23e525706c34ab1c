"""Queries: statistics over numeric columns of the order tables and over labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.operators import stats as S

from .book import query
from .views import CONTIGS, contigs, table

VARS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CUBE = f"UNPIVOT (value FOR variable IN ({', '.join(VARS)}))"
LONG = f"lg AS (SELECT l_returnflag, variable, value FROM (SELECT l_returnflag, {', '.join(f'{v}::DOUBLE AS {v}' for v in VARS)} FROM lineitem) {CUBE})"

LONG_AR = LONG.replace("FROM lineitem", "FROM lineitem WHERE l_returnflag IN ('A', 'R')")


#: Simpson's rule in SQL, for oracles of tails; with three classes chi squared and F have closed tails.
SIMPSON = "(SELECT sum(CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * ({f})) FROM range(0, {n} + 1) AS s(i)) / 3 * ({x}) / {n}"


def integral(f: str, x: str, n: int = 4000) -> str:
    """The integral of ``f``, in which {u} stands for the variable, from 0 to ``x``."""
    return SIMPSON.format(n=n, x=x, f=f.format(u=f"(({x}) * i / {n})"))


def t_tail(t: str, df: str) -> str:
    return f"greatest(0, 1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi() * {df}) * " + integral(f"pow(1 + {{u}} * {{u}} / {df}, -({df} + 1) / 2)", f"least(abs({t}), 40)") + ")"


def normal_tail(z: str) -> str:
    return f"greatest(0, 1 - 2 / sqrt(2 * pi()) * {integral('exp(-{u} * {u} / 2)', f'least(abs({z}), 40)')})"


def chi2_tail(x: str, k: str) -> str:
    return f"greatest(0, 1 - {integral(f'CASE WHEN {{u}} > 0 THEN exp(({k} / 2 - 1) * ln({{u}} / 2) - {{u}} / 2 - lgamma({k} / 2)) / 2 ELSE 0 END', f'least({x}, {k} + 60 * sqrt(2 * {k}) + 2000)', 20000)})"


F3 = "pow((N - 3) / (N - 3 + 2 * F), (N - 3) / 2)"


def lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", *VARS)


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, (l_quantity - avg(l_quantity) OVER w) / stddev_samp(l_quantity) OVER w AS z FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)", "l_quantity z")
def zscore(spark, d):
    return S.zscore(lines(spark, d).select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), "l_quantity", ["l_returnflag"])


@query("WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders GROUP BY 1) SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders JOIN q USING (o_orderpriority) WHERE o_totalprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)", "o_totalprice")
def iqr_outlier_mask(spark, d):
    return S.iqr_outlier_mask(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_totalprice", ["o_orderpriority"])


NX = "w AS (SELECT l_returnflag, l_quantity::BIGINT AS w, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS r, sum(l_quantity) OVER (PARTITION BY l_returnflag) AS t FROM lineitem)"


@query(f"WITH {NX} SELECT l_returnflag, x, arg_min(w, r) AS n, min(r) AS l FROM w, (SELECT unnest([10, 25, 50, 75, 90]) AS x) WHERE c >= t * x / 100 GROUP BY ALL")
def nx_lx(spark, d):
    li = lines(spark, d).withColumn("w", F.col("l_quantity").cast("long"))
    return S.nx_lx(li, ["l_returnflag"], "w", [10, 25, 50, 75, 90])


@query(f"WITH {NX}, f AS (SELECT l_returnflag, CASE WHEN c <= t * 0.5 THEN 'N50' WHEN c <= t * 0.9 THEN 'N90' ELSE 'rest' END AS band FROM w), n AS (SELECT l_returnflag, band, count(*) AS n FROM f GROUP BY ALL) SELECT l_returnflag, band, n, n / sum(n) OVER (PARTITION BY l_returnflag) AS share FROM n", "share")
def nx_band_counts(spark, d):
    from pyspark.sql.window import Window

    li = lines(spark, d).withColumn("w", F.col("l_quantity").cast("long"))
    total = li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("all"), F.sum("w").alias("t"))
    # A sequence is in the band that the running sum is still within after it: one fewer where the last one passes it.
    counts = li.groupBy("l_returnflag", "w").agg(F.count(F.lit(1)).alias("c"))
    v = Window.partitionBy("l_returnflag").orderBy(F.col("w").desc())
    run = counts.withColumn("sum", F.sum(F.col("w") * F.col("c")).over(v)).join(total, "l_returnflag")
    within = lambda share: F.sum(F.greatest(F.least(F.col("c"), F.col("c") - F.ceil((F.col("sum") - F.col("t") * share) / F.col("w"))), F.lit(0)))
    n = run.groupBy("l_returnflag").agg(within(0.5).alias("a"), within(0.9).alias("b"), F.first("all").alias("all"))
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("band"), value.alias("n")) for name, value in (("N50", F.col("a")), ("N90", F.col("b") - F.col("a")), ("rest", F.col("all") - F.col("b")))])).alias("x")
    return n.select("l_returnflag", "all", rows).select("l_returnflag", "x.band", F.col("x.n").cast("long").alias("n"), (F.col("x.n") / F.col("all")).alias("share")).where("n > 0")


@query(f"WITH {LONG} SELECT l_returnflag, variable, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS max, stddev_samp(value) / sqrt(count(*)) AS se FROM lg GROUP BY ALL", "mean sd min q1 median q3 max se")
def summary_stats(spark, d):
    return S.summary_stats(lines(spark, d), VARS, ["l_returnflag"])


@query("""WITH p AS (SELECT l.quality AS a, (d.n_chars >= 1000)::INT AS b FROM labels l JOIN documents d USING (doc_id)), c AS (SELECT cls, count(*) FILTER (a = cls AND b = cls) AS TP, count(*) FILTER (b = cls AND a <> cls) AS FP, count(*) FILTER (a = cls AND b <> cls) AS FN FROM p, (SELECT unnest([0, 1]) AS cls) GROUP BY 1)
  SELECT cls, TP, FP, FN, TP / nullif(TP + FP, 0) AS "precision", TP / nullif(TP + FN, 0) AS recall, 2 * TP / nullif(2 * TP + FP + FN, 0) AS F1 FROM c""", '"precision" recall F1')
def confusion_matrix(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") >= 1000).cast("int").alias("predicted"))
    return S.confusion_matrix(table(spark, d, "labels").join(docs, "doc_id"), "predicted", "quality")


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::INT AS margin, count(*) AS n, avg(l_quantity) AS mean FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "mean")
def factorial_means(spark, d):
    return S.factorial_means(lines(spark, d), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("SELECT l_returnflag, l_linestatus, n, n / sum(n) OVER (PARTITION BY l_linestatus) AS share FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)", "share")
def cross_tab(spark, d):
    return S.cross_tab(lines(spark, d), "l_returnflag", "l_linestatus")


@query(f"WITH {LONG}, m AS (SELECT l_returnflag, variable, median(value) AS median FROM lg GROUP BY ALL) SELECT *, CASE WHEN stddev_samp(median) OVER w < 1e-10 THEN 0 ELSE (median - avg(median) OVER w) / stddev_samp(median) OVER w END AS z FROM m WINDOW w AS (PARTITION BY variable)", "median z")
def class_profile(spark, d):
    return S.class_profile(lines(spark, d), VARS, "l_returnflag")


def _pairs(rank: bool) -> str:
    cols = {v: f"_{v}" if rank else v for v in VARS}
    src = "lineitem" if not rank else "(SELECT " + ", ".join(f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2 AS _{v}" for v in VARS) + " FROM lineitem)"
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({cols[a]}, {cols[b]}) AS r FROM {src}" for i, a in enumerate(VARS) for b in VARS[i + 1 :])


@query(_pairs(False), "r")
def pearson_matrix(spark, d):
    return S.pearson_matrix(lines(spark, d), VARS)


@query(_pairs(True), "r")
def spearman_matrix(spark, d):
    return S.spearman_matrix(lines(spark, d), VARS)


RHO = """WITH r AS (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS a, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2 AS b FROM customer), s AS (SELECT corr(a, b) AS rho, count(*) AS n FROM r), t AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, (n - 2)::DOUBLE AS df FROM s)"""


@query(f"{RHO} SELECT rho, n, {t_tail('t', 'df')} AS p FROM t", "rho p")
def spearman_test(spark, d):
    return S.spearman_test(table(spark, d, "customer"), "c_acctbal", "c_nationkey")


ANOVA = "g AS (SELECT variable, l_returnflag, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM lg GROUP BY ALL), t AS (SELECT variable, avg(value) AS gm FROM lg GROUP BY 1), s AS (SELECT variable, count(*) AS k, sum(n)::BIGINT AS N, sum(ss) AS ssw, sum(n * (m - gm) * (m - gm)) AS ssb FROM g JOIN t USING (variable) GROUP BY 1)"


@query(f"WITH {LONG}, {ANOVA} SELECT *, {F3} AS p FROM (SELECT variable, k, N, (ssb / (k - 1)) / (ssw / (N - k)) AS F, ssb / (ssb + ssw) AS eta2 FROM s)", "F eta2 p")
def anova_eta2(spark, d):
    return S.anova_eta2(lines(spark, d), VARS, "l_returnflag")


RANKS = "rk AS (SELECT *, rank() OVER (PARTITION BY variable ORDER BY value) + (count(*) OVER (PARTITION BY variable, value) - 1) / 2 AS r FROM lg), tie AS (SELECT variable, sum(c * c * c - c)::DOUBLE AS t FROM (SELECT variable, value, count(*)::DOUBLE AS c FROM lg GROUP BY ALL) GROUP BY 1)"


@query(f"WITH {LONG}, {RANKS}, g AS (SELECT variable, l_returnflag, count(*) AS n, sum(r) AS R FROM rk GROUP BY ALL), h AS (SELECT variable, count(*) AS k, sum(n)::BIGINT AS N, sum(n)::DOUBLE AS d, sum(R * R / n) AS s FROM g GROUP BY 1) SELECT *, exp(-H / 2) AS p FROM (SELECT variable, k, N, (12 / (d * (d + 1)) * s - 3 * (d + 1)) / (1 - t / (d * d * d - d)) AS H FROM h JOIN tie USING (variable))", "H p")
def kruskal_wallis(spark, d):
    return S.kruskal_wallis(lines(spark, d), VARS, "l_returnflag")


@query(f"WITH {LONG_AR}, {RANKS}, s AS (SELECT variable, count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_returnflag = 'R') AS n_b, sum(r) FILTER (l_returnflag = 'A') AS ra FROM rk GROUP BY 1), u AS (SELECT *, ra - n_a * (n_a + 1) / 2.0 AS U, (n_a + n_b)::DOUBLE AS n FROM s JOIN tie USING (variable)) SELECT variable, n_a, n_b, U, d / sd AS z, {normal_tail("(abs(d) - CASE WHEN d <> 0 THEN 0.5 ELSE 0 END) / sd")} AS p FROM (SELECT *, U - n_a * n_b / 2.0 AS d, sqrt(n_a * n_b / 12.0 * (n + 1 - t / (n * (n - 1)))) AS sd FROM u)", "U z p")
def wilcoxon_rank_sum(spark, d):
    return S.wilcoxon_rank_sum(lines(spark, d), VARS, "l_returnflag", "A", "R")


WELCH = """WITH m AS (SELECT l_linestatus, l_returnflag AS c, count(l_quantity) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY ALL), w AS (SELECT x.l_linestatus, x.c AS a, y.c AS b, (x.m - y.m) / sqrt(x.v / x.n + y.v / y.n) AS t, pow(x.v / x.n + y.v / y.n, 2) / (pow(x.v / x.n, 2) / (x.n - 1) + pow(y.v / y.n, 2) / (y.n - 1)) AS df FROM m x JOIN m y ON x.l_linestatus = y.l_linestatus AND x.c < y.c)"""


@query(f"{WELCH} SELECT *, {t_tail('t', 'df')} AS p FROM w", "t df p")
def pairwise_t(spark, d):
    return S.pairwise_t(lines(spark, d), "l_quantity", "l_returnflag", ["l_linestatus"])


@query(
    f"{WELCH.replace('l_linestatus', 'l_linenumber')}, p AS (SELECT *, {t_tail('t', 'df')} AS p FROM w), q AS (SELECT *, (SELECT min(y.p * (SELECT count(*) FROM p z WHERE z.l_linenumber = y.l_linenumber) / (SELECT count(*) FROM p z WHERE z.l_linenumber = y.l_linenumber AND z.p <= y.p)) FROM p y WHERE y.l_linenumber = p.l_linenumber AND y.p >= p.p) AS x FROM p), "
    "a AS (SELECT * EXCLUDE (x), least(x, 1) AS p_adj FROM q) SELECT *, CASE WHEN p_adj < 0.001 THEN '***' WHEN p_adj < 0.01 THEN '**' WHEN p_adj < 0.05 THEN '*' ELSE 'ns' END AS stars FROM a",
    "t df p p_adj",
)
def pairwise_t_adjusted(spark, d):
    """Welch tests of the classes at each line number, adjusted within the line number."""
    return S.p_adjust(S.pairwise_t(lines(spark, d), "l_quantity", "l_returnflag", ["l_linenumber"]), "p", ["l_linenumber"])


@query(f"WITH l0 AS (SELECT l_returnflag, variable, value FROM (SELECT l_returnflag, {', '.join(f'{v}::DOUBLE AS {v}' for v in VARS)} FROM lineitem) {CUBE}), md AS (SELECT l_returnflag, variable, median(value) AS m FROM l0 GROUP BY ALL), lg AS (SELECT l_returnflag, variable, abs(value - m) AS value FROM l0 JOIN md USING (l_returnflag, variable)), {ANOVA} SELECT *, {F3} AS p FROM (SELECT variable, k, N, (ssb / (k - 1)) / (ssw / (N - k)) AS F FROM s)", "F p")
def levene(spark, d):
    return S.levene(lines(spark, d), VARS, "l_returnflag")


@query("WITH v AS (SELECT l_linenumber AS b, l_returnflag AS t, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY b ORDER BY v) + (count(*) OVER (PARTITION BY b, v) - 1) / 2 AS r FROM v), s AS (SELECT sum(x * x) AS s FROM (SELECT sum(r) AS x FROM r GROUP BY t)), c AS (SELECT count(DISTINCT t) AS k, count(DISTINCT b) AS b FROM v) SELECT *, exp(-chi2 / 2) AS p FROM (SELECT k, b, 12 * s / (b * k * (k + 1)) - 3 * b * (k + 1) AS chi2 FROM s, c)", "chi2 p")
def friedman(spark, d):
    v = table(spark, d, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.avg("l_quantity").alias("v"))
    return S.friedman(v, "l_linenumber", "l_returnflag", "v")


@query("WITH p AS (SELECT s_suppkey, abs(s_acctbal) / 10000 AS p FROM supplier), a AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, s_suppkey) AS x FROM p), q AS (SELECT s_suppkey, p, least(min(x) OVER (ORDER BY p DESC, s_suppkey DESC ROWS UNBOUNDED PRECEDING), 1) AS p_adj FROM a) SELECT *, CASE WHEN p_adj < 0.001 THEN '***' WHEN p_adj < 0.01 THEN '**' WHEN p_adj < 0.05 THEN '*' ELSE 'ns' END AS stars FROM q", "p p_adj")
def p_adjust(spark, d):
    return S.p_adjust(table(spark, d, "supplier").select("s_suppkey", (F.abs("s_acctbal") / 10000).alias("p")), "p")


@query("WITH q AS (SELECT quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM orders) SELECT o_orderkey, len(list_filter(c, lambda x: x < o_totalprice))::INT + 1 AS bin FROM orders, q")
def pct_rank_bins(spark, d):
    return S.equal_frequency_bins(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "bin")


@query("WITH q AS (SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c FROM lineitem), b AS (SELECT len(list_filter(c, lambda x: x < l_extendedprice)) AS bin, l_returnflag AS cls, count(*)::DOUBLE AS c FROM lineitem, q GROUP BY ALL), m AS (SELECT c, sum(c) OVER () AS t, sum(c) OVER (PARTITION BY bin) AS x, sum(c) OVER (PARTITION BY cls) AS y FROM b) SELECT 'l_extendedprice' AS variable, sum(c / t * ln(c * t / (x * y))) AS mi FROM m", "mi")
def mutual_information(spark, d):
    return S.mutual_information(lines(spark, d), ["l_extendedprice"], "l_returnflag")


ODDS = 0.85 * (1 - 0.7) / (0.7 * (1 - 0.85))
SHIFT = """c AS (SELECT {by}o_orderpriority, count(*)::DOUBLE AS n FROM {rows} WHERE o_orderpriority IS NOT NULL GROUP BY ALL),
  u AS (SELECT *, sum(n) OVER (PARTITION BY {part} ORDER BY o_orderpriority) / sum(n) OVER (PARTITION BY {part}) AS c, sum(n) OVER (PARTITION BY {part}) AS t FROM c),
  e AS (SELECT *, {odds} * c / (1 - c + {odds} * c) AS e FROM u),
  s AS (SELECT {by}o_orderpriority, n::BIGINT AS n, n / t AS p, e - coalesce(lag(e) OVER (PARTITION BY {part} ORDER BY o_orderpriority), 0) AS p_shifted FROM e),
  sh AS (SELECT *, (p + p_shifted) / 2 AS p_mean FROM s)"""
NEED = "ps AS (SELECT {by}{odds}::DOUBLE AS odds, 1 - sum(pow(p_mean, 3)) AS ps FROM sh GROUP BY ALL), nd AS (SELECT *, 3 * pow(1.959963984540054 + 1.2815515655446004, 2) / (0.25 * pow(ln(odds), 2)) / ps AS n_needed FROM ps), pw AS (SELECT *, abs(ln(odds)) * sqrt(pow(round(n_needed), 3) * 0.25 * ps / 3 / pow(round(n_needed) + 1, 2)) - 1.959963984540054 AS a FROM nd)"
POWER = f"CASE WHEN a >= 0 THEN 1 - {normal_tail('a')} / 2 ELSE {normal_tail('a')} / 2 END"
ORDERS = dict(by="", rows="orders", part="1", odds=ODDS)
FOLDED = dict(by="fold, ", rows="(SELECT *, f AS fold FROM orders, range(1, 13) AS r(f) WHERE (o_orderkey % 12) + 1 <> f)", part="fold", odds=ODDS)


@query(f"WITH {SHIFT.format(**ORDERS)} SELECT * FROM sh", "p p_shifted p_mean")
def cumulative_odds_shift(spark, d):
    """Shares of the order priorities before and after their cumulative odds are multiplied."""
    return S.shifted_classes(table(spark, d, "orders"), "o_orderpriority", ODDS)


@query(f"WITH {SHIFT.format(**ORDERS)}, {NEED.format(**ORDERS)} SELECT odds, ps, n_needed, {POWER} AS power FROM pw", "odds ps n_needed power")
def ordinal_power(spark, d):
    return S.ordinal_power(S.shifted_classes(table(spark, d, "orders"), "o_orderpriority", ODDS), ODDS, p="p_mean")


@query(f"WITH {SHIFT.format(**FOLDED)}, {NEED.format(**FOLDED)} SELECT fold, odds, ps, n_needed, {POWER} AS power FROM pw", "odds ps n_needed power")
def ordinal_power_by_fold(spark, d):
    """The same for the analysis set of each of twelve folds: totals less a fold's own, no row is repeated."""
    own = table(spark, d, "orders").select((F.col("o_orderkey") % 12 + 1).cast("long").alias("fold"), "o_orderpriority")
    return S.ordinal_power(S.shifted_classes(own, "o_orderpriority", ODDS, by=["fold"], folds=12), ODDS, by=["fold"], p="p_mean")


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, avg(c_acctbal) AS mean, coalesce(stddev_samp(c_acctbal) / sqrt(count(*)), 0) AS se, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer GROUP BY ALL", "mean se min max")
def cluster_curve_stats(spark, d):
    return S.cluster_curve_stats(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], "c_acctbal")


QUALITY = "q AS (SELECT user_id, event_id, abs(value) AS q FROM events WHERE value IS NOT NULL)"


@query(f"WITH {QUALITY} SELECT *, pow(10, -q / 10) AS error, sum(pow(10, -q / 10)) OVER (PARTITION BY user_id ORDER BY event_id) AS cumulative FROM q", "q error cumulative")
def cumulative_error(spark, d):
    e = table(spark, d, "events").where("value IS NOT NULL").select("user_id", "event_id", F.abs("value").alias("q"))
    return S.cumulative_error(e, ["user_id"], "event_id", "q")


@query("SELECT event_type, avg(value) AS mean, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY 1", "mean p10 q1 median q3 p90")
def quality_profile_summary(spark, d):
    return S.quality_profile(table(spark, d, "events"), ["event_type"], "value")


@query("SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_extendedprice) AS r, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem GROUP BY 1", "r slope intercept")
def entropy_metric_correlation(spark, d):
    return S.metric_correlation(lines(spark, d), ["l_returnflag"], "l_quantity", "l_extendedprice")


@query(f"WITH {CONTIGS}, n AS (SELECT tool, mode, fold, count(*) AS n FROM contigs WHERE hits IS NULL GROUP BY ALL) SELECT mode, tool, avg(n) AS mean, stddev_samp(n) / sqrt(count(*)) AS se FROM n GROUP BY ALL", "mean se")
def agreement_summary(spark, d):
    n = contigs(spark, d).where("hits IS NULL").groupBy("tool", "mode", "fold").agg(F.count(F.lit(1)).alias("n"))
    return S.cluster_curve_stats(n, ["mode", "tool"], "n").select("mode", "tool", "mean", F.col("se"))
