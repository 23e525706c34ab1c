"""Queries: recovery metrics, hits, joins and overlaps of tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.operators import hits as H
from assaylake.operators import joins as J
from assaylake.operators import metrics as M
from assaylake.operators import sets as S

from .book import query
from .views import CONTIGS, HITS, REFS, contigs, hits, refs, table

THRESHOLDS = [0.2, 0.5, 0.8, 0.9, 0.95]
SWEEP = [0.5, 0.6, 0.7, 0.8, 0.85, *[x / 100 for x in range(90, 101)]]
T = "(SELECT unnest([0.2, 0.5, 0.8, 0.9, 0.95])::DOUBLE AS threshold)"
N = "(SELECT count(*) AS n_ref FROM supplier)"
Z = "CASE WHEN {b} <> 0 THEN {a} * 1.0 / {b} END"


def ratio(a: str, b: str) -> str:
    return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"


def n_refs(spark, sf_dir):
    return refs(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_ref"))


COUNTS = f"""SELECT tool, sample_id, threshold, count(*) AS rawcontigs, count(DISTINCT CASE WHEN reference_coverage >= threshold THEN hits END) AS TP,
  count(*) FILTER (reference_coverage > 0 AND reference_coverage < threshold) AS FP, count(*) FILTER (reference_coverage IS NULL OR reference_coverage <= 0) AS TN
  FROM contigs, {T} GROUP BY ALL"""
BEHERA = f"""SELECT *, 2 * "precision" * sensitivity / nullif("precision" + sensitivity, 0) AS F1 FROM (
  SELECT *, {ratio("TP", "TP + FP")} AS "precision", {ratio("TP_refs", "TP_refs + FN")} AS sensitivity FROM (
  SELECT *, FP_partial + FP_nohit AS FP, greatest((SELECT n_ref FROM {N}) - TP_refs, 0) AS FN FROM (
  SELECT tool, sample_id, threshold, count(*) AS raw, count(*) FILTER (reference_coverage >= threshold) AS TP,
  count(*) FILTER (reference_coverage > 0 AND reference_coverage < threshold) AS FP_partial,
  count(*) FILTER (reference_coverage IS NULL OR reference_coverage <= 0) AS FP_nohit,
  count(DISTINCT CASE WHEN reference_coverage >= threshold THEN hits END) AS TP_refs FROM contigs, {T} GROUP BY ALL)))"""


@query(f"WITH {CONTIGS} SELECT *, abs((SELECT n_ref FROM {N}) - TP) AS FN FROM ({COUNTS})")
def coverage_metrics(spark, d):
    return M.coverage_metrics(contigs(spark, d), ["tool", "sample_id"], THRESHOLDS, n_refs(spark, d))


def behera(spark, d):
    return M.coverage_metrics_behera(contigs(spark, d), ["tool", "sample_id"], THRESHOLDS, n_refs(spark, d))


@query(f"WITH {CONTIGS} {BEHERA}", "precision sensitivity F1")
def coverage_metrics_behera(spark, d):
    return behera(spark, d)


@query(
    f"""WITH {CONTIGS}, {REFS}, lab AS (SELECT c.*, family FROM contigs c LEFT JOIN refs ON hits = ref_id), n AS (SELECT family, count(*) AS n_ref FROM refs GROUP BY 1)
  SELECT m.*, greatest(coalesce(n_ref, 0) - TP, 0) AS FN FROM (SELECT family, tool, threshold, count(*) AS rawcontigs,
  count(DISTINCT CASE WHEN reference_coverage >= threshold THEN hits END) AS TP, count(*) FILTER (reference_coverage < threshold OR reference_coverage IS NULL) AS FP
  FROM lab, {T} GROUP BY ALL) m LEFT JOIN n USING (family)"""
)
def coverage_metrics_family(spark, d):
    r = refs(spark, d)
    labelled = J.join_reference_labels(contigs(spark, d), r)
    return M.coverage_metrics_family(labelled, ["tool"], THRESHOLDS, r.groupBy("family").agg(F.count(F.lit(1)).alias("n_ref")))


@query(
    f"""WITH {CONTIGS} SELECT *, {ratio("TP", "FP")} AS Ratio, {ratio("TP", "TP + FN + FP")} AS Accuracy, {ratio("TP", "TP + FP")} AS "Precision",
  {ratio("TP", "TP + FN")} AS Sensitivity, {ratio("2 * TP", "2 * TP + FP + FN")} AS Fscore FROM (SELECT *, abs((SELECT n_ref FROM {N}) - TP) AS FN FROM ({COUNTS}))""",
    'Ratio Accuracy "Precision" Sensitivity Fscore',
)
def derived_scores(spark, d):
    return M.derived_scores(coverage_metrics(spark, d))


@query(
    f"""WITH {CONTIGS} SELECT *, abs((SELECT n_ref FROM {N}) - TP) AS FN FROM (SELECT tool, threshold, count(*) AS rawcontigs, count(DISTINCT CASE WHEN reference_coverage >= threshold THEN hits END) AS TP,
  count(*) FILTER (reference_coverage > 0 AND reference_coverage < threshold) AS FP, count(*) FILTER (reference_coverage IS NULL OR reference_coverage <= 0) AS TN
  FROM contigs, (SELECT unnest({SWEEP})::DOUBLE AS threshold) GROUP BY ALL)"""
)
def threshold_sweep(spark, d):
    return M.coverage_metrics(contigs(spark, d), ["tool"], SWEEP, n_refs(spark, d))


@query(
    f"""WITH {CONTIGS}, more AS (SELECT * FROM contigs UNION ALL SELECT * REPLACE ('A+R' AS tool) FROM contigs WHERE tool IN ('A', 'R'))
  SELECT tool, count(*) AS n_contigs, count(hits) AS n_hits, {ratio("count(hits)", "count(*)")} AS hit_fraction, avg(reference_coverage) AS mean_cov, stddev_samp(reference_coverage) AS sd_cov FROM more GROUP BY 1""",
    "hit_fraction mean_cov sd_cov",
)
def additive_method(spark, d):
    return M.assembly_summary(M.additive_method(contigs(spark, d), ["A", "R"], "A+R"), ["tool"])


LEAK = "leak AS (SELECT 's' || l_linenumber AS sample_id, count(*) AS leak FROM lineitem WHERE l_discount >= 0.08 GROUP BY 1)"
THREE = f"""SELECT *, {ratio("TP", "TP + FP_paralog + FP_spurious")} AS precision_ood, {ratio("TP + FP_paralog", "raw")} AS precision_combined FROM (
  SELECT *, greatest(raw - TP - FP_paralog, 0) AS FP_spurious FROM (SELECT b.*, leak, least(raw - TP, coalesce(leak, 0)) AS FP_paralog FROM ({BEHERA}) b LEFT JOIN leak USING (sample_id)))"""


def leaks(spark, d):
    high = table(spark, d, "lineitem").where("l_discount >= 0.08")
    return high.groupBy(F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("sample_id")).agg(F.count(F.lit(1)).alias("leak"))


@query(f"WITH {CONTIGS}, {LEAK} {THREE}", "precision sensitivity F1 precision_ood precision_combined")
def three_way_classify(spark, d):
    return M.three_way_classify(behera(spark, d), leaks(spark, d), ["sample_id"])


@query(
    f"""WITH {CONTIGS}, {LEAK} SELECT threshold, count(cif) AS n, median(cif) AS median_cif, avg(cif) AS mean_cif, stddev_samp(cif) AS sd_cif, avg(precision_ood) AS mean_ood, avg(precision_combined) AS mean_combined
  FROM (SELECT *, {ratio("precision_combined", "precision_ood")} AS cif FROM ({THREE})) GROUP BY 1""",
    "median_cif mean_cif sd_cif mean_ood mean_combined",
)
def compute_cif(spark, d):
    return M.compute_cif(three_way_classify(spark, d), ["threshold"])


FAMILY = f"""SELECT sample_id, tool, count(*) AS n, avg("precision") AS mean_precision, stddev_samp("precision") AS sd_precision, avg(sensitivity) AS mean_sensitivity, avg(F1) AS mean_f1, stddev_samp(F1) AS sd_f1 FROM ({BEHERA}) GROUP BY ALL"""


@query(f"WITH {CONTIGS} {FAMILY}", "mean_precision sd_precision mean_sensitivity mean_f1 sd_f1")
def per_family_summary(spark, d):
    return M.per_family_summary(behera(spark, d), ["sample_id", "tool"])


@query(f"WITH {CONTIGS} SELECT tool, count(*) AS n_families, avg(mean_precision) AS mean_precision, stddev_samp(mean_precision) AS sd_precision, avg(mean_f1) AS mean_f1 FROM ({FAMILY}) GROUP BY 1", "mean_precision sd_precision mean_f1")
def ood_tool_summary(spark, d):
    return M.ood_tool_summary(per_family_summary(spark, d), ["tool"])


@query(f"WITH {CONTIGS} SELECT tool, sample_id, count(*) AS n_contigs, count(hits) AS n_hits, {ratio('count(hits)', 'count(*)')} AS hit_fraction, avg(reference_coverage) AS mean_cov, stddev_samp(reference_coverage) AS sd_cov FROM contigs GROUP BY ALL", "hit_fraction mean_cov sd_cov")
def assembly_summary(spark, d):
    return M.assembly_summary(contigs(spark, d), ["tool", "sample_id"])


AUDIT = "SELECT qseqid, count(*) AS total_hits, count(*) FILTER (pident >= 90 AND qcovs >= 80) AS high_hits, arg_max(sseqid, (bitscore, sseqid)) AS top_target FROM hits GROUP BY 1"


@query(f"WITH {HITS} {AUDIT}")
def leakage_audit(spark, d):
    return M.leakage_audit(hits(spark, d), ["qseqid"])


@query(f"WITH {HITS} SELECT top_target, count(*) AS n, median(high_hits) AS median_high, avg(high_hits) AS mean_high, max(high_hits) AS max_high, avg((high_hits = 0)::INT) AS share_none FROM ({AUDIT}) GROUP BY 1", "median_high mean_high share_none")
def leakage_stats(spark, d):
    return M.leakage_stats(M.leakage_audit(hits(spark, d), ["qseqid"]), ["top_target"])


RECOVERY = "SELECT tool, split_part(hits, '|', 1) AS test_id, max(reference_coverage) AS best_cov, avg(reference_coverage) AS mean_cov, (max(reference_coverage) >= 0.9)::INT AS recovered FROM contigs WHERE hits IS NOT NULL GROUP BY ALL"


@query(f"WITH {CONTIGS} {RECOVERY}", "best_cov mean_cov")
def recovery_table(spark, d):
    return M.recovery_table(contigs(spark, d), ["tool"])


NRI = "nri AS (SELECT ref_id AS test_id, h.sseqid AS nearest_ref_id, coalesce(h.p, 0.0) AS nri, coalesce(h.l, 0)::BIGINT AS aln_len FROM refs LEFT JOIN (SELECT sseqid AS s0, max(pident) AS p, arg_max(length, (pident, length, qseqid)) AS l, arg_max(qseqid, (pident, length, qseqid)) AS sseqid FROM hits GROUP BY 1) h ON s0 = ref_id)"


def nri(spark, d):
    back = hits(spark, d).select(F.col("sseqid").alias("qseqid"), F.col("qseqid").alias("sseqid"), "pident", "length")
    return H.nearest_reference(back, refs(spark, d).select(F.col("ref_id").alias("test_id")))


@query(f"WITH {HITS}, {REFS}, {NRI} SELECT * FROM nri", "nri")
def nearest_reference(spark, d):
    return nri(spark, d)


@query(f"WITH {CONTIGS}, {HITS}, {REFS}, {NRI} SELECT r.*, nearest_ref_id, nri, aln_len FROM ({RECOVERY}) r JOIN nri USING (test_id)", "best_cov mean_cov nri")
def join_recovery_nri(spark, d):
    return J.join_recovery_nri(recovery_table(spark, d), nri(spark, d))


@query(
    f"""WITH {CONTIGS} SELECT *, sqrt(sensitivity * (1 - sensitivity) / n) AS se FROM (SELECT tool, bin, count(*) AS n, sum(recovered)::BIGINT AS recovered, {ratio("sum(recovered)", "count(*)")} AS sensitivity FROM (
  SELECT *, CASE WHEN mean_cov < 0.45 THEN '[0,0.45)' WHEN mean_cov < 0.5 THEN '[0.45,0.5)' WHEN mean_cov < 0.55 THEN '[0.5,0.55)' WHEN mean_cov <= 1 THEN '[0.55,1]' END AS bin FROM ({RECOVERY})) WHERE bin IS NOT NULL GROUP BY ALL)""",
    "sensitivity se",
)
def binned_recovery(spark, d):
    return M.binned_recovery(M.recovery_table(contigs(spark, d), ["tool"], exact=True), "mean_cov", [0, 0.45, 0.5, 0.55, 1], ["tool"])


@query(f"WITH {CONTIGS} SELECT sample_id, count(*) AS n_sets, avg(n) AS mean_full, stddev_samp(n) AS sd_full FROM (SELECT tool, sample_id, count(*) FILTER (reference_coverage >= 0.95) AS n FROM contigs GROUP BY ALL) GROUP BY 1", "mean_full sd_full")
def full_length_effort(spark, d):
    return M.full_length_effort(contigs(spark, d), "tool", "sample_id")


BAND = "CASE WHEN reference_coverage >= 1 THEN '100%' WHEN reference_coverage >= 0.95 THEN '>=95%' WHEN reference_coverage >= 0.9 THEN '>=90%' WHEN reference_coverage >= 0.8 THEN '>=80%' ELSE '<80%' END"


@query(f"WITH {CONTIGS} SELECT tool, {BAND} AS band, count(*) AS n FROM contigs GROUP BY ALL")
def coverage_band(spark, d):
    return M.band_counts(contigs(spark, d), ["tool"])


@query(f"WITH {CONTIGS} SELECT tool, band, count(*) AS n_folds, avg(s) AS mean_share, stddev_samp(s) / sqrt(count(*)) AS se_share FROM (SELECT tool, fold, band, n / sum(n) OVER (PARTITION BY tool, fold) AS s FROM (SELECT tool, fold, {BAND} AS band, count(*) AS n FROM contigs GROUP BY ALL)) GROUP BY ALL", "mean_share se_share")
def band_share(spark, d):
    return M.band_share(contigs(spark, d), "tool", "fold")


@query(f"WITH {CONTIGS}, {REFS} SELECT fold, family, {BAND} AS band, count(*) AS n FROM contigs LEFT JOIN refs ON hits = ref_id GROUP BY ALL")
def band_by_family(spark, d):
    return M.band_counts(J.join_reference_labels(contigs(spark, d), refs(spark, d)), ["fold", "family"])


@query(f"WITH {CONTIGS} SELECT DISTINCT tool, reference_coverage, count(*) OVER (PARTITION BY tool, reference_coverage) AS n, cume_dist() OVER (PARTITION BY tool ORDER BY reference_coverage) AS ecdf FROM contigs WHERE reference_coverage IS NOT NULL", "reference_coverage ecdf")
def coverage_ecdf(spark, d):
    return M.coverage_ecdf(contigs(spark, d), "tool")


@query(f"WITH {CONTIGS} SELECT tool, sample_id, coalesce(sum(a), 0) AS auc FROM (SELECT tool, sample_id, (sensitivity - lag(sensitivity) OVER w) * (\"precision\" + lag(\"precision\") OVER w) / 2 AS a FROM ({BEHERA}) WHERE sensitivity IS NOT NULL AND \"precision\" IS NOT NULL WINDOW w AS (PARTITION BY tool, sample_id ORDER BY sensitivity, \"precision\")) GROUP BY ALL", "auc")
def running_pr_auc(spark, d):
    return M.running_pr_auc(behera(spark, d), ["tool", "sample_id"])


@query(f"WITH {CONTIGS} SELECT contig_name, tool, threshold FROM contigs, {T}")
def threshold_cross(spark, d):
    return M.threshold_cross(contigs(spark, d).select("contig_name", "tool"), THRESHOLDS)


FILTERED = f"f AS (SELECT *, {ratio('length', 'qlen')} AS cov_query, {ratio('length', 'slen')} AS cov_subject, greatest({ratio('length', 'qlen')}, {ratio('length', 'slen')}) AS max_coverage FROM hits WHERE greatest({ratio('length', 'qlen')}, {ratio('length', 'slen')}) >= 0.5 AND pident >= 80)"
PER = """p AS (SELECT qseqid, count(*) AS n_hits, count(DISTINCT sseqid) AS n_unique_subjects, max(m) AS max_contigs_per_subject, max(bitscore) AS best_bitscore, max(pident) AS best_pident, max(max_coverage) AS best_max_coverage,
  max({'l': length, 's': sseqid, 'n': slen}) AS longest, max({'b': bitscore, 's': sseqid}).s AS best_subject FROM f JOIN (SELECT sseqid, count(DISTINCT qseqid) AS m FROM f GROUP BY 1) USING (sseqid) GROUP BY 1),
  c AS (SELECT *, CASE WHEN n_hits = 1 AND n_unique_subjects = 1 AND max_contigs_per_subject = 1 THEN '1->1' WHEN n_hits > 1 AND max_contigs_per_subject = 1 THEN 'm->1' WHEN n_hits = 1 AND max_contigs_per_subject > 1 THEN '1->n' ELSE 'm->n' END AS prelim_cat FROM p)"""
LABEL = "CASE WHEN prelim_cat = '1->1' OR (prelim_cat = 'm->n' AND n_unique_subjects = 1) THEN CASE WHEN longest.l::DOUBLE / longest.n >= 0.9 THEN 'full' ELSE 'fragment' END WHEN prelim_cat = 'm->1' THEN 'fragment' WHEN prelim_cat = '1->n' THEN 'chimera' ELSE 'multi' END"


def good(spark, d):
    return H.filter_hits(hits(spark, d))


@query(f"WITH {HITS}, {FILTERED} SELECT * FROM f", "pident bitscore qcovs cov_query cov_subject max_coverage")
def filter_hits(spark, d):
    return good(spark, d)


@query(f"WITH {HITS}, {FILTERED}, {PER} SELECT * EXCLUDE (longest, best_subject) FROM c", "best_bitscore best_pident best_max_coverage")
def hit_category(spark, d):
    return H.hit_category(good(spark, d))


@query(f"WITH {HITS}, {FILTERED}, {PER} SELECT * EXCLUDE (longest), {LABEL} AS final_annotation FROM c", "best_bitscore best_pident best_max_coverage")
def annotate_hits(spark, d):
    return H.annotate_hits(good(spark, d))


@query(f"WITH {HITS}, {FILTERED}, {PER}, a AS (SELECT prelim_cat, {LABEL} AS final_annotation FROM c) SELECT prelim_cat, final_annotation, pooled, n, n / sum(n) OVER (PARTITION BY pooled) AS share FROM (SELECT prelim_cat, final_annotation, grouping(prelim_cat)::INT AS pooled, count(*) AS n FROM a GROUP BY GROUPING SETS ((final_annotation), (prelim_cat, final_annotation)))", "share")
def annotation_summary(spark, d):
    return H.annotation_summary(annotate_hits(spark, d))


OVER = "greatest(least(a.send, b.send) - greatest(a.sstart, b.sstart) + 1, 0)::DOUBLE / least(a.length, b.length) > 0.5"


@query(f"WITH {HITS}, o AS (SELECT DISTINCT a.qseqid FROM hits a JOIN hits b ON a.qseqid = b.qseqid AND a.hit_id < b.hit_id AND {OVER}) SELECT DISTINCT qseqid, qseqid IN (SELECT qseqid FROM o) AS overlaps FROM hits")
def hit_overlap_selfjoin(spark, d):
    return H.hit_overlap_selfjoin(hits(spark, d))


@query(f"WITH {HITS}, o AS (SELECT DISTINCT a.sseqid FROM hits a JOIN hits b ON a.sseqid = b.sseqid AND a.qseqid < b.qseqid AND {OVER}) SELECT DISTINCT sseqid, sseqid IN (SELECT sseqid FROM o) AS overlaps FROM hits")
def contig_overlap_selfjoin(spark, d):
    return H.contig_overlap_selfjoin(hits(spark, d))


@query(f"WITH {HITS} SELECT qseqid, length, hit_id FROM (SELECT *, row_number() OVER (PARTITION BY qseqid ORDER BY length DESC, hit_id) AS r FROM hits) WHERE r = 1")
def slice_max_one(spark, d):
    return H.slice_max_one(hits(spark, d).select("qseqid", "length", "hit_id"), "qseqid", "length", "hit_id")


@query(f"WITH {HITS}, g AS (SELECT qseqid, sseqid, max(bitscore) AS bitscore FROM hits GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, sseqid) AS i, row_number() OVER (PARTITION BY sseqid ORDER BY bitscore DESC, qseqid) AS j FROM g) SELECT qseqid, sseqid, bitscore, bitscore AS back_bitscore FROM x WHERE i = 1 AND j = 1", "bitscore back_bitscore")
def reciprocal_best_hits(spark, d):
    h = hits(spark, d)
    return H.reciprocal_best_hits(h, h.select(F.col("sseqid").alias("qseqid"), F.col("qseqid").alias("sseqid"), "bitscore"))


@query(f"WITH {HITS}, b AS (SELECT DISTINCT sseqid, unnest(range(sstart, send + 1)) AS pos, slen FROM hits) SELECT sseqid, count(*) AS covered, max(slen) AS slen, count(*)::DOUBLE / max(slen) AS reference_coverage FROM b GROUP BY 1", "reference_coverage")
def reference_coverage(spark, d):
    return H.reference_coverage(hits(spark, d), ["sseqid"])


def segments(spark, d):
    return H.interval_depth(hits(spark, d), "sseqid", "sstart", "send")


@query(f"WITH {HITS}, e AS (SELECT sseqid, pos, sum(x) AS x FROM (SELECT sseqid, sstart AS pos, 1 AS x FROM hits UNION ALL SELECT sseqid, send + 1, -1 FROM hits) GROUP BY ALL) SELECT sseqid, pos, next_pos, depth FROM (SELECT sseqid, pos, lead(pos) OVER w AS next_pos, (sum(x) OVER w)::BIGINT AS depth FROM e WINDOW w AS (PARTITION BY sseqid ORDER BY pos)) WHERE depth > 0")
def interval_depth(spark, d):
    return segments(spark, d)


@query(f"WITH {HITS}, {REFS}, b AS (SELECT sseqid, unnest(range(sstart, send + 1)) AS pos FROM hits) SELECT ref_id AS sseqid, 150::BIGINT AS slen, count(pos) AS total_depth, count(pos) / 150.0 AS mean_depth, count(DISTINCT pos) AS covered, 150 - count(DISTINCT pos) AS zero_bases, count(DISTINCT pos) / 150.0 AS covered_fraction FROM refs LEFT JOIN b ON sseqid = ref_id GROUP BY 1", "mean_depth covered_fraction")
def depth_stats(spark, d):
    return H.depth_stats(segments(spark, d), refs(spark, d).select(F.col("ref_id").alias("sseqid"), F.lit(150).cast("long").alias("slen")), "sseqid")


@query(f"WITH {HITS}, {REFS}, h AS (SELECT 'ref' || o_custkey % (SELECT count(*) FROM supplier) AS q, sseqid, pident FROM hits JOIN orders ON qseqid = 'q' || o_orderkey) SELECT a.family AS query_family, b.family AS target_family, count(*) AS n, min(pident) AS min, quantile_cont(pident, 0.25) AS q1, median(pident) AS median, quantile_cont(pident, 0.75) AS q3, max(pident) AS max, CASE WHEN a.family = b.family THEN 'Within' ELSE 'Between' END AS pair FROM h JOIN refs a ON q = a.ref_id JOIN refs b ON sseqid = b.ref_id GROUP BY ALL", "min q1 median q3 max")
def pairwise_family_identity(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("qseqid"), "o_custkey")
    n = table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("n"))
    h = hits(spark, d).join(o, "qseqid").crossJoin(F.broadcast(n)).select(F.concat(F.lit("ref"), (F.col("o_custkey") % F.col("n")).cast("string")).alias("qseqid"), "sseqid", "pident")
    return H.pairwise_family_identity(h, refs(spark, d))


@query(f"WITH {CONTIGS}, {REFS} SELECT contigs.*, refs.* FROM contigs LEFT JOIN refs ON hits = ref_id", "length reference_coverage")
def join_reference_labels(spark, d):
    return J.join_reference_labels(contigs(spark, d), refs(spark, d))


@query(f"WITH {CONTIGS}, {LEAK}, meta AS (SELECT 's' || n_nationkey AS sample_id, n_name AS superfamily FROM nation), man AS (SELECT r.n_name AS superfamily, count(*) AS n_test FROM supplier JOIN nation r ON s_nationkey = n_nationkey GROUP BY 1) SELECT superfamily, b.*, n_test FROM ({BEHERA}) b LEFT JOIN meta USING (sample_id) LEFT JOIN man USING (superfamily)", "precision sensitivity F1")
def join_loso_context(spark, d):
    meta = table(spark, d, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("sample_id"), F.col("n_name").alias("superfamily"))
    manifest = refs(spark, d).groupBy(F.col("family").alias("held_out_superfamily")).agg(F.count(F.lit(1)).alias("n_test"))
    return J.join_loso_context(behera(spark, d), meta, manifest)


@query(f"WITH {HITS}, {FILTERED}, {PER}, {CONTIGS} SELECT qseqid, n, prelim_cat FROM (SELECT 'q' || split_part(contig_name, '_', 1) AS qseqid, count(*) AS n FROM contigs GROUP BY 1) LEFT JOIN c USING (qseqid)")
def join_annotations(spark, d):
    c = contigs(spark, d).groupBy(F.concat(F.lit("q"), F.substring_index("contig_name", "_", 1)).alias("qseqid")).agg(F.count(F.lit(1)).alias("n"))
    return J.join_annotations(c, H.hit_category(good(spark, d)).select("qseqid", "prelim_cat"), ["qseqid"])


@query(f"WITH {CONTIGS}, {REFS} SELECT family, count(*) AS n_refs, count(*) FILTER (ref_id NOT IN (SELECT hits FROM contigs WHERE hits IS NOT NULL AND reference_coverage >= 0.98)) AS n_missing FROM refs GROUP BY 1")
def reference_completeness(spark, d):
    return J.reference_completeness(contigs(spark, d).where("reference_coverage >= 0.98"), refs(spark, d), ["family"])


@query(f"WITH {CONTIGS}, {REFS} SELECT *, CASE WHEN ref_id IN (SELECT hits FROM contigs WHERE reference_coverage >= 0.99) THEN '>= 99% alignment' ELSE 'Not Assembled' END AS status FROM refs")
def recovered_vs_missing(spark, d):
    return J.recovered_vs_missing(refs(spark, d), contigs(spark, d), 0.99)


@query(f"WITH {CONTIGS}, {REFS}, p AS (SELECT hits AS ref_id, string_agg(DISTINCT clade, '_') AS predicted FROM contigs JOIN refs ON 'ref' || fold = ref_id GROUP BY 1), e AS (SELECT ref_id, unnest(string_split(predicted, '_')) AS label FROM p) SELECT DISTINCT ref_id, clade, label, CASE WHEN label = clade THEN 'Concordance' WHEN label <> clade THEN 'Ambiguous' END AS concordance FROM refs LEFT JOIN e USING (ref_id)")
def superfamily_concordance(spark, d):
    r = refs(spark, d)
    p = contigs(spark, d).join(r, F.concat(F.lit("ref"), F.col("fold").cast("string")) == F.col("ref_id")).groupBy(F.col("hits").alias("ref_id")).agg(S.joined_set("clade", "_").alias("predicted"))
    return J.superfamily_concordance(p, r.select("ref_id", "clade"), ["ref_id"], actual="clade")


@query(f"WITH {CONTIGS}, tools AS (SELECT DISTINCT tool FROM contigs) SELECT tool, k, p FROM tools, (SELECT unnest([19, 25, 31])::DOUBLE AS k), (SELECT unnest([0.25, 0.5, 1.0])::DOUBLE AS p)")
def prediction_grid(spark, d):
    return J.prediction_grid(contigs(spark, d).select("tool").distinct(), {"k": [19, 25, 31], "p": [0.25, 0.5, 1.0]})


@query(f"WITH {CONTIGS}, {REFS}, a AS (SELECT 'contig' AS k, contig_name, sample_id AS final_annotation FROM contigs WHERE reference_coverage > 0.5), cl AS (SELECT l_orderkey || '_' || l_linenumber AS contig_name, l_linestatus AS region FROM lineitem WHERE l_discount > 0.02) SELECT contig_name, region, tool, ref_id, family, final_annotation FROM cl LEFT JOIN contigs USING (contig_name) LEFT JOIN refs ON hits = ref_id LEFT JOIN a USING (contig_name)")
def integrate_contig_db(spark, d):
    c = contigs(spark, d)
    ann = c.where("reference_coverage > 0.5").select("contig_name", F.col("sample_id").alias("final_annotation"))
    li = table(spark, d, "lineitem").where("l_discount > 0.02").select(F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("contig_name"), F.col("l_linestatus").alias("region"))
    return J.integrate_contig_db(c, refs(spark, d), ann, li).select("contig_name", "region", "tool", "ref_id", "family", "final_annotation")


@query(f"WITH {CONTIGS}, {REFS}, x AS (SELECT DISTINCT hits AS x FROM contigs WHERE reference_coverage >= 0.9), y AS (SELECT DISTINCT ref_id AS y FROM refs) SELECT CASE WHEN y IS NULL THEN 'only_a' WHEN x IS NULL THEN 'only_b' ELSE 'both' END AS side, count(*) AS n FROM x FULL JOIN y ON x = y GROUP BY 1")
def key_set_diff(spark, d):
    return J.key_set_diff(contigs(spark, d).where("reference_coverage >= 0.9").select(F.col("hits").alias("ref_id")), refs(spark, d), "ref_id")


HIT = "h AS (SELECT c.*, family FROM contigs c LEFT JOIN refs ON hits = ref_id WHERE reference_coverage >= 0.98)"
COMBO = "i AS (SELECT hits, string_agg(DISTINCT tool, ',' ORDER BY tool) AS combination, count(DISTINCT tool) AS n_members, min(family) AS family, avg(reference_coverage) AS cov FROM h WHERE hits IS NOT NULL GROUP BY 1)"


def found(spark, d):
    return J.join_reference_labels(contigs(spark, d).where("reference_coverage >= 0.98"), refs(spark, d))


@query(f"WITH {CONTIGS}, {REFS}, {HIT}, {COMBO} SELECT combination, n_members, count(*) AS n, CASE WHEN n_members = 1 THEN 'Unique' ELSE 'Intersect' END AS kind FROM i GROUP BY ALL")
def set_combinations(spark, d):
    return S.set_combinations(found(spark, d), "hits", "tool")


@query(f"WITH {CONTIGS}, {REFS}, {HIT}, {COMBO}, n AS (SELECT combination, family, count(*) AS n FROM i GROUP BY ALL) SELECT combination, family, coalesce(n, 0) AS n FROM (SELECT DISTINCT combination FROM n) CROSS JOIN (SELECT DISTINCT family FROM n) LEFT JOIN n USING (combination, family)")
def combination_by_label(spark, d):
    return S.combination_by_label(found(spark, d), "hits", "tool", "family")


@query(f"WITH {CONTIGS}, {REFS}, {HIT}, {COMBO} SELECT combination, count(*) AS n, avg(cov) AS mean_cov, stddev_samp(cov) AS sd_cov FROM i GROUP BY 1", "mean_cov sd_cov")
def combination_coverage(spark, d):
    return S.combination_coverage(found(spark, d), "hits", "tool", "reference_coverage")


@query(f"WITH {CONTIGS}, {REFS}, {HIT}, {COMBO}, m AS (SELECT hits, tool, avg(reference_coverage) AS c FROM h GROUP BY ALL) SELECT combination, tool, count(*) AS n, avg(c) AS mean_cov, stddev_samp(c) / count(*) AS se_cov FROM m JOIN i USING (hits) GROUP BY ALL", "mean_cov se_cov")
def combination_member_coverage(spark, d):
    return S.combination_member_coverage(found(spark, d), "hits", "tool", "reference_coverage")


@query(f"WITH {CONTIGS}, {REFS}, {HIT} SELECT family, n_members, count(*) AS n FROM (SELECT hits, family, count(DISTINCT tool) AS n_members FROM h WHERE hits IS NOT NULL GROUP BY ALL) GROUP BY ALL")
def recovery_breadth(spark, d):
    return S.recovery_breadth(found(spark, d), "hits", "tool", "family")


@query(f"WITH {CONTIGS}, {REFS}, {HIT} SELECT region, count(*) AS n FROM (SELECT hits, bit_or(CASE tool WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 4 ELSE 0 END) AS region FROM h WHERE hits IS NOT NULL GROUP BY 1) GROUP BY 1")
def venn_regions(spark, d):
    return S.venn_regions(found(spark, d), "hits", "tool", ["A", "N", "R"])


@query(f"WITH {CONTIGS} SELECT tool, count(hits) AS n_hit, count(*) - count(hits) AS n_no_hit, count(DISTINCT hits) AS n_refs FROM contigs GROUP BY 1")
def hit_rate_by_tool(spark, d):
    return S.hit_rate_by_tool(contigs(spark, d), "tool", "hits")


@query(f"WITH {CONTIGS} SELECT hits, string_agg(DISTINCT sample_id, '_' ORDER BY sample_id) AS samples FROM contigs GROUP BY 1")
def paste_unique(spark, d):
    return contigs(spark, d).groupBy("hits").agg(S.joined_set("sample_id", "_").alias("samples"))


@query(f"WITH {CONTIGS} SELECT tool, mode, sum(CASE WHEN fold = 1 THEN n ELSE 0 END)::BIGINT AS \"1\", sum(CASE WHEN fold = 2 THEN n ELSE 0 END)::BIGINT AS \"2\" FROM (SELECT tool, mode, fold, count(*) AS n FROM contigs GROUP BY ALL) GROUP BY ALL")
def pivot_wide(spark, d):
    return S.pivot_wide(contigs(spark, d).withColumn("fold", F.col("fold").cast("string")), ["tool", "mode"], "fold", ["1", "2"], F.count(F.lit(1)))


@query(f"WITH {CONTIGS} SELECT tool, sample_id, threshold, metric, value::DOUBLE AS value FROM (SELECT tool, sample_id, threshold, TP::DOUBLE AS TP, FP::DOUBLE AS FP, TN::DOUBLE AS TN FROM ({COUNTS})) UNPIVOT (value FOR metric IN (TP, FP, TN))")
def unpivot_metrics(spark, d):
    return S.unpivot_metrics(coverage_metrics(spark, d), ["tool", "sample_id", "threshold"], ["TP", "FP", "TN"])


@query(f"WITH {CONTIGS} SELECT tool, mode, fold, coalesce(n, 0) AS n FROM (SELECT DISTINCT tool FROM contigs) CROSS JOIN (SELECT DISTINCT mode FROM contigs) CROSS JOIN (SELECT DISTINCT fold FROM contigs) LEFT JOIN (SELECT tool, mode, fold, count(*) AS n FROM contigs GROUP BY ALL) USING (tool, mode, fold)")
def complete_grid(spark, d):
    counts = contigs(spark, d).groupBy("tool", "mode", "fold").agg(F.count(F.lit(1)).alias("n"))
    return J.complete_grid(counts, ["tool", "mode", "fold"], "n")


@query(f"WITH {CONTIGS} SELECT tool, sample_id, count(*) AS n FROM contigs GROUP BY ALL")
def count_sorted(spark, d):
    return S.count_sorted(contigs(spark, d), ["tool", "sample_id"])


@query(f"WITH {HITS} SELECT hit_id, bitscore FROM hits ORDER BY bitscore DESC, hit_id LIMIT 50", "bitscore")
def top_features(spark, d):
    return S.top_features(hits(spark, d).select("hit_id", "bitscore"), "bitscore", "hit_id", 50)


@query(f"WITH {CONTIGS} SELECT sample_id, stat, row_number() OVER (ORDER BY stat DESC, sample_id)::INT AS ord FROM (SELECT sample_id, count(hits) AS stat FROM contigs GROUP BY 1)")
def order_levels_by_stat(spark, d):
    return S.order_levels_by_stat(contigs(spark, d), "sample_id", F.count("hits"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, l_orderkey * 10 + l_linenumber AS k FROM lineitem) ORDER BY md5('1-' || k), k LIMIT 1000")
def cap_sample(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return S.cap_sample(li, "k", 1000).drop("k")


@query(f"WITH {CONTIGS} SELECT tool, sample_id, n, n / sum(n) OVER (PARTITION BY tool) AS share FROM (SELECT tool, sample_id, count(*) AS n FROM contigs GROUP BY ALL)", "share")
def share_within(spark, d):
    return S.share_within(contigs(spark, d).groupBy("tool", "sample_id").agg(F.count(F.lit(1)).alias("n")), ["tool"])


@query(f"WITH {HITS}, {REFS} SELECT a.family AS a, b.family AS b, count(*) AS n FROM refs a JOIN refs b ON a.clade = b.clade AND a.family <= b.family GROUP BY ALL")
def lower_triangle(spark, d):
    r = refs(spark, d).groupBy("family", "clade").agg(F.count(F.lit(1)).alias("k"))
    pairs = r.select(F.col("family").alias("a"), "clade", F.col("k").alias("x")).join(r.select(F.col("family").alias("b"), "clade", F.col("k").alias("y")), "clade").select("a", "b", (F.col("x") * F.col("y")).alias("n"))
    return S.lower_triangle(pairs, "a", "b")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_projection(spark, d):
    return S.distinct_projection(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT c_name AS name, c_nationkey AS nation, NULL::DOUBLE AS size, 'c' AS kind FROM customer UNION ALL SELECT s_name, s_nationkey, s_acctbal, 's' FROM supplier", "size")
def union_rows(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit("c").alias("kind"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit("s").alias("kind"), F.col("s_acctbal").alias("size"))
    return S.union_rows([c, s])
