"""Queries: models, seeds and the annotation rules on pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import expressions as X
from assaylake.functions.expressions import coverage_band
from assaylake.operators import alignment as A
from assaylake.operators import chaining as G
from assaylake.operators import folds as D
from assaylake.operators import identity as I
from assaylake.operators import kmers as K
from assaylake.operators import metrics as E
from assaylake.operators import models as M
from assaylake.operators import replicates as R
from assaylake.operators import sets as S
from assaylake.operators import similar as N
from assaylake.operators.graph import materialise
from assaylake.operators.stats import cluster_curve_stats

from .book import query
from .recovery import FILTERED, OVER, depth_stats, good
from .sequences import KM, REPLICATES, U, pc
from .sequences import counts as sequence_counts
from .views import HITS, REFS, SEQS, refs, table

VARS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark, d):
    return table(spark, d, "lineitem").withColumn("key", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))


@query()
def logistic_by_group(spark, d):
    li = lines(spark, d).withColumn("y", (F.col("l_quantity") + F.col("l_discount") * 200 > 35).cast("int"))
    return M.logistic_by_group(li, "l_returnflag", "l_quantity", "y")


@query()
def multinomial_model(spark, d):
    return M.multinomial_model(lines(spark, d), VARS, "l_returnflag")


@query()
def random_forest_importance(spark, d):
    return M.random_forest_importance(lines(spark, d), "key", VARS, "l_returnflag", trees=100)


@query()
def boosted_importance(spark, d):
    return M.boosted_importance(lines(spark, d), VARS, "l_returnflag")


@query()
def partial_dependence(spark, d):
    return M.partial_dependence(lines(spark, d), VARS, "l_returnflag", "l_quantity", [1, 25, 50], trees=100)


@query()
def pca_features(spark, d):
    return M.pca_features(lines(spark, d), VARS)


@query()
def binomial_glm_effects(spark, d):
    cells = lines(spark, d).groupBy("l_linenumber", F.floor("l_quantity").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    return M.binomial_glm_effects(cells, ["l_linenumber", "q"], "k", "n")


@query(
    """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: w <> '') AS w FROM documents), b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: w <> '') AS w FROM benchmark),
  q AS (SELECT doc_id AS qseqid, i AS qp, len(w) AS qlen, array_to_string(w[i:i + 7], ' ') AS seed FROM d, range(1, len(w) - 6) AS r(i)), s AS (SELECT item_id AS sseqid, i AS sp, len(w) AS slen, array_to_string(w[i:i + 7], ' ') AS seed FROM b, range(1, len(w) - 6) AS r(i)),
  m AS (SELECT *, qp - sp AS diag FROM q JOIN s USING (seed)), n AS (SELECT *, CASE WHEN qp - lag(qp) OVER (PARTITION BY qseqid, sseqid, diag ORDER BY qp) <= 8 THEN 0 ELSE 1 END AS new FROM m), g AS (SELECT *, sum(new) OVER (PARTITION BY qseqid, sseqid, diag ORDER BY qp) AS g FROM n)
  SELECT qseqid, sseqid, min(qp)::INT AS qstart, (max(qp) + 7)::INT AS qend, min(sp)::INT AS sstart, (max(sp) + 7)::INT AS send, max(qlen)::INT AS qlen, max(slen)::INT AS slen, (max(qp) + 8 - min(qp))::INT AS length, (max(qp) + 8 - min(qp)) * 2.0 AS bitscore FROM g GROUP BY qseqid, sseqid, diag, g""",
    "bitscore",
)
def hits_from_seeds(spark, d):
    return A.hits_from_seeds(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", "text", "text")


RUNS = """d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: w <> '') AS w FROM documents), b0 AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: w <> '') AS w FROM benchmark),
  b AS (SELECT item_id, false AS back, w FROM b0 UNION ALL SELECT item_id, true, list_reverse(w) FROM b0),
  q AS (SELECT doc_id AS qseqid, i AS qp, len(w) AS qlen, array_to_string(w[i:i + 3], ' ') AS seed FROM d, range(1, len(w) - 2) AS r(i)), s AS (SELECT item_id AS sseqid, back, i AS sp, len(w) AS slen, array_to_string(w[i:i + 3], ' ') AS seed FROM b, range(1, len(w) - 2) AS r(i)),
  m AS (SELECT *, qp - sp AS diag FROM q JOIN s USING (seed)), n AS (SELECT *, CASE WHEN qp - lag(qp) OVER v = 1 THEN 0 ELSE 1 END AS new FROM m WINDOW v AS (PARTITION BY qseqid, sseqid, back, diag ORDER BY qp)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY qseqid, sseqid, back, diag ORDER BY qp) AS g FROM n)"""


def anchors(spark, d):
    return A.maximal_matches(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", "text", "text", n=4, both_ways=True)


@query(f"WITH {RUNS} SELECT qseqid, sseqid, back, min(qp)::INT AS qstart, (max(qp) + 3)::INT AS qend, min(sp)::INT AS sstart, (max(sp) + 3)::INT AS send, max(qlen)::INT AS qlen, max(slen)::INT AS slen FROM g GROUP BY qseqid, sseqid, back, diag, g")
def hit_anchors(spark, d):
    """Maximal shared runs of four words or more, items read forwards and from their end."""
    return anchors(spark, d)


@query()
def chained_hits(spark, d):
    """Hits of documents on benchmark items with mismatches, gaps and reversals: collinear chains of shared runs."""
    return G.chained_hits(anchors(spark, d))


V1 = "v AS (SELECT qseqid, count(*) AS n_hits, count(DISTINCT sseqid) AS n_unique_subjects, max(m) AS max_contigs_per_subject, max(bitscore) AS best_bitscore, max(pident) AS best_pident, max(max_coverage) AS best_max_coverage, max({'l': length, 's': sseqid, 'n': slen}) AS longest FROM f JOIN (SELECT sseqid, {m} AS m FROM f GROUP BY 1) USING (sseqid) GROUP BY 1)"
WHOLE = "CASE WHEN longest.l::DOUBLE / longest.n >= 0.9 THEN 'full' ELSE 'fragment' END"
CAT = "CASE WHEN n_hits = 1 AND n_unique_subjects = 1 AND max_contigs_per_subject = 1 THEN '1->1' WHEN n_hits > 1 AND max_contigs_per_subject = 1 THEN 'm->1' WHEN n_hits = 1 AND max_contigs_per_subject > 1 THEN '1->n' ELSE 'm->n' END"


@query(f"WITH {HITS}, {FILTERED}, {V1.replace('{m}', 'count(*)')}, c AS (SELECT *, {CAT} AS prelim_cat FROM v) SELECT * EXCLUDE (longest), CASE WHEN prelim_cat = '1->1' THEN {WHOLE} WHEN prelim_cat = 'm->1' THEN 'fragment' WHEN prelim_cat = '1->n' THEN 'chimera' WHEN n_hits > 1 THEN 'multi' ELSE {WHOLE} END AS final_annotation FROM c", "best_bitscore best_pident best_max_coverage")
def annotate_hits_v1(spark, d):
    return A.annotate_hits_v1(good(spark, d))


@query(
    f"""WITH {HITS}, {FILTERED}, {V1.replace('{m}', 'count(DISTINCT qseqid)')}, so AS (SELECT DISTINCT a.sseqid FROM f a JOIN f b ON a.sseqid = b.sseqid AND a.qseqid < b.qseqid AND {OVER}),
  qo AS (SELECT DISTINCT a.qseqid FROM f a JOIN f b ON a.qseqid = b.qseqid AND a.hit_id < b.hit_id AND {OVER}), x AS (SELECT *, qseqid IN (SELECT qseqid FROM f WHERE sseqid IN (SELECT sseqid FROM so)) AS subject_overlap, qseqid IN (SELECT qseqid FROM qo) AS query_overlap FROM v)
  SELECT * EXCLUDE (longest), CASE WHEN n_unique_subjects = 1 AND max_contigs_per_subject <= 1 THEN {WHOLE} WHEN n_unique_subjects = 1 THEN CASE WHEN subject_overlap THEN 'allele' ELSE 'fragment' END WHEN query_overlap THEN 'multi' ELSE 'chimera' END AS final_annotation FROM x""",
    "best_bitscore best_pident best_max_coverage",
)
def annotate_hits_cahais(spark, d):
    return A.annotate_hits_cahais(good(spark, d))


@query("""WITH l AS (SELECT c_custkey, region, call FROM (SELECT c_custkey, unnest([{'region': 'Signal', 'call': c_mktsegment}, {'region': 'Pro', 'call': CASE WHEN c_acctbal < 0 THEN '-' ELSE c_mktsegment END}, {'region': 'Mature', 'call': CASE WHEN c_nationkey > 12 THEN 'X' ELSE '-' END}], recursive := true) FROM customer) WHERE call <> '-'),
  g AS (SELECT c_custkey, string_agg(DISTINCT region, '_' ORDER BY region) AS regions, string_agg(DISTINCT call, '_' ORDER BY call) AS calls, count(*) AS score, count(DISTINCT call) > 1 AS conflict FROM l GROUP BY 1) SELECT *, CASE WHEN regions = 'Mature_Pro_Signal' THEN 'complete' ELSE 'incomplete' END AS precursor FROM g""")
def classifier_consensus(spark, d):
    c = table(spark, d, "customer")
    calls = c.select("c_custkey", "c_mktsegment", F.col("c_mktsegment").alias("Signal"), F.when(F.col("c_acctbal") < 0, "-").otherwise(F.concat("c_mktsegment", F.lit(" (note)"))).alias("Pro"), F.when(F.col("c_nationkey") > 12, "X").otherwise("-").alias("Mature"))
    return S.region_class(S.classifier_consensus(calls, "c_custkey", ["Signal", "Pro", "Mature"], "c_mktsegment"))


SETS = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}]+'), lambda w: w <> '') AS w FROM documents), k AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS items FROM w),
  st AS (SELECT min(doc_id) AS rep, items, len(items) AS size FROM k GROUP BY items), e AS (SELECT rep, size, unnest(items) AS item FROM st),
  c AS (SELECT a.rep AS u, b.rep AS v, count(*)::DOUBLE AS n, any_value(a.size) AS su, any_value(b.size) AS sv FROM e a JOIN e b ON a.item = b.item AND a.rep < b.rep GROUP BY ALL)"""


@query(f"WITH {SETS} SELECT u, v, n / (su + sv - n) AS similarity FROM c WHERE n / (su + sv - n) >= 0.8 - 1e-9", "similarity")
def all_pairs_identity(spark, d):
    return N.similar_pairs(materialise(N.shingle_sets(table(spark, d, "documents"), "doc_id", "text"), "shingle-sets"), 0.8)


@query()
def near_dup_clusters(spark, d):
    return N.near_dup_clusters(table(spark, d, "documents"), "doc_id", "text")


@query()
def cluster_diversity_curve(spark, d):
    c = N.near_dup_clusters(table(spark, d, "documents"), "doc_id", "text", (1.0, 0.9, 0.8))
    return c.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("rows").alias("n_rows"))


@query()
def near_dup_collapse(spark, d):
    c = N.near_dup_clusters(table(spark, d, "documents"), "doc_id", "text", (0.9,))
    return c.select(F.col("rep").alias("doc_id"), "rows")


URLS = "u AS (SELECT url, min(page_id) AS rep, length(url) AS n FROM pages WHERE url <> '' GROUP BY url), p AS (SELECT a.rep AS a, b.rep AS b, levenshtein(a.url, b.url) AS distance, greatest(a.n, b.n) AS longer, least(a.n, b.n) AS shorter FROM u a JOIN u b ON a.rep < b.rep)"


@query(f"WITH {URLS} SELECT a, b, distance::BIGINT AS distance, 1 - distance / longer AS identity FROM p WHERE shorter >= 0.8 * longer - 1e-9 AND distance <= floor(0.4 * longer + 1e-9)", "identity")
def identity_pairs(spark, d):
    """Addresses of pages at 60 % identity and 80 % coverage."""
    urls = table(spark, d, "pages").where("url <> ''").groupBy(F.col("url").alias("seq")).agg(F.min("page_id").alias("rep"))
    return I.identity_pairs(urls, 0.6).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "distance", "identity")


#: Identity levels at which sequences are clustered.
LEVELS = [1.0, 0.99, 0.98, 0.97, 0.96, 0.95, 0.94, 0.93, 0.92, 0.91, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4]


@query()
def identity_clusters(spark, d):
    """Turns of conversations, clustered by edit distance at each identity level and 80 % coverage."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    return I.identity_clusters(turns, "turn_id", "text", LEVELS)


@query()
def identity_cluster_curve(spark, d):
    """Clusters and sequences at each identity level, addresses of pages."""
    c = I.identity_clusters(table(spark, d, "pages"), "page_id", "url", LEVELS)
    return c.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("members").alias("n_sequences"), F.sum("rows").alias("n_rows"))


@query()
def stratified_bootstrap(spark, d):
    """By source and replicate, of 10,000: rows drawn, and how often in all."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return R.replicate_counts(docs, "source", "doc_id", REPLICATES)


@query(f"WITH {SEQS}, {KM}, t AS (SELECT DISTINCT kmer FROM km), g AS (SELECT organism, kmer, coalesce(n, 0) AS n FROM (SELECT DISTINCT organism FROM km) CROSS JOIN t LEFT JOIN km USING (organism, kmer)), r AS (SELECT organism, kmer, rank() OVER (PARTITION BY organism ORDER BY n) + (count(*) OVER (PARTITION BY organism, n) - 1) / 2 AS r FROM g) SELECT a.organism AS a, b.organism AS b, corr(a.r, b.r) AS rho FROM r a JOIN r b ON a.kmer = b.kmer AND a.organism < b.organism GROUP BY ALL", "rho")
def kmer_sample_correlation(spark, d):
    return K.sample_correlation(sequence_counts(spark, d), "organism")


@query()
def motif_scan(spark, d):
    """Where each document best fits the position matrix of each language's first eight letters, if at 80 % of the best score or above."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("family"), K.as_sequence(F.col("text")).alias("sequence"))
    heads = docs.where(F.length("sequence") >= 8).select("family", F.substring("sequence", 1, 8).alias("head"))
    return K.motif_scan(docs, "doc_id", "sequence", K.pspm(heads, "head", ["family"]), "family", alphabet=36)


FOLDS = """t AS (SELECT kmer, sum(n) AS t FROM km GROUP BY 1), g AS (SELECT o.organism, t.kmer, coalesce(n, 0) AS a, t - coalesce(n, 0) AS b FROM (SELECT DISTINCT organism FROM km) o CROSS JOIN t LEFT JOIN km ON km.organism = o.organism AND km.kmer = t.kmer),
 pq AS (SELECT *, a / sum(a) OVER w AS p, b / sum(b) OVER w AS q FROM g WINDOW w AS (PARTITION BY organism)),
 fe AS (SELECT organism, 5 AS k, -sum(CASE WHEN p > 0 THEN p * ln(p) END) AS shannon, -log2(sum(p * p)) AS renyi2, count(*) FILTER (a > 0) AS richness, sum(a) AS total,
  -sum(CASE WHEN q > 0 THEN q * ln(q) END) AS train_shannon, -log2(sum(q * q)) AS train_renyi2, count(*) FILTER (b > 0) AS train_richness,
  sqrt(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2) AS jsd FROM pq GROUP BY 1),
 ft AS (SELECT organism, k, shannon, shannon / ln(2) AS shannon_bits, shannon / ln(2) / (k * 6) AS normalised, shannon / ln(2) / (k * 6) + (richness - 1) / (2 * ln(2) * total) AS adjusted, renyi2, richness,
  train_shannon, train_shannon / ln(2) AS train_shannon_bits, train_shannon / ln(2) / (k * 6) AS train_normalised, train_renyi2, train_richness, jsd, CASE WHEN jsd > 0.15 THEN 'HIGH' WHEN jsd > 0.1 THEN 'MOD' ELSE 'LOW' END AS flag FROM fe)"""


@query(f"WITH {SEQS}, {KM}, {FOLDS} SELECT * FROM ft", "shannon shannon_bits normalised adjusted renyi2 train_shannon train_shannon_bits train_normalised train_renyi2 jsd")
def fold_entropy_table(spark, d):
    """By held-out label: diversity of its sequences and of all others, and the divergence of the two."""
    return K.held_out_entropy(materialise(sequence_counts(spark, d), "kmer-counts"), "organism", 64)


@query(f"WITH {SEQS}, {KM}, {FOLDS} SELECT k, count(*) AS n, median(shannon_bits) AS median_bits, stddev_samp(shannon_bits) AS sd_bits, median(jsd) AS median_jsd, count(*) FILTER (flag = 'HIGH') AS n_high, avg((flag = 'HIGH')::INT) AS share_high FROM ft GROUP BY 1", "median_bits sd_bits median_jsd share_high")
def family_entropy_summary(spark, d):
    t = fold_entropy_table(spark, d)
    return t.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.median("shannon_bits").alias("median_bits"), F.stddev_samp("shannon_bits").alias("sd_bits"), F.median("jsd").alias("median_jsd"), F.count_if(F.col("flag") == "HIGH").alias("n_high"), F.avg((F.col("flag") == "HIGH").cast("int")).alias("share_high"))


DEPTH = "b AS (SELECT sseqid, unnest(range(sstart, send + 1)) AS pos FROM hits), dp AS (SELECT ref_id, family, count(DISTINCT pos) / 150.0 AS f FROM refs LEFT JOIN b ON sseqid = ref_id GROUP BY ALL)"


@query(f"WITH {HITS}, {REFS}, {DEPTH} SELECT family, count(*) AS n, avg(f) AS mean, coalesce(stddev_samp(f) / sqrt(count(*)), 0) AS se FROM dp GROUP BY 1", "mean se")
def family_depth_coverage(spark, d):
    labelled = depth_stats(spark, d).join(refs(spark, d), F.col("sseqid") == F.col("ref_id"))
    return cluster_curve_stats(labelled, ["family"], "covered_fraction").select("family", "n", "mean", "se")


BANDED = "CASE WHEN strlen(text) >= 5000 THEN '100%' WHEN strlen(text) >= 4750 THEN '>=95%' WHEN strlen(text) >= 4500 THEN '>=90%' WHEN strlen(text) >= 4000 THEN '>=80%' ELSE '<80%' END"


@query(
    f"""WITH seqs AS (SELECT doc_id AS entry_id, text AS sequence, {BANDED} AS band FROM documents), {pc(5)}, x AS (SELECT band, sequence FROM pc UNION ALL SELECT '<95%', sequence FROM pc WHERE band IN ('>=90%', '>=80%', '<80%')),
  f AS (SELECT band, substr(sequence, i, 5) AS kmer, count(*) AS n FROM x, range(1, length(sequence) - 3) AS r(i) GROUP BY ALL) SELECT band, 5 AS k, -sum(p * ln(p)) AS shannon, count(*) AS richness, -sum(p * ln(p)) / ln(count(*)) AS evenness FROM (SELECT *, n / sum(n) OVER (PARTITION BY band) AS p FROM f) GROUP BY 1""",
    "shannon evenness",
)
def kmer_assessment_by_band(spark, d):
    """Sequences by band of their length over 5,000 bytes, and all below 95 % once more together: labels are exploded, not rows unioned."""
    band = coverage_band(F.octet_length("text") / 5000)
    labels = F.when(band.isin(">=90%", ">=80%", "<80%"), F.array(band, F.lit("<95%"))).otherwise(F.array(band))
    docs = table(spark, d, "documents").select(F.col("text").alias("sequence"), F.explode(labels).alias("band"))
    return K.kmer_assessment(docs, ["band"], "sequence", [5])


@query()
def kmer_pca(spark, d):
    """Components of the sources' profiles of all 3-mers, not centred."""
    return K.kmer_pca(K.kmer_counts(table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "text"), ["source"], "text", [3]), "source")


@query()
def pca_scores(spark, d):
    return M.pca_scores(lines(spark, d), ["l_orderkey", "l_linenumber"], VARS)


GC = "gcd AS (SELECT l_returnflag AS tool, l_linenumber AS fold, l_extendedprice AS length, l_discount AS prop_gc, CASE WHEN l_tax <> 0 THEN l_quantity / 50 END AS cov, CASE WHEN l_tax <> 0 THEN 'ref' || l_suppkey END AS hits FROM lineitem)"
NX = "run AS (SELECT tool, fold, length, sum(length) OVER (PARTITION BY tool, fold ORDER BY length DESC) AS s, sum(length) OVER (PARTITION BY tool, fold) AS a FROM gcd), nx AS (SELECT tool, fold, " + ", ".join(f"max(length) FILTER (s >= a * {x} / 100) AS n{x}" for x in (10, 30, 50, 70, 90)) + " FROM run GROUP BY ALL)"
BEST = "best AS (SELECT tool, fold, hits, coalesce(max(cov), 0) AS b FROM gcd WHERE hits IS NOT NULL GROUP BY ALL), cv AS (SELECT tool, fold, count(*) AS n_refs_with_hit, " + ", ".join(f"count(*) FILTER (b >= 0.{x}) AS cov{x}, count(*) FILTER (b >= 0.{x}) / 1000 AS p_cov{x}" for x in (25, 50, 75, 85, 95)) + " FROM best GROUP BY ALL)"


@query(
    f"""WITH {GC}, {NX}, {BEST}, sz AS (SELECT tool, fold, count(*) AS n_seqs, min(length) AS smallest, max(length) AS largest, sum(length) AS n_bases, avg(length) AS mean_len, count(*) FILTER (length < 200) AS n_under_200, count(*) FILTER (length > 1000) AS n_over_1k,
  count(*) FILTER (length > 10000) AS n_over_10k, sum(prop_gc * length) / sum(length) AS gc, count(hits) AS n_with_hit, count(hits) / count(*) AS p_with_hit FROM gcd GROUP BY ALL)
  SELECT * FROM sz JOIN nx USING (tool, fold) JOIN cv USING (tool, fold)""",
    "smallest largest n_bases mean_len gc p_with_hit n10 n30 n50 n70 n90 p_cov25 p_cov50 p_cov75 p_cov85 p_cov95",
)
def assembly_stats(spark, d):
    """One row for each tool and fold; discounts stand for GC shares."""
    hit = F.col("l_tax") != 0
    c = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("tool"), F.col("l_linenumber").alias("fold"), F.col("l_extendedprice").alias("length"), F.col("l_discount").alias("prop_gc"),
        F.when(hit, F.col("l_quantity") / 50).alias("reference_coverage"), F.when(hit, F.concat(F.lit("ref"), F.col("l_suppkey").cast("string"))).alias("hits"),
    )
    return E.assembly_stats(c, ["tool", "fold"], 1000)


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {U.format(k='l_orderkey')} < 0.3")
def sample_frac(spark, d):
    return D.sample_frac(lines(spark, d), "l_orderkey", 0.3).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, 3 * l_discount / (1 - l_discount + 3 * l_discount) AS shifted FROM lineitem", "shifted")
def odds_shift(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", X.odds_shift(F.lit(3.0), F.col("l_discount")).alias("shifted"))
