"""Queries: curation, dedup, folds, k-mers and diversity."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import expressions as X
from assaylake.operators import curate as C
from assaylake.operators import folds as D
from assaylake.operators import kmers as K
from assaylake.operators import replicates as R
from assaylake.operators import sets as S
from assaylake.operators.graph import materialise

from .book import query
from .statistics import chi2_tail
from .views import CONTIGS, HITS, SEQS, contigs, hits, seqs, table

STEPS = {"not_excluded": "name NOT LIKE '%1%'", "has_protein": "protein IS NOT NULL AND starts_with(protein, 'P')", "clear": "NOT contains(sequence, 'N')", "long_enough": "length(sequence) >= 6"}
PARTS = "parts AS (SELECT p_partkey, p_name AS name, p_type AS protein, p_brand AS sequence, p_size FROM part)"


def parts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("protein"), F.col("p_brand").alias("sequence"), "p_size")


def steps():
    return C.curation_steps(min_length=6, exclude="1", start="^P")


@query(f"WITH {PARTS} SELECT * FROM parts WHERE {' AND '.join(STEPS.values())}")
def curate_filter(spark, d):
    return C.curate_filter(parts(spark, d), steps())


@query(f"WITH {PARTS} SELECT * FROM parts WHERE {' AND '.join(STEPS.values())} AND p_size <> 1")
def curate_protein_filter(spark, d):
    return C.curate_filter(parts(spark, d), steps() | {"classified": F.col("p_size") != 1})


def _funnel() -> str:
    out, passed = [], []
    for i, (name, cond) in enumerate([("all", "true"), *STEPS.items()]):
        passed.append(cond)
        out.append(f"SELECT {i} AS step, '{name}' AS name, count(*) AS n FROM parts WHERE {' AND '.join(f'({c})' for c in passed)}")
    return f"WITH {PARTS} " + " UNION ALL ".join(out)


@query(_funnel())
def curation_funnel(spark, d):
    return C.curation_funnel(parts(spark, d), steps())


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'U' WHEN '5-LOW' THEN 'L' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders")
def recode_by_key(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return C.recode_by_key(o, "o_orderstatus", "o_orderpriority", {"1-URGENT": "U", "5-LOW": "L"})


@query("SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 'Building' WHEN 'MACHINERY' THEN 'Machines' ELSE c_mktsegment END AS level, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 END AS level_ord FROM customer")
def recode_levels(spark, d):
    return C.recode_levels(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", {"BUILDING": "Building", "MACHINERY": "Machines"})


@query("SELECT p_partkey, CASE WHEN t = '' THEN 'UNCLASSIFIED' WHEN starts_with(t, 'Divergent') THEN 'Divergent' ELSE regexp_replace(t, '\\s+', '_', 'g') END AS p_type FROM (SELECT p_partkey, trim(regexp_replace(coalesce(p_type, ''), ' superfamily$', '')) AS t FROM part)")
def normalise_label(spark, d):
    return C.clean_labels(table(spark, d, "part").select("p_partkey", "p_type"), "p_type")


@query("SELECT p_partkey, upper(trim(p_brand)) AS p_brand, upper(trim(p_type)) AS p_type FROM part WHERE p_partkey IS NOT NULL AND coalesce(trim(p_brand), '') <> '' AND coalesce(trim(p_type), '') <> ''")
def clean_pair_records(spark, d):
    return C.clean_pair_records(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), "p_partkey", "p_brand", "p_type")


@query("SELECT p_partkey, p_type, CASE WHEN n > 1 THEN c || '_' || r ELSE c END AS clean_id FROM (SELECT *, count(*) OVER (PARTITION BY c) AS n, row_number() OVER (PARTITION BY c ORDER BY p_partkey) AS r FROM (SELECT p_partkey, p_type, regexp_replace(p_type, '[^A-Za-z0-9._-]', '_', 'g') AS c FROM part))")
def sanitise_id(spark, d):
    return C.sanitise_id(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", "p_partkey")


@query(f"WITH {CONTIGS} SELECT sample_id, id, row_number() OVER (PARTITION BY id ORDER BY sample_id)::INT AS r FROM (SELECT DISTINCT sample_id, tool AS id FROM contigs)")
def disambiguate_rank(spark, d):
    from pyspark.sql.window import Window

    ids = contigs(spark, d).select("sample_id", F.col("tool").alias("id")).distinct()
    return ids.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("sample_id")))


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, 'the') AND NOT regexp_matches(url, '[0-9]$')")
def exclude_patterns(spark, d):
    return C.exclude_patterns(table(spark, d, "pages").select("page_id", "url"), "url", ["the", "[0-9]$"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 20", "l_quantity")
def min_length_filter(spark, d):
    return C.min_length_filter(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 20)


BIN = "CASE WHEN size <= 0 THEN 'Empty' WHEN size = 1 THEN 'One' WHEN size < 10 THEN '<10' WHEN size <= 100 THEN '>10' ELSE '>100' END"
STRATA = "SELECT stratum, bin, seqs, n, n / sum(n) OVER (PARTITION BY stratum) AS share FROM (SELECT stratum, {bin} AS bin, sum(size)::BIGINT AS seqs, count(*) AS n FROM (SELECT stratum, value, count(DISTINCT sequence) AS size FROM ({src}) GROUP BY ALL) GROUP BY ALL)"


@query(f"WITH {SEQS} " + STRATA.format(bin=BIN, src="SELECT 'family' AS stratum, family AS value, sequence FROM seqs"), "share")
def strata_summary(spark, d):
    return C.strata_summary(seqs(spark, d), ["family"], "sequence")


@query(f"WITH {SEQS} " + STRATA.format(bin=BIN, src="SELECT 'family' AS stratum, family AS value, sequence FROM seqs UNION ALL SELECT 'organism', organism, sequence FROM seqs"), "share")
def multi_strata_summary(spark, d):
    return C.strata_summary(seqs(spark, d), ["family", "organism"], "sequence")


@query(f"WITH {SEQS} SELECT family, size, {BIN} AS bin FROM (SELECT family, count(*) AS size FROM seqs GROUP BY 1)")
def stratum_label(spark, d):
    return seqs(spark, d).groupBy("family").agg(F.count(F.lit(1)).alias("size")).withColumn("bin", X.strata_label(F.col("size")))


@query(f"WITH {SEQS} SELECT family, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM seqs) AS pct, count(*) >= 5 AS eligible FROM seqs GROUP BY 1", "pct")
def label_distribution(spark, d):
    return C.label_distribution(seqs(spark, d), "family")


@query("SELECT p_partkey, p_size, CASE WHEN count(*) OVER (PARTITION BY p_size) >= 10 THEN 's' || p_size ELSE 'UNDER' END AS pool FROM part")
def pool_by_size(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("label"))
    return C.pool_by_size(p, "label").drop("label")


@query("SELECT p_partkey, substr(p_type, 1, 1) AS first_residue, right(p_name, 3) AS last_codon, regexp_matches(p_name, '(TAA|TAG|TGA)$') AS has_stop FROM part")
def start_stop_codon_flags(spark, d):
    return C.codon_flags(table(spark, d, "part"), "p_name", "p_type").select("p_partkey", "first_residue", "last_codon", "has_stop")


@query(
    f"""WITH {SEQS} SELECT *, CASE WHEN nucleotides::DOUBLE / letters >= 0.8 THEN 'NUCLEOTIDE' WHEN amino::DOUBLE / letters >= 0.8 THEN 'AMINO' ELSE 'MIXED' END AS type FROM (SELECT organism,
  sum(length(sequence) - length(regexp_replace(sequence, '[ACGTUNacgtun]', '', 'g')))::BIGINT AS nucleotides, sum(length(sequence) - length(regexp_replace(sequence, '[ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g')))::BIGINT AS amino, sum(length(sequence))::BIGINT AS letters FROM seqs GROUP BY 1)"""
)
def sequence_type(spark, d):
    plain = seqs(spark, d).withColumn("sequence", F.translate("sequence", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    count = lambda letters: F.sum(X.count_letter(F.col("sequence"), letters))
    got = plain.groupBy("organism").agg(count("ACGTUN").alias("nucleotides"), count("ACDEFGHIKLMNPQRSTVWY").alias("amino"), F.sum(F.length("sequence")).alias("letters"))
    return got.withColumn("type", X.sequence_type(F.col("nucleotides"), F.col("amino"), F.col("letters")))


@query("SELECT s_suppkey, s_name FROM supplier")
def project_required(spark, d):
    return C.project_required(table(spark, d, "supplier"), ["s_suppkey", "s_name", "p_seq_true"])


@query("SELECT s_suppkey, s_acctbal AS cov, NULL::VARCHAR AS reference FROM supplier", "cov")
def resolve_alt_columns(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    got = C.resolve_alt_columns(s, {"cov": ["p_refcov", "s_acctbal"], "reference": ["hits", "CRBB"]}, {"cov": "double", "reference": "string"})
    return got.select("s_suppkey", "cov", "reference")


@query("SELECT l_orderkey, l_linenumber, ln(1 + l_extendedprice) AS log_l_extendedprice, ln(1 + l_quantity) AS log_l_quantity, coalesce(l_tax, 0) AS l_tax FROM lineitem", "log_l_extendedprice log_l_quantity l_tax")
def log1p_features(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax")
    return C.log1p_features(li, ["l_extendedprice", "l_quantity"], "l_tax").drop("l_extendedprice", "l_quantity")


RUN = "CASE WHEN p_size > 25 THEN 'out/part' || p_partkey || '_200x_PE_IDBA_dir' ELSE 'x/s_' || p_partkey || '_SPADES_k' || p_size || '_p' || (p_size * 4) END"


@query(f"SELECT path, CASE WHEN p_size > 25 THEN 'part' || p_partkey ELSE 's_' || p_partkey END AS sample_id, CASE WHEN p_size > 25 THEN 'IDBA' ELSE 'SPADES' END AS tool, CASE WHEN p_size <= 25 THEN p_size END AS kmer, CASE WHEN p_size <= 25 THEN CASE WHEN p_size * 4 > 1 THEN p_size * 4 / 100.0 END END AS prop FROM (SELECT *, {RUN} AS path FROM part)", "prop")
def parse_run_path(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    path = F.when(size > 25, F.concat(F.lit("out/part"), key, F.lit("_200x_PE_IDBA_dir"))).otherwise(F.concat(F.lit("x/s_"), key, F.lit("_SPADES_k"), size.cast("string"), F.lit("_p"), (size * 4).cast("string")))
    return C.parse_run_path(table(spark, d, "part").select(path.alias("path")), "path")


@query("SELECT dataset, split_part(dataset, '_', 1) AS sample, (p_size * 10)::INT AS depth, 'PE' AS layout, 'TRINITY' AS assembler FROM (SELECT *, 'Fold' || (p_partkey % 12) || '_' || (p_size * 10) || 'x_PE_TRINITY' AS dataset FROM part)")
def parse_dataset_name(spark, d):
    name = F.concat(F.lit("Fold"), (F.col("p_partkey") % 12).cast("string"), F.lit("_"), (F.col("p_size") * 10).cast("string"), F.lit("x_PE_TRINITY"))
    return C.parse_dataset_name(table(spark, d, "part").select(name.alias("dataset")), "dataset")


@query(f"WITH {SEQS} SELECT sequence, string_agg(entry_id::VARCHAR, '|' ORDER BY entry_id) AS merged_ids, count(*) AS n FROM seqs GROUP BY 1")
def exact_dedup_merge_ids(spark, d):
    return S.exact_dedup_merge_ids(seqs(spark, d), "sequence", "entry_id")


@query("SELECT p_brand, p_type, min(p_partkey) AS rep_id, count(*) AS n_collapsed, string_agg(p_partkey::VARCHAR, '|' ORDER BY p_partkey) AS merged_ids, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY ALL")
def paired_dedup(spark, d):
    return S.paired_dedup(table(spark, d, "part"), "p_brand", "p_type", "p_partkey", ["p_name"])


@query("SELECT k, missing_from FROM (SELECT c_nationkey AS k, 'b' AS missing_from FROM customer EXCEPT ALL SELECT s_nationkey, 'b' FROM supplier) UNION ALL (SELECT s_nationkey, 'a' FROM supplier EXCEPT ALL SELECT c_nationkey, 'a' FROM customer)")
def pairing_invariant(spark, d):
    return S.pairing_invariant(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("SELECT c_custkey, ((row_number() OVER (ORDER BY c_custkey) - 1) // 500 + 1)::BIGINT AS chunk FROM customer")
def chunk_rows(spark, d):
    return S.chunk_rows(table(spark, d, "customer").select("c_custkey"), "c_custkey")


U = "('0x' || md5('1-' || {k})[1:13])::BIGINT / 4503599627370496.0"
FOLD = f"floor({U} * 12)::INT + 1"


@query(f"SELECT o_orderkey, {FOLD.format(k='o_orderkey')} AS fold FROM orders")
def vfold_split(spark, d):
    return D.vfold_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


SFOLD = "SELECT o_orderkey, o_orderpriority, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('1-' || o_orderkey), o_orderkey) - 1) % 12)::INT + 1 AS fold FROM orders"


@query(SFOLD)
def stratified_vfold(spark, d):
    return D.stratified_vfold(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey")


@query(f"WITH f AS ({SFOLD}) SELECT o_orderpriority, i::INT AS fold, count(*) FILTER (fold <> i) AS n_analysis FROM f, range(1, 13) AS r(i) GROUP BY ALL")
def fold_strata_counts(spark, d):
    return D.fold_strata_counts(stratified_vfold(spark, d), "o_orderpriority", 12)


MAN = f"man AS (SELECT row_number() OVER (ORDER BY family)::INT AS fold_id, family AS held_out, n AS n_test, a - n AS n_train, log10(n) AS log10_n_test, n / a AS p_test FROM (SELECT family, count(*) AS n, (SELECT count(*) FROM seqs) AS a FROM seqs GROUP BY 1) WHERE n >= 5 AND a - n >= 50)"


@query(f"WITH {SEQS}, {MAN} SELECT * FROM man", "log10_n_test p_test")
def loso_manifest(spark, d):
    return D.loso_manifest(seqs(spark, d), "family")


@query(f"WITH {SEQS}, {MAN} SELECT entry_id, family, fold_id FROM seqs LEFT JOIN man ON family = held_out")
def loso_split(spark, d):
    return D.loso_split(seqs(spark, d).select("entry_id", "family"), "family")


@query(f"WITH {SEQS}, {MAN}, f AS (SELECT family, count(*) FILTER (organism = 'en') AS n FROM seqs GROUP BY 1) SELECT held_out, n_test, n AS n_found FROM man JOIN f ON family = held_out WHERE n <> n_test")
def manifest_check(spark, d):
    found = seqs(spark, d).groupBy(F.col("family").alias("held_out")).agg(F.count_if(F.col("organism") == "en").alias("n"))
    return D.manifest_check(loso_manifest(spark, d), found, "held_out")


@query(f"SELECT o_orderkey, fraction FROM (SELECT o_orderkey, {U.format(k='o_orderkey')} AS u FROM orders), (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS fraction) WHERE u < fraction")
def fraction_subsample(spark, d):
    return D.fraction_subsample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", [0.1, 0.5, 0.9])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('1-' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 3")
def group_sample_n(spark, d):
    return D.group_sample_n(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 3)


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {U.format(k='l_orderkey')} < 0.3")
def read_subsample(spark, d):
    return D.read_subsample(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 0.3)


CLU = "cl AS (SELECT c_nationkey AS cluster, c_custkey AS member, min(c_custkey) OVER (PARTITION BY c_nationkey) AS rep FROM customer)"


def clusters(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("member"))
    return c.join(c.groupBy("cluster").agg(F.min("member").alias("rep")), "cluster")


@query(f"WITH {CLU}, p AS (SELECT cluster, arg_min(member, (md5('1-' || member), member)) AS m FROM cl WHERE member <> rep GROUP BY 1) SELECT cl.*, CASE WHEN member = m THEN 'test' ELSE 'reference' END AS role FROM cl LEFT JOIN p USING (cluster)")
def cluster_holdout_split(spark, d):
    return D.cluster_holdout_split(clusters(spark, d), "cluster", "member", "rep")


@query(f"WITH {CLU} SELECT cluster, arg_min(member, (md5('1-' || member), member)) AS member FROM cl WHERE member <> rep GROUP BY 1")
def cluster_pick_one(spark, d):
    return cluster_holdout_split(spark, d).where("role = 'test'").select("cluster", "member")


@query(f"WITH {CLU}, s AS (SELECT cluster % 5 AS g, cluster, count(*) AS n FROM cl GROUP BY ALL) SELECT g, count(*) AS n_clusters, sum(n)::BIGINT AS n_seqs, 1 - sum(n * n) / (sum(n) * sum(n))::DOUBLE AS simpson, 1 - count(*) / sum(n)::DOUBLE AS redundancy FROM s GROUP BY 1", "simpson redundancy")
def simpson_of_clusters(spark, d):
    return K.simpson_of_clusters(clusters(spark, d).withColumn("g", F.col("cluster") % 5), ["g"], "cluster")


LETTERS = 64


def pc(k: int) -> str:
    """Overlapping pieces of the sequences: a substring of a long text is slow in SQL too."""
    return f"pc AS (SELECT s.* REPLACE (substr(sequence, j * 512 + 1, {511 + k}) AS sequence) FROM seqs s, range(0, (length(sequence) - {k}) // 512 + 1) AS p(j) WHERE length(sequence) >= {k})"




KM = pc(5) + ", km AS (SELECT organism, 5 AS k, substr(sequence, i, 5) AS kmer, count(*) AS n FROM pc, range(1, length(sequence) - 3) AS r(i) GROUP BY ALL)"


def counts(spark, d):
    return K.kmer_counts(seqs(spark, d), ["organism"], "sequence", [5])


@query(f"WITH {SEQS}, {pc(7)} SELECT entry_id, count(*) AS n, count(DISTINCT kmer) AS n_distinct, min(kmer) AS low, max(kmer) AS high FROM (SELECT entry_id, substr(sequence, i, 7) AS kmer FROM pc, range(1, length(sequence) - 5) AS r(i)) GROUP BY 1")
def kmers(spark, d):
    return K.sums_by_sequence(seqs(spark, d), "entry_id", "sequence", 7).select("entry_id", F.col("total").alias("n"), F.col("richness").alias("n_distinct"), "low", "high")


@query(f"WITH {SEQS}, {KM} SELECT organism, k, kmer, n FROM km")
def kmer_counts(spark, d):
    return counts(spark, d)


@query(f"WITH {SEQS}, {pc(5)} SELECT 5 AS k, kmer, count(*) AS n_seqs FROM (SELECT DISTINCT entry_id, substr(sequence, i, 5) AS kmer FROM pc, range(1, length(sequence) - 3) AS r(i)) GROUP BY kmer")
def kmer_presence(spark, d):
    return K.kmer_presence(seqs(spark, d), "sequence", [5])


@query(f"WITH {SEQS}, {KM} SELECT organism, k, kmer, n, n / sum(n) OVER (PARTITION BY organism) AS freq FROM km", "freq")
def kmer_relative_freq(spark, d):
    return K.kmer_relative_freq(counts(spark, d), ["organism"])


@query(f"WITH {SEQS}, {KM} SELECT organism, k, kmer, n FROM km WHERE kmer IN (SELECT kmer FROM km GROUP BY 1 HAVING sum(n) >= 50)")
def kmer_matrix(spark, d):
    return K.kmer_matrix(counts(spark, d), 50)


@query(f"WITH {SEQS}, {KM} SELECT organism, k, n AS multiplicity, count(*) AS n_kmers FROM km GROUP BY ALL")
def kmer_abundance_spectrum(spark, d):
    return K.kmer_abundance_spectrum(counts(spark, d), ["organism"])


@query(f"WITH {SEQS} SELECT family, sum(length(sequence))::BIGINT AS bases, round(ln(sum(length(sequence))) / ln(4))::INT AS k FROM seqs GROUP BY 1")
def suggested_k(spark, d):
    return K.suggested_k(seqs(spark, d), ["family"], "sequence")


DIV = f"""dv AS (SELECT organism, 5 AS k, count(*) AS richness, sum(n)::BIGINT AS total, count(*) FILTER (n = 1) AS singletons, -sum(p * ln(p)) AS shannon, sum(p * p) AS s2, max(p) AS pm FROM (SELECT *, n / sum(n) OVER (PARTITION BY organism) AS p FROM km) GROUP BY 1),
 ds AS (SELECT organism, k, richness, total, singletons, shannon, shannon / ln(2) AS shannon_bits, shannon / ln(richness) AS evenness, shannon / ln(2) / (k * log2({LETTERS})) AS normalised, (richness - 1) / (2 * ln(2) * total) AS miller_madow,
 shannon / ln(2) / (k * log2({LETTERS})) + (richness - 1) / (2 * ln(2) * total) AS adjusted, (shannon / ln(2) + (richness - 1) / (2 * ln(2) * total)) / (k * log2({LETTERS})) AS adjusted_scaled, log2(richness) AS renyi0, -log2(s2) AS renyi2, -log2(pm) AS renyi_inf,
 exp(shannon) AS hill1, 1 / s2 AS ens_pie, 1 - s2 AS gini_simpson, 1 - singletons / total AS good_coverage FROM dv)"""


def _diversity(name: str, columns: str):
    @query(f"WITH {SEQS}, {KM}, {DIV} SELECT organism, k, {columns} FROM ds", " ".join(c for c in columns.split(", ") if c not in ("richness", "total", "singletons")))
    def made(spark, d):
        return K.diversity(counts(spark, d), ["organism"], LETTERS).select("organism", "k", *columns.split(", "))

    from .book import ORACLE_SQL, QUERIES

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("made"), ORACLE_SQL.pop("made")


_diversity("kmer_assessment", "shannon, richness, evenness")
_diversity("shannon_bits", "shannon_bits, total")
_diversity("normalised_entropy", "shannon_bits, normalised")
_diversity("miller_madow", "miller_madow, adjusted, adjusted_scaled")
_diversity("renyi_entropy", "renyi0, shannon_bits, renyi2, renyi_inf")
_diversity("hill_numbers", "hill1, ens_pie, gini_simpson, richness, evenness, good_coverage")


@query(f"WITH {SEQS}, {pc(5)}, f AS (SELECT family, substr(sequence, i, 5) AS kmer, count(*) AS n FROM pc, range(1, length(sequence) - 3) AS r(i) GROUP BY ALL) SELECT family, 5 AS k, -sum(p * ln(p)) AS shannon, count(*) AS richness, -sum(p * ln(p)) / ln(count(*)) AS evenness FROM (SELECT *, n / sum(n) OVER (PARTITION BY family) AS p FROM f) GROUP BY 1", "shannon evenness")
def kmer_assessment_by_family(spark, d):
    return K.kmer_assessment(seqs(spark, d), ["family"], "sequence", [5])


@query(f"WITH {SEQS}, {pc(5)}, f AS (SELECT {FOLD.format(k='entry_id')} AS fold, substr(sequence, i, 5) AS kmer, count(*) AS n FROM pc, range(1, length(sequence) - 3) AS r(i) GROUP BY ALL) SELECT fold, 5 AS k, -sum(p * ln(p)) AS shannon, count(*) AS richness, -sum(p * ln(p)) / ln(count(*)) AS evenness FROM (SELECT *, n / sum(n) OVER (PARTITION BY fold) AS p FROM f) GROUP BY 1", "shannon evenness")
def kmer_assessment_by_fold(spark, d):
    return K.kmer_assessment(D.vfold_split(seqs(spark, d), "entry_id"), ["fold"], "sequence", [5])


@query(f"WITH {SEQS}, {pc(5)}, f AS (SELECT entry_id, substr(sequence, i, 5) AS kmer, count(*) AS n FROM pc, range(1, length(sequence) - 3) AS r(i) GROUP BY ALL) SELECT entry_id, 5 AS k, greatest(-sum(p * ln(p)), 0) AS shannon, count(*) AS richness, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) END AS evenness FROM (SELECT *, n / sum(n) OVER (PARTITION BY entry_id) AS p FROM f) GROUP BY 1", "shannon evenness")
def kmer_assessment_by_entry(spark, d):
    return K.kmer_assessment_by_sequence(seqs(spark, d), "entry_id", "sequence", 5)


@query(f"WITH {SEQS}, {pc(5)}, x AS (SELECT pc.*, fraction FROM pc, (SELECT unnest([0.2, 0.6])::DOUBLE AS fraction) WHERE {U.format(k='entry_id')} < fraction), f AS (SELECT fraction, substr(sequence, i, 5) AS kmer, count(*) AS n FROM x, range(1, length(sequence) - 3) AS r(i) GROUP BY ALL) SELECT fraction, 5 AS k, -sum(p * ln(p)) AS shannon, count(*) AS richness, -sum(p * ln(p)) / ln(count(*)) AS evenness FROM (SELECT *, n / sum(n) OVER (PARTITION BY fraction) AS p FROM f) GROUP BY 1", "shannon evenness")
def kmer_assessment_subsampled(spark, d):
    return K.kmer_assessment(D.fraction_subsample(seqs(spark, d), "entry_id", [0.2, 0.6]), ["fraction"], "sequence", [5])


@query(f"WITH {SEQS}, {pc(21)}, f AS (SELECT organism, substr(sequence, i, 21) AS kmer, count(*) AS n FROM pc, range(1, length(sequence) - 19) AS r(i) GROUP BY ALL) SELECT organism, 21 AS k, n::BIGINT AS multiplicity, count(*) AS n_kmers FROM f GROUP BY ALL")
def long_kmer_spectrum(spark, d):
    """How many 21-mers occur how often in each organism, counted by runs of a common minimizer."""
    return K.long_kmer_spectrum(seqs(spark, d), ["organism"], "sequence", 21)


SHARES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
V = U.replace("'1-'", "'2-'").format(k="entry_id")


@query(
    f"""WITH {SEQS}, {pc(5)}, sh AS (SELECT unnest({SHARES})::DOUBLE AS fraction), x AS (SELECT {FOLD.format(k='entry_id')} AS own, (SELECT min(fraction) FROM sh WHERE {V} < fraction) AS enters, sequence FROM pc),
  f AS (SELECT own, enters, substr(sequence, i, 5) AS kmer, count(*) AS n FROM x, range(1, length(sequence) - 3) AS r(i) WHERE enters IS NOT NULL GROUP BY ALL),
  c AS (SELECT fold, fraction, kmer, sum(n) AS n FROM f, sh, range(1, 13) AS v(fold) WHERE own <> fold AND enters <= fraction GROUP BY ALL)
  SELECT fold::INT AS fold, fraction, 5 AS k, sum(n)::BIGINT AS total, -sum(p * ln(p)) AS shannon, count(*) AS richness, -sum(p * ln(p)) / ln(count(*)) AS evenness FROM (SELECT *, n / sum(n) OVER (PARTITION BY fold, fraction) AS p FROM c) GROUP BY fold, fraction""",
    "fraction shannon evenness",
)
def kmer_assessment_folds(spark, d):
    """The nine shares of each of twelve folds' analysis sets."""
    return K.nested_assessment(seqs(spark, d), "entry_id", "sequence", [5], 12, SHARES)


@query(
    f"WITH {SEQS}, f AS ("
    + " UNION ALL ".join(f"SELECT family, {k} AS k, substr(sequence, i, {k}) AS kmer, count(*) AS n FROM (SELECT s.family, substr(sequence, j * 512 + 1, {511 + k}) AS sequence FROM seqs s, range(0, (length(sequence) - {k}) // 512 + 1) AS p(j) WHERE length(sequence) >= {k}), range(1, length(sequence) - {k} + 2) AS r(i) GROUP BY ALL" for k in (4, 5, 6, 7, 8))
    + ") SELECT family, k, -sum(p * ln(p)) AS shannon, count(*) AS richness, -sum(p * ln(p)) / ln(count(*)) AS evenness FROM (SELECT *, n / sum(n) OVER (PARTITION BY family, k) AS p FROM f) GROUP BY ALL",
    "shannon evenness",
)
def kmer_assessment_all_k(spark, d):
    """Five lengths of k-mers from one cut of the longest."""
    return K.kmer_assessment(seqs(spark, d), ["family"], "sequence", [4, 5, 6, 7, 8])


@query(f"WITH {SEQS}, {KM}, {DIV} SELECT organism, k, shannon, (SELECT count(DISTINCT kmer) FROM km) AS global_richness, shannon / ln((SELECT count(DISTINCT kmer) FROM km)) AS global_evenness FROM ds", "shannon global_evenness")
def global_evenness(spark, d):
    return K.global_evenness(counts(spark, d), ["organism"])


@query(f"WITH {SEQS}, {KM}, t AS (SELECT organism, sum(n) AS t, count(*) FILTER (n = 1) AS f1 FROM km GROUP BY 1), p AS (SELECT organism, (1 - f1 / t) * n / t AS p, t FROM km JOIN t USING (organism)) SELECT organism, 5 AS k, sum(-p * ln(p) / (1 - pow(1 - p, t))) AS chao_shen FROM p GROUP BY 1", "chao_shen")
def chao_shen(spark, d):
    return K.chao_shen(counts(spark, d), ["organism"])


MERGE = "mg AS (SELECT 5 AS k, kmer, sum(CASE WHEN organism = 'fr' THEN n ELSE 0 END)::BIGINT AS n_test, sum(CASE WHEN organism <> 'fr' THEN n ELSE 0 END)::BIGINT AS n_train FROM km GROUP BY kmer)"


def merged(spark, d):
    return K.two_sample(counts(spark, d), "organism", "fr")


@query(f"WITH {SEQS}, {KM}, {MERGE} SELECT * FROM mg")
def kmer_outer_merge(spark, d):
    return merged(spark, d)


JS = "js AS (SELECT n_test / sum(n_test) OVER () AS p, n_train / sum(n_train) OVER () AS q, sum(n_test) OVER () AS nt FROM mg)"


@query(f"WITH {SEQS}, {KM}, {MERGE}, {JS}, v AS (SELECT 5 AS k, sqrt(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) AS jsd FROM js) SELECT k, jsd, CASE WHEN jsd > 0.15 THEN 'HIGH' WHEN jsd > 0.1 THEN 'MOD' ELSE 'LOW' END AS flag FROM v", "jsd")
def jensen_shannon(spark, d):
    return K.divergence(merged(spark, d)).select("k", "jsd", "flag")


@query(f"WITH {SEQS}, {KM}, {MERGE}, {JS}, kt AS (SELECT 5 AS k, sum(CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) END) AS kl, 2 * max(nt) * sum(CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) END) AS chi2, (count(*) - 1)::DOUBLE AS df FROM js) SELECT k, kl, chi2, {chi2_tail('chi2', 'df')} AS p FROM kt", "kl chi2 p")
def kl_divergence_test(spark, d):
    return K.divergence(merged(spark, d)).select("k", "kl", "chi2", "p")


def _p(x: str) -> str:
    return f"((length(sequence) - length(replace(sequence, '{x}', '')))::DOUBLE / nullif(length(sequence), 0))"


def _h(x: str) -> str:
    return f"CASE WHEN {_p(x)} > 0 THEN -{_p(x)} * log2({_p(x)}) ELSE 0 END"


def _i(x: str) -> str:
    return f"CASE WHEN {_p(x)} > 0 THEN {_p(x)} * log2({_p(x)} * 4) ELSE 0 END"


def _scores(name: str, column: str, sql: str):
    @query(f"WITH {SEQS} SELECT entry_id, {sql} AS {column} FROM seqs", column)
    def made(spark, d):
        return K.sequence_scores(seqs(spark, d), ["entry_id"], "sequence", "aetn").select("entry_id", column)

    from .book import ORACLE_SQL, QUERIES

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("made"), ORACLE_SQL.pop("made")


_scores("base_entropy", "base_entropy", " + ".join(_h(x) for x in "aetn"))
_scores("information_content", "information", " + ".join(_i(x) for x in "aetn"))


@query("SELECT p_partkey, CASE WHEN length(p_name) >= 2 THEN 100.0 * len(list_filter(range(1, length(p_name)), lambda i: p_name[i] <> p_name[i + 1])) / (length(p_name) - 1) END AS complexity FROM part", "complexity")
def change_complexity(spark, d):
    return table(spark, d, "part").select("p_partkey", X.change_complexity(F.col("p_name")).alias("complexity"))


@query(f"WITH {SEQS} SELECT family, count(*) AS n, avg(length(sequence)) AS mean_len, stddev_samp(length(sequence)) AS sd_len, min(length(sequence))::INT AS min_len, max(length(sequence))::INT AS max_len, sum(length(sequence) - length(regexp_replace(sequence, '[GC]', '', 'g'))) / sum(length(sequence)) AS gc FROM seqs GROUP BY 1", "mean_len sd_len gc")
def length_gc_stats(spark, d):
    return K.length_gc_stats(seqs(spark, d), ["family"], "sequence")


def _c(x: str) -> str:
    return f"(length(sequence) - length(replace(sequence, '{x}', '')))"


@query(f"WITH {SEQS} SELECT entry_id, ({_c('G')} + {_c('C')})::DOUBLE / nullif(length(sequence), 0) AS prop_gc, ({_c('G')} - {_c('C')})::DOUBLE / nullif({_c('G')} + {_c('C')}, 0) AS gc_skew, ({_c('A')} - {_c('T')})::DOUBLE / nullif({_c('A')} + {_c('T')}, 0) AS at_skew, ({_c('CG')} // 2)::BIGINT AS cpg_count, {_c('CG')} / 2.0 * length(sequence) / nullif({_c('G')} * {_c('C')}, 0) AS cpg_ratio, len(list_distinct(list_transform(range(1, length(sequence) - 4), lambda i: substr(sequence, i, 6)))) / 4096 AS linguistic_complexity_6 FROM seqs", "prop_gc gc_skew at_skew cpg_ratio linguistic_complexity_6")
def composition_features(spark, d):
    return K.composition_features(seqs(spark, d), ["entry_id"], "sequence")


PSPM = "ps AS (SELECT i AS pos, p_brand[i] AS letter, count(*) AS n FROM part, range(1, length(p_brand) + 1) AS r(i) GROUP BY ALL), fq AS (SELECT pos::INT AS pos, letter, n, n / sum(n) OVER (PARTITION BY pos) AS freq FROM ps)"


@query(f"WITH {PSPM} SELECT * FROM fq", "freq")
def pspm(spark, d):
    return K.pspm(table(spark, d, "part"), "p_brand")


@query(f"WITH {PSPM} SELECT p_partkey, exp(-avg(ln(freq))) AS perplexity FROM (SELECT p_partkey, i::INT AS pos, p_brand[i] AS letter FROM part, range(1, length(p_brand) + 1) AS r(i)) JOIN fq USING (pos, letter) GROUP BY 1", "perplexity")
def perplexity(spark, d):
    return K.perplexity(table(spark, d, "part"), "p_partkey", "p_brand", pspm(spark, d))


@query(f"WITH {SEQS}, {pc(4)}, f AS (SELECT family, substr(sequence, i, 4) AS sequence, count(*) AS n FROM pc, range(1, length(sequence) - 2) AS r(i) GROUP BY ALL), s AS (SELECT sequence, {' + '.join(_h(x) for x in 'aetn')} AS h, {' + '.join(_i(x) for x in 'aetn')} AS i, 100.0 * ((sequence[1] <> sequence[2])::INT + (sequence[2] <> sequence[3])::INT + (sequence[3] <> sequence[4])::INT) / 3 AS c FROM (SELECT DISTINCT sequence FROM f)) SELECT family, sum(n)::BIGINT AS n, sum(h * n) / sum(n) AS base_entropy, sum(i * n) / sum(n) AS information, sum(c * n) / sum(n) AS complexity FROM f JOIN s USING (sequence) GROUP BY 1", "base_entropy information complexity")
def kmer_score_profile(spark, d):
    return K.kmer_score_profile(seqs(spark, d), ["family"], "sequence", 4, "aetn")


@query(f"WITH {HITS}, x AS (SELECT *, sstart + 20 AS s2, sstart AS e2 FROM hits) SELECT hit_id, sstart, send, greatest(least(send, s2) - greatest(sstart, e2) + 1, 0)::DOUBLE / least(send - sstart + 1, 21) AS overlap FROM x", "overlap")
def overlap_ratio(spark, d):
    h = hits(spark, d)
    return h.select("hit_id", "sstart", "send", X.overlap_ratio(F.col("sstart"), F.col("send"), F.col("sstart") + 20, F.col("sstart")).alias("overlap"))


@query("SELECT l_orderkey, l_linenumber, ln(l_extendedprice) - ln(l_quantity) AS lnrr, sqrt(pow(l_tax / l_extendedprice, 2) + pow(l_discount / l_quantity, 2)) AS se, 2 * l_discount / (1 - l_discount + 2 * l_discount) AS shifted FROM lineitem", "lnrr se shifted")
def lnrr(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", X.lnrr(F.col("l_extendedprice"), F.col("l_quantity")).alias("lnrr"), X.se_lnrr(F.col("l_tax"), F.col("l_discount"), F.col("l_extendedprice"), F.col("l_quantity")).alias("se"), X.odds_shift(F.lit(2.0), F.col("l_discount")).alias("shifted"))


@query(f"WITH {SEQS} SELECT organism, family, count(*) AS n FROM seqs WHERE organism IS NOT NULL AND family IS NOT NULL GROUP BY ALL")
def organism_family_crosstab(spark, d):
    return seqs(spark, d).where("organism IS NOT NULL AND family IS NOT NULL").groupBy("organism", "family").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SEQS} SELECT family, count(*) AS n FROM seqs WHERE length(sequence) >= 200 GROUP BY 1")
def count_reference_sequences(spark, d):
    return C.min_length_filter(seqs(spark, d).withColumn("w", F.length("sequence")), "w", 200).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


#: Replicates of bootstraps.
REPLICATES = 10_000


@query()
def bootstrap_entropy_ci(spark, d):
    """Mean, sd and interval of the organisms' k-mer entropy over 10,000 hash-weighted replicates of the sequences."""
    docs = seqs(spark, d).select(F.coalesce("organism", F.lit("")).alias("organism"), "entry_id", "sequence")
    per = materialise(K.kmer_counts(docs, ["organism", "entry_id"], "sequence", [3], summed=False), "kmer-counts")  # cut once, weighted many times
    h = R.replicate_entropy(per, "organism", "entry_id", REPLICATES).groupBy("organism")
    p = lambda x: F.percentile("shannon", F.lit(x))  # noqa: E731 (a number for each replicate)
    return h.agg(F.lit(3).alias("k"), F.count(F.lit(1)).alias("replicates"), F.avg("shannon").alias("mean"), F.stddev_samp("shannon").alias("sd"), p(0.025).alias("low"), p(0.975).alias("high"))
