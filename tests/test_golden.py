"""Worked examples of the metrics, intervals and sequence scores."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from assaylake.functions import expressions as X
from assaylake.operators import curate, folds, hits, joins, kmers, metrics, sets, stats

LENGTHS = [800, 750, 900, 850, 700, 650, 720, 680, 600, 950]
COVERAGE = [0.95, 0.92, 0.40, 0.91, 0.10, 0.0, 0.0, 0.93, 0.05, 0.97]
HITS = ["refA1", "refA2", "refA1", "refA3", "refA1", None, None, "refA4", "refA1", "refA5"]


@pytest.fixture(scope="module")
def contigs(spark):
    rows = [("s", "IDBA", n, c, h) for n, c, h in zip(LENGTHS, COVERAGE, HITS, strict=True)]
    return spark.createDataFrame(rows, "sample_id string, tool string, length int, reference_coverage double, hits string")


def test_scoring_chain(spark, contigs):
    m = metrics.coverage_metrics_behera(contigs, ["sample_id", "tool"], [0.9], 7)
    r = m.first()
    assert (r.TP, r.FP, r.TP_refs, r.FN, r.precision) == (5, 5, 5, 2, 0.5)
    assert r.sensitivity == pytest.approx(5 / 7)
    three = metrics.three_way_classify(m, spark.createDataFrame([("s", 2)], "sample_id string, leak int"), ["sample_id"])
    t = three.first()
    assert (t.FP_paralog, t.FP_spurious, t.precision_ood, t.precision_combined) == (2, 3, 0.5, 0.7)
    assert metrics.compute_cif(three, ["threshold"]).first().mean_cif == pytest.approx(1.4)


def test_phantom_null_counts_one_more(contigs):
    with_null = contigs.withColumn("reference_coverage", F.when(F.col("reference_coverage") > 0, F.col("reference_coverage")))
    plain = metrics.coverage_metrics(with_null, ["tool"], [0.9], 7).first()
    odd = metrics.coverage_metrics(with_null, ["tool"], [0.9], 7, phantom_null=True).first()
    assert (plain.TP, plain.FP, plain.TN, plain.FN) == (5, 3, 2, 2)
    assert odd.TP == 6


def test_metrics_do_not_depend_on_partitions(spark, contigs):
    want = metrics.derived_scores(metrics.coverage_metrics(contigs, ["tool"], [0.1, 0.9], 7)).orderBy("threshold").collect()
    for n in (1, 7, 200):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = metrics.derived_scores(metrics.coverage_metrics(contigs.repartition(n), ["tool"], [0.1, 0.9], 7)).orderBy("threshold").collect()
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_overlap_ratio(spark):
    rows = [(1, 10, 6, 15, 0.5), (1, 5, 6, 9, 0.0), (None, 5, 6, 9, 0.0), (10, 1, 15, 6, 0.5), (3, 3, 1, 9, 1.0)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, want double")
    for r in df.withColumn("got", X.overlap_ratio(*(F.col(c) for c in "abcd"))).withColumn("back", X.overlap_ratio(*(F.col(c) for c in "cdab"))).collect():
        assert r.got == r.want == r.back


def test_sequence_scores(spark):
    df = spark.createDataFrame([("a", "AAAAAAAAAA"), ("b", "ATGCATGC"), ("c", "A")], "id string, s string")
    got = {r.id: r for r in kmers.sequence_scores(df, ["id"], "s").collect()}
    assert (got["a"].complexity, got["a"].base_entropy) == (0.0, 0.0)
    assert (got["b"].complexity, got["b"].base_entropy) == (100.0, 2.0)
    assert got["c"].complexity is None
    assert kmers.kmers(df, ["id"], "s", [4]).where("id = 'c'").count() == 0


def test_kmers_match_plain_python(spark):
    text = "".join(chr(97 + (i * i) % 7) for i in range(1500)) + "é😀z"
    df = spark.createDataFrame([(1, text), (2, "ab"), (3, None)], "id int, s string")
    got = sorted(r.kmer for r in kmers.kmers(df, ["id"], "s", [5]).collect())
    assert got == sorted(text[i : i + 5] for i in range(len(text) - 4))
    assert kmers.kmer_presence(df, "s", [5]).count() == len(set(got))


def test_uniform_perplexity_is_four(spark):
    matrix = spark.createDataFrame([(p, c, 0.25) for p in range(1, 9) for c in "ACGT"], "pos int, letter string, freq double")
    df = spark.createDataFrame([(1, "ACGTTTAA"), (2, "GGGGGGGG")], "id int, s string")
    assert [r.perplexity for r in kmers.perplexity(df, "id", "s", matrix).collect()] == [pytest.approx(4)] * 2


def test_diversity_bounds(spark):
    df = spark.createDataFrame([("x", "ACGTACGTTTGA"), ("y", "AAAAAAAA")], "g string, s string")
    for r in kmers.diversity(kmers.kmer_counts(df, ["g"], "s", [2]), ["g"]).collect():
        assert 0 <= r.shannon <= math.log(r.richness) + 1e-9
        assert r.renyi0 >= r.shannon_bits - 1e-9 >= r.renyi2 - 1e-6
    js = kmers.divergence(kmers.two_sample(kmers.kmer_counts(df, ["g"], "s", [2]), "g", "x")).first()
    assert 0 <= js.jsd <= 1 and js.flag == "HIGH"


def blast(spark, rows):
    return spark.createDataFrame([(q, s, 99.0, n, 100, 100, 1, n, float(n), 1.0) for q, s, n in rows], "qseqid string, sseqid string, pident double, length int, qlen int, slen int, sstart int, send int, bitscore double, max_coverage double")


def test_annotation_closed_form(spark):
    rows = [("a", "r1", 95), ("b", "r2", 60), ("c", "r3", 80), ("d", "r3", 80), ("e", "r4", 80), ("e", "r5", 80), ("f", "r3", 90), ("f", "r6", 80)]
    got = {r.qseqid: r.final_annotation for r in hits.annotate_hits(blast(spark, rows)).collect()}
    assert got == {"a": "full", "b": "fragment", "c": "chimera", "d": "chimera", "e": "fragment", "f": "multi"}


@pytest.mark.parametrize("threshold", [0.0, 0.29])
def test_overlaps_equal_brute_force(spark, threshold):
    """A hot key, intervals in either order, several from one owner, nulls; more ranges than keys."""
    draw = random.Random(7)
    rows = [("hot", f"q{i % 3}", i, 400 * i + draw.randint(0, 150), 400 * i + draw.randint(151, 500)) for i in range(300)]
    for key in range(80):
        for i in range(draw.randint(1, 6)):
            s, n = draw.randint(1, 200), draw.choice([7, 20, 60, 100, 100])
            rows.append((f"k{key}", f"q{draw.randint(1, 3)}", 1000 + 10 * key + i, *draw.choice([(s, s + n - 1), (s + n - 1, s)])))
    rows += [("nulls", "q1", 5000, None, 9), ("nulls", "q2", 5001, 1, 9), ("nulls", None, 5002, 1, 9), ("nulls", "q2", 5003, 1, 9)]
    got = {}
    df = spark.createDataFrame(rows, "k string, o string, hit_id int, sstart int, send int")
    for row in hits.contig_overlap_selfjoin(df.select(F.col("k").alias("sseqid"), F.col("o").alias("qseqid"), "sstart", "send"), threshold).collect():
        got[row["sseqid"], 1] = row["overlaps"]
    for row in hits.hit_overlap_selfjoin(df.select(F.col("k").alias("qseqid"), "hit_id", "sstart", "send"), threshold).collect():
        got[row["qseqid"], 2] = row["overlaps"]
    want = {}
    for k, *_ in rows:
        mine = [r for r in rows if r[0] == k and r[3] is not None]
        for owner in (1, 2):
            want[k, owner] = False
            for a, b in itertools.combinations(mine, 2):
                (s, e), (u, v) = sorted(a[3:]), sorted(b[3:])
                if None not in (a[owner], b[owner]) and a[owner] != b[owner] and (min(e, v) - max(s, u) + 1) / (min(e - s, v - u) + 1) > threshold:
                    want[k, owner] = True
    assert got == want
    assert threshold == 0.0 or len(set(got.values())) == 2


def test_depth_sweep_equals_brute_force(spark):
    rows = [("k", 1, 5), ("k", 3, 8), ("k", 8, 3), ("k", 20, 22), ("m", 2, 2)]
    got = hits.interval_depth(spark.createDataFrame(rows, "k string, s int, e int"), "k").collect()
    want: dict = {}
    for k, a, b in rows:
        for p in range(min(a, b), max(a, b) + 1):
            want[k, p] = want.get((k, p), 0) + 1
    assert {(r.k, p): r.depth for r in got for p in range(r.pos, r.next_pos)} == want


def test_curation_and_dedup(spark):
    df = spark.createDataFrame([(1, "x", "MK", "ACGT"), (2, "patent x", "MK", "ACGT"), (3, "y", None, "ACGA"), (4, "z", "MA", "ACNN")], "id int, name string, protein string, sequence string")
    steps = curate.curation_steps(min_length=4)
    assert [r.id for r in curate.curate_filter(df, steps).collect()] == [1]
    assert [r.n for r in curate.curation_funnel(df, steps).orderBy("step").collect()] == [4, 3, 2, 1, 1]
    merged = {r.sequence: r.merged_ids for r in sets.exact_dedup_merge_ids(df, "sequence", "id").collect()}
    assert merged["ACGT"] == "1|2"
    paired = {r.sequence: r for r in sets.paired_dedup(df, "sequence", "protein", "id", ["name"]).collect()}
    assert (paired["ACGT"].rep_id, paired["ACGT"].n_collapsed, paired["ACGT"].merged_ids, paired["ACGT"].name) == (1, 2, "1|2", "x")


def test_run_paths(spark):
    df = spark.createDataFrame([("test_A_superfamily_200x_PE_IDBA_dir",), ("x/s_1_SPADES_k25_p50",), ("odd",)], "p string")
    got = [(r.sample_id, r.tool, r.kmer, r.prop) for r in curate.parse_run_path(df, "p").collect()]
    assert got[0] == ("test_A_superfamily", "IDBA", None, None)
    assert got[1] == ("s_1", "SPADES", 25, 0.5)


def test_folds_partition_ids(spark):
    df = spark.range(200).withColumn("s", F.col("id") % 3)
    f = folds.stratified_vfold(df, ["s"], "id", 4)
    assert f.count() == 200 and {r.fold for r in f.collect()} == {1, 2, 3, 4}
    n = {(r.s, r.fold): r.n_analysis for r in folds.fold_strata_counts(f, "s", 4).collect()}
    assert all(n[s, k] == f.where((F.col("s") == s) & (F.col("fold") != k)).count() for s, k in list(n)[:3])
    small = {r.id for r in folds.fraction_subsample(df, "id", [0.2, 0.7]).where("fraction = 0.2").collect()}
    large = {r.id for r in folds.fraction_subsample(df, "id", [0.2, 0.7]).where("fraction = 0.7").collect()}
    assert small < large
    c = df.select("s", "id").join(df.groupBy("s").agg(F.min("id").alias("rep")), "s")
    roles = folds.cluster_holdout_split(c, "s", "id", "rep").where("role = 'test'")
    assert roles.count() == 3 and roles.where("id = rep").count() == 0


def test_rank_statistics(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 5.0), ("b", 7.0)]
    df = spark.createDataFrame(rows, "c string, v double")
    w = stats.wilcoxon_rank_sum(df, ["v"], "c", "a", "b").first()
    assert w.U == 1.0 and w.z < 0
    assert stats.kruskal_wallis(df, ["v"], "c").first().H == pytest.approx(w.z**2, rel=1e-6)
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double")
    got = {r.p: r.p_adj for r in stats.p_adjust(p, "p").collect()}
    assert got[0.01] == pytest.approx(0.03) and got[0.03] == pytest.approx(0.04) and got[None] is None


def test_joins_keep_nulls(spark, contigs):
    refs = spark.createDataFrame([("refA1", "A"), ("refA9", "A"), (None, "B")], "ref_id string, family string")
    got = {r.family: (r.n_refs, r.n_missing) for r in joins.reference_completeness(contigs, refs, ["family"]).collect()}
    assert got == {"A": (2, 1), "B": (1, 1)}
    empty = contigs.limit(0)
    assert metrics.coverage_metrics_behera(empty, ["tool"], [0.9], 7).count() == 0
    assert sets.set_combinations(empty, "hits", "tool").count() == 0


def test_motif_scan(spark):
    """Motifs planted at later starts are found, and all results are those of scoring every window by hand."""
    members = {"f": ["MKVLAC", "MKVLSC", "MRVLAC", "MKILAC"], "g": ["WWPHYQ", "WWPHFQ"]}
    family = spark.createDataFrame([(f, m) for f, ms in members.items() for m in ms], "family string, head string")
    filler = "DEGNTD" * 200
    rows = [(1, "MKVLAC" + filler), (2, filler[:7] + "MKVLAC" + filler), (3, filler[:1001] + "MRVLAC" + filler[:50] + "WWPHYQ"), (4, filler), (5, filler + "MKVLAC"), (6, "GMKVLACGMKVLAC"), (7, "MKVLA"), (8, ""), (9, None), (10, "ÄMKVLACé"), (11, "D" * 40 + "MKVLDC")]
    df = spark.createDataFrame(rows, "id int, s string")
    want = {}
    for f, ms in members.items():
        odds = lambda pos, letter: math.log2((20 * sum(m[pos] == letter for m in ms) + 1) / (len(ms) + 1))  # noqa: B023, E731
        top = sum(max(odds(pos, m[pos]) for m in ms) for pos in range(6))
        for i, text in rows:
            windows = [(sum(odds(pos, text[at + pos]) for pos in range(6)), -at - 1) for at in range(len(text or "") - 5)]
            if windows and max(windows)[0] >= 0.8 * top:
                want[i, f] = -max(windows)[1], pytest.approx(max(windows)[0])
    got = {(r.id, r.family): (r.start, r.score) for r in kmers.motif_scan(df, "id", "s", kmers.pspm(family, "head", ["family"]), "family").collect()}
    assert got == want
    assert {k: v[0] for k, v in got.items()} == {(1, "f"): 1, (2, "f"): 8, (3, "f"): 1002, (3, "g"): 1058, (5, "f"): 1201, (6, "f"): 2, (10, "f"): 2}
    assert kmers.motif_scan(df, "id", "s", kmers.pspm(family.limit(0), "head", ["family"]), "family").count() == 0


def test_motif_scan_query_reads_whole_documents(spark, tmp_path):
    from assaylake.plans.registry import QUERIES

    rows = [(i, "en", "Lead word then other things") for i in range(30)] + [(50, "de", "unlike " * 300 + "Lead word"), (51, None, None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.start for r in QUERIES["motif_scan"](spark, str(tmp_path)).where("family = 'en'").collect()}
    assert got == {**{i: 1 for i in range(30)}, 50: 1801}
