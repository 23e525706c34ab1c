"""Round trips and scans of the file formats."""

from assaylake.sources import files
from assaylake.streaming.ingest import incremental_ingest


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_contigs_and_hits(spark, tmp_path):
    head = "contig_name,length,prop_gc,gc_skew,at_skew,cpg_count,cpg_ratio,orf_length,linguistic_complexity_6,has_crb,reference_coverage,hits\n"
    put(tmp_path / "in/s1_200x_PE_IDBA_dir/contigs.csv", head + "c1,300,0.5,0,0,1,1.0,90,0.1,true,0.97,refA\nc2,200,NA,0,0,1,1.0,90,0.1,false,NA,NA\n")
    put(tmp_path / "in/s2_SPADES_k25_p50/contigs.csv", head + "c3,300,0.5,0,0,1,1.0,90,0.1,true,1.0,refB\n")
    got = {r.contig_name: r for r in files.scan_contigs(spark, str(tmp_path / "in")).collect()}
    assert (got["c1"].sample_id, got["c1"].tool, got["c1"].reference_coverage) == ("s1", "IDBA", 0.97)
    assert got["c2"].hits is None and (got["c3"].kmer, got["c3"].prop) == (25, 0.5)
    assert files.scan_contigs(spark, str(tmp_path / "in"), exclude=["SPADES"]).count() == 2
    p = put(tmp_path / "x.1.blast", "q\ts\t98.5\t100\t0\t0\t1\t100\t200\t101\t1e-9\t  180\t100\t400\n")
    r = files.scan_hits(spark, p).first()
    assert (r.db, r.bitscore, r.sstart, r.send) == ("x.1", 180.0, 200, 101)


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "f", "ACGT" * 50), ("b", "g", "TT"), ("c", "f", "G" * 80)], "id string, fam string, seq string")
    files.sink_fasta(df.coalesce(1), str(tmp_path / "out"), "id", "seq")
    back = files.scan_fasta(spark, str(tmp_path / "out"))
    assert {(r.id, r.sequence) for r in back.collect()} == {(r.id, r.seq) for r in df.collect()}
    files.sink_fasta(df, str(tmp_path / "by"), "id", "seq", group="fam")
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"fam=f", "fam=g"}


def test_fastq(spark, tmp_path):
    p = put(tmp_path / "r.fq", "@r1/1\nACGT\n+\n@III\n@r2/1\nAC\n+\nI\n@r3/1 x\nGG\n+\n!I\n")
    reads = files.scan_fastq(spark, p)
    assert {(r.read_id, r.qual) for r in reads.collect()} == {("r1", "@III"), ("r3", "!I")}  # r2 is malformed
    q = {r.cycle: r for r in files.quality_by_cycle(reads).collect()}
    assert (q[1]["mean"], q[2]["median"]) == (15.5, 40.0)
    assert files.paired_read_sanitise(reads, reads.where("read_id = 'r3'")).count() == 1


def test_small_formats(spark, tmp_path):
    m = put(tmp_path / "m.tsv", "# comment\n\ns1\ta\tb\tr.fa\n")
    assert [tuple(r) for r in files.scan_manifest(spark, m).collect()] == [("s1", "a", "b", "r.fa")]
    d = put(tmp_path / "d.txt", "c  1 5\nc\t2\t0\n\n")
    assert [tuple(r) for r in files.scan_depth(spark, d).orderBy("pos").collect()] == [("c", 1, 5), ("c", 2, 0)]
    c = put(tmp_path / "c.txt", "Read Name|Score_sf|% Hydrophobicity (Signal)|Superfamily (Signal)\nr1|3|61%|A\n")
    r = files.scan_classifier_tab(spark, c).first()
    assert (r.read_name, r.score_sf, r.superfamily_signal) == ("r1", 3.0, "A")
    x = put(tmp_path / "x.xml", "<db><entry><id>1</id><name>n</name><sequence>AC</sequence><proteinsencoded><protein><id>p1</id></protein><protein><id>p2</id></protein></proteinsencoded></entry><entry><id>2</id></entry></db>")
    assert {(r.entry_id, r.proteinid) for r in files.scan_xml_entries(spark, x).collect()} == {("1", "p1"), ("1", "p2"), ("2", None)}
    man = put(tmp_path / "man.tsv", "fold_id\tfold_tag\theld_out_superfamily\tn_test\tn_train\ttest_fasta\ttrain_fasta\n1\tF1\tO1 superfamily\t5\t50\ta\tb\n")
    meta = put(tmp_path / "meta.tsv", "sample_id\ttrain_ref\tsuperfamily\tcoverage\ns1_200x_PE\tr\tO1 superfamily\t200\n")
    a, b, leak = files.scan_loso_registry(spark, man, meta)
    assert a.first().held_out_superfamily == b.first().superfamily == "O1_superfamily" and b.first().sample_id == "s1" and leak is None


def test_sink_and_ingest(spark, tmp_path):
    df = spark.range(3)
    for _ in range(2):
        files.sink_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    put(tmp_path / "in/a.csv", "1\n2\n")
    schema = spark.range(1).schema
    call = lambda: incremental_ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "o"), str(tmp_path / "cp"))
    assert call() == 2
    assert call() == 0
    put(tmp_path / "in/b.csv", "3\n")
    assert call() == 1
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3


def test_fastq_of_many_blocks(spark, tmp_path):
    reads = [(f"r{i}", "ACGT" * (1 + i % 5), "@+I!" * (1 + i % 5)) for i in range(200)]
    for f in ("a", "b"):
        (tmp_path / f"{f}.fastq").write_text("".join(f"@{n}-{f}\n{s}\n+\n{q}\n" for n, s, q in reads))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = sorted((r.read_id, r.seq, r.qual) for r in files.scan_fastq(spark, f"{tmp_path}/*.fastq").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == sorted((f"{n}-{f}", s, q) for n, s, q in reads for f in "ab")
