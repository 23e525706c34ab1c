"""Scans and sinks of the file formats that sequence benchmarks use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaylake.operators.curate import exclude_patterns, parse_run_path

CONTIGS = "contig_name string, length int, prop_gc double, gc_skew double, at_skew double, cpg_count int, cpg_ratio double, orf_length int, linguistic_complexity_6 double, has_crb boolean, reference_coverage double, hits string"
HITS = "qseqid string, sseqid string, pident double, length int, mismatches int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double, qlen int, slen int"
MANIFEST = "sample_id string, fwd string, rev string, ref string"


def scan_contigs(spark: SparkSession, path: str, schema: str = CONTIGS, exclude: Sequence[str] = ()) -> DataFrame:
    """All contigs.csv below ``path`` in one scan, with sample_id, tool, kmer and prop from the name of their folder.

    Unreadable files are passed over; NA is null; paths that match a pattern of ``exclude`` are left out.
    """
    df = spark.read.option("ignoreCorruptFiles", True).csv(path, schema=schema, header=True, nullValue="NA", recursiveFileLookup=True, pathGlobFilter="contigs.csv")
    folder = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/contigs[.]csv$", 1)
    got = df.select("*", folder.alias("run"), F.col("_metadata.file_path").alias("path"))
    return parse_run_path(exclude_patterns(got, "path", exclude) if exclude else got, "run").drop("run")


def scan_hits(spark: SparkSession, path: str, schema: str = HITS) -> DataFrame:
    """Headerless tabular alignments with ``db``, the base name of their file; numbers may be padded with blanks."""
    df = spark.read.csv(path, schema=schema, sep="\t", nullValue="NA", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.select("*", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("db"))


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, header, sequence) of multi-line records: split by the reader at header marks, so one large file is read in parts."""
    rec = spark.read.text(path, lineSep="\n>").select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "^>", "").alias("v")).where(F.trim("v") != "")
    header = F.regexp_replace(F.substring_index("v", "\n", 1), "\r$", "")
    body = F.expr("substring(v, length(substring_index(v, '\\n', 1)) + 2)")
    return rec.select("file", F.regexp_extract(header, r"^(\S*)", 1).alias("id"), header.alias("header"), F.regexp_replace(body, r"\s", "").alias("sequence"))


def scan_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, read_id, seq, qual) of four-line records.

    A record may start with '@' in its quality line too, so lines are numbered in their file: lines of a block follow
    one another, and blocks are counted first and placed by where they start.
    """
    at = {"file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")}
    lines = spark.read.text(path).select("value", *[c.alias(n) for n, c in at.items()]).withColumn("_m", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "_block").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    placed = blocks.select("file", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    rec = lines.join(F.broadcast(placed), ["file", "_block"]).withColumn("j", F.col("_m") - F.col("_first") + F.col("_before"))  # a row for each block
    line = lambda k: F.max(F.when(F.col("j") % 4 == k, F.col("value")))
    four = rec.groupBy("file", F.floor(F.col("j") / 4).alias("n")).agg(line(0).alias("head"), line(1).alias("seq"), line(2).alias("plus"), line(3).alias("qual"))
    good = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual"))
    return four.where(good).select("file", F.regexp_extract("head", r"^@(\S+?)(/[12])?(\s|$)", 1).alias("read_id"), "seq", "qual")


def scan_xml_entries(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry and encoded protein of an XML database, nulls where an entry encodes none."""
    schema = "id string, name string, organismlatin string, organismdiet string, organismregion string, sequence string, proteinsencoded struct<protein: array<struct<id: string, name: string, genesuperfamily: string, sequence: string>>>"
    df = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    each = df.select("*", F.explode_outer("proteinsencoded.protein").alias("p"))
    return each.select(F.col("id").alias("entry_id"), "organismlatin", "organismdiet", "organismregion", "name", "sequence", F.col("p.id").alias("proteinid"), F.col("p.name").alias("proteinname"), F.col("p.genesuperfamily").alias("genesuperfamily"), F.col("p.sequence").alias("proteinsequence"))


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Sample manifest of four columns; blank lines and those that start with '#' are passed over."""
    return spark.read.csv(path, schema=MANIFEST, sep="\t", comment="#").where(F.coalesce(F.trim("sample_id"), F.lit("")) != "")


def scan_loso_registry(spark: SparkSession, manifest: str, metadata: str, leakage: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Fold manifest, sample metadata and, if there, leakage, their keys normalised alike: white space to '_', depth tags off sample ids."""
    label = lambda c: F.regexp_replace(F.trim(c), r"\s", "_")
    m = spark.read.csv(manifest, sep="\t", header=True, schema="fold_id int, fold_tag string, held_out_superfamily string, n_test int, n_train int, test_fasta string, train_fasta string")
    s = spark.read.csv(metadata, sep="\t", header=True, schema="sample_id string, train_ref string, superfamily string, coverage int")
    got = [m.withColumn("held_out_superfamily", label("held_out_superfamily")), s.withColumns({"superfamily": label("superfamily"), "sample_id": F.regexp_replace("sample_id", "_[0-9]+x_PE$", "")})]
    if leakage is None:
        return got[0], got[1], None
    leak = spark.read.csv(leakage, sep="\t", header=True, schema="assembly string, held_out_sf string, total_hits int, hits_pident90_qcov80 int")
    return got[0], got[1], leak.withColumn("held_out_sf", label("held_out_sf"))


def scan_depth(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, depth) separated by any white space."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("chrom"), F.get(parts, F.lit(1)).try_cast("int").alias("pos"), F.get(parts, F.lit(2)).try_cast("int").alias("depth"))


def scan_classifier_tab(spark: SparkSession, path: str) -> DataFrame:
    """Bar-delimited classifier output: names in lower case with '_', percent signs stripped, counts and scores as numbers."""
    df = spark.read.csv(path, sep="|", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    clean = {c: "_".join("".join(x if x.isalnum() else " " for x in c.lower()).split()) for c in df.columns}
    df = df.withColumnsRenamed(clean)
    numeric = [c for c in df.columns if c.startswith(("score", "e_value", "sequence_frequency", "a_a", "cysteine", "hydrophobicity"))]
    return df.withColumns({c: F.regexp_replace(c, "%", "").try_cast("double") for c in numeric})


def quality_by_cycle(reads: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """Mean, median, quartiles and deciles of Phred quality by cycle, from counts of (cycle, quality)."""
    each = reads.select(*by, F.posexplode(F.split("qual", "")).alias("cycle", "ch")).where("ch <> ''")
    counts = each.groupBy(*by, (F.col("cycle") + 1).alias("cycle"), (F.ascii("ch") - 33).alias("q")).agg(F.count(F.lit(1)).alias("n"))
    p = lambda x: F.percentile("q", F.lit(x), F.col("n"))
    return counts.groupBy(*by, "cycle").agg((F.sum(F.col("q") * F.col("n")) / F.sum("n")).alias("mean"), p(0.5).alias("median"), p(0.25).alias("lower_quartile"), p(0.75).alias("upper_quartile"), p(0.1).alias("p10"), p(0.9).alias("p90"))


def paired_read_sanitise(left: DataFrame, right: DataFrame) -> DataFrame:
    """Reads that both mates have."""
    r = right.select("read_id", F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    return left.select("read_id", F.col("seq").alias("seq1"), F.col("qual").alias("qual1")).join(r, "read_id")


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), redo: bool = False) -> None:
    """Write a stage's result; one that is there stays unless ``redo``."""
    writer = df.write.mode("overwrite" if redo else "ignore").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite" if redo else "ignore")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def sink_fasta(df: DataFrame, path: str, header: str, seq: str, group: str | None = None, width: int = 80) -> None:
    """FASTA text wrapped at ``width``, in a folder for each group if one is named."""
    wrapped = F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")
    out = df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), wrapped).alias("value"), *([F.col(group)] if group else []))
    (out.write.partitionBy(group) if group else out.write).mode("overwrite").text(path)
