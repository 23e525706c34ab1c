"""Curation: filters, labels and clean-up of sequence tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaylake.functions.expressions import normalise_label, safe_ratio, sequence_type, strata_label


def curation_steps(name: str = "name", protein: str = "protein", seq: str = "sequence", min_length: int = 100, exclude: str = "[Pp]atent", start: str = "^M", unclear: str = "N") -> dict[str, Column]:
    """The predicates of curation by name, in order."""
    return {
        "not_excluded": ~F.coalesce(F.col(name).rlike(exclude), F.lit(False)),
        "has_protein": F.col(protein).isNotNull() & F.col(protein).rlike(start),
        "clear": ~F.coalesce(F.col(seq).contains(unclear), F.lit(True)),
        "long_enough": F.coalesce(F.length(seq) >= min_length, F.lit(False)),
    }


def curate_filter(seqs: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Rows that pass every predicate; the optimiser makes one filter of them."""
    for step in steps.values():
        seqs = seqs.where(step)
    return seqs


def curation_funnel(seqs: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """(step, name, n): rows left after each predicate, counted in one pass."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("c0")]
    for i, step in enumerate(steps.values(), 1):
        passed = passed & step
        counts.append(F.count_if(passed).alias(f"c{i}"))
    names = ["all", *steps]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"c{i}").alias("n")) for i, n in enumerate(names)]))
    return seqs.agg(*counts).select(rows.alias("r")).select("r.*")


def recode_by_key(df: DataFrame, column: str, key: str, mapping: Mapping[str, str]) -> DataFrame:
    """``column`` overwritten where ``key`` is in the mapping."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(pairs, F.col(key)), F.col(column)))


def recode_levels(df: DataFrame, column: str, levels: Mapping[str, str], out: str = "level") -> DataFrame:
    """Display name (unmatched values as they are) and its place in the order, ``<out>_ord``."""
    names = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    places = F.create_map(*[F.lit(x) for i, k in enumerate(levels, 1) for x in (k, i)])
    return df.withColumns({out: F.coalesce(F.try_element_at(names, F.col(column)), F.col(column)), f"{out}_ord": F.try_element_at(places, F.col(column))})


def clean_labels(df: DataFrame, column: str, missing: str = "UNCLASSIFIED") -> DataFrame:
    return df.withColumn(column, normalise_label(F.col(column), missing))


def clean_pair_records(df: DataFrame, key: str, nuc: str, prot: str) -> DataFrame:
    """Trimmed upper-case sequences; rows that lack an id or either sequence go."""
    clean = lambda c: F.upper(F.trim(c))
    got = df.withColumns({nuc: clean(F.col(nuc)), prot: clean(F.col(prot))})
    return got.where((F.coalesce(F.col(key).cast("string"), F.lit("")) != "") & (F.coalesce(nuc, F.lit("")) != "") & (F.coalesce(prot, F.lit("")) != ""))


def sanitise_id(df: DataFrame, column: str, order: str) -> DataFrame:
    """Characters other than letters, digits, '.', '_' and '-' become '_'; ids that then coincide get '_<n>'."""
    df = df.withColumn("clean_id", F.regexp_replace(column, "[^A-Za-z0-9._-]", "_"))
    w = Window.partitionBy("clean_id")
    number = F.row_number().over(w.orderBy(order))
    return df.withColumn("clean_id", F.when(F.count(F.lit(1)).over(w) > 1, F.concat_ws("_", "clean_id", number.cast("string"))).otherwise(F.col("clean_id")))


def exclude_patterns(df: DataFrame, column: str, patterns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Rows whose column matches no pattern and is no listed id; null columns stay."""
    bad = F.lit(False)
    for p in patterns:
        bad = bad | F.col(column).rlike(p)
    if ids:
        bad = bad | F.col(column).isin(list(ids))
    return df.where(~F.coalesce(bad, F.lit(False)))


def min_length_filter(df: DataFrame, length: str, least: float = 200) -> DataFrame:
    return df.where(F.col(length) >= least)


def strata_summary(df: DataFrame, strata: Sequence[str], seq: str) -> DataFrame:
    """For each stratum column: distinct sequences of each stratum, binned: bins, sequences, share of bins.

    One unpivoted pass for all columns.
    """
    long = df.select(seq, F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("value")) for s in strata])).alias("x")).select("x.*", seq)
    sizes = long.groupBy("stratum", "value").agg(F.count_distinct(seq).alias("size"))
    bins = sizes.groupBy("stratum", strata_label(F.col("size")).alias("bin")).agg(F.sum("size").alias("seqs"), F.count(F.lit(1)).alias("n"))
    return bins.withColumn("share", safe_ratio(F.col("n"), F.sum("n").over(Window.partitionBy("stratum"))))


def label_distribution(df: DataFrame, label: str, least: int = 5) -> DataFrame:
    """Counts, percent of all, and whether a label is large enough to be held out."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("_all"))  # one row
    return counts.crossJoin(F.broadcast(whole)).select(label, "n", (F.col("n") * 100.0 / F.col("_all")).alias("pct"), (F.col("n") >= least).alias("eligible"))


def pool_by_size(df: DataFrame, label: str, least: int = 10, pooled: str = "UNDER") -> DataFrame:
    """Labels of fewer rows pooled under one name; sizes are aggregated and joined, so no label's rows meet in one task."""
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(sizes, F.col(label).eqNullSafe(F.col("_l"))).withColumn("pool", F.when(F.col("_n") >= least, F.col(label)).otherwise(F.lit(pooled))).drop("_l", "_n")


def codon_flags(df: DataFrame, nuc: str, prot: str) -> DataFrame:
    """First residue, last three bases, and whether they are a stop."""
    return df.withColumns({"first_residue": F.substring(prot, 1, 1), "last_codon": F.expr(f"right({nuc}, 3)"), "has_stop": F.col(nuc).rlike("(TAA|TAG|TGA)$")})


def set_sequence_type(df: DataFrame, by: Sequence[str], seq: str, nucleotides: str = "ACGTUN", amino: str = "ACDEFGHIKLMNPQRSTVWY") -> DataFrame:
    """NUCLEOTIDE, AMINO or MIXED for each set of sequences."""
    count = lambda letters: F.sum(F.length(seq) - F.length(F.translate(F.upper(seq), letters, "")))
    got = df.groupBy(*by).agg(count(nucleotides).alias("nucleotides"), count(amino).alias("amino"), F.sum(F.length(seq)).alias("letters"))
    return got.withColumn("type", sequence_type(F.col("nucleotides"), F.col("amino"), F.col("letters")))


def project_required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of the columns that are there: the scan reads no others."""
    return df.select([c for c in columns if c in df.columns])


def resolve_alt_columns(df: DataFrame, alternatives: Mapping[str, Sequence[str]], types: Mapping[str, str]) -> DataFrame:
    """For each name the first of its alternatives that is present, else a typed null."""
    out = {}
    for name, options in alternatives.items():
        there = [F.col(c) for c in options if c in df.columns]
        out[name] = F.coalesce(*there) if there else F.lit(None).cast(types[name])
    return df.withColumns(out)


def log1p_features(df: DataFrame, columns: Sequence[str], coverage: str | None = None) -> DataFrame:
    """``log1p`` of skewed counters, and unknown coverage as 0."""
    got = df.withColumns({f"log_{c}": F.log1p(c) for c in columns})
    return got.withColumn(coverage, F.coalesce(coverage, F.lit(0.0))) if coverage else got


def parse_run_path(df: DataFrame, path: str) -> DataFrame:
    """sample_id, tool, kmer, prop of '<sample>[_<d>x_PE]_<tool>[_dir]' and '<sample>_<tool>_k<k>_p<p>' names; percents become shares."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), "_dir$", "")
    factorial = "^(.+)_([A-Za-z]+)_k([^_]+)_p([^_]+)$"
    plain = "^(.+)_([^_]+)$"
    is_f = name.rlike(factorial)
    p = F.expr("try_cast(_p AS double)")
    got = df.withColumns({"_name": name, "_p": F.regexp_extract(name, factorial, 4)})
    return got.withColumns({
        "sample_id": F.regexp_replace(F.when(is_f, F.regexp_extract("_name", factorial, 1)).otherwise(F.regexp_extract("_name", plain, 1)), "_[0-9]+x_PE$", ""),
        "tool": F.when(is_f, F.regexp_extract("_name", factorial, 2)).otherwise(F.regexp_extract("_name", plain, 2)),
        "kmer": F.expr(f"try_cast(regexp_extract(_name, '{factorial}', 3) AS int)"), "prop": F.when(p > 1, p / 100).otherwise(p),
    }).drop("_name", "_p")


def parse_dataset_name(df: DataFrame, name: str) -> DataFrame:
    """sample, assembler, depth and PE or SE from a data set's name, parsed on distinct names and joined back."""
    names = df.select(F.col(name).alias("_n")).distinct()
    parsed = names.select(
        "_n", F.regexp_extract("_n", "^([A-Za-z0-9#]+)", 1).alias("sample"), F.expr(r"try_cast(regexp_extract(_n, '([0-9]+)x', 1) AS int)").alias("depth"),
        F.when(F.col("_n").contains("PE"), "PE").when(F.col("_n").contains("SE"), "SE").alias("layout"), F.element_at(F.split("_n", "_"), -1).alias("assembler"),
    )
    return df.join(parsed, F.col(name) == F.col("_n")).drop("_n")
