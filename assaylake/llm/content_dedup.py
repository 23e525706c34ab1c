"""Exact dedup by content sort: sampled splitters, external sort, neighbouring full comparisons."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import ascii_lower, col, materialise, packed, parts_of, small

#: Leading characters that splitters hold.
HEAD = 48


def _sorted(docs: DataFrame, text: str, doc_id: str, keep: str, whole: bool) -> DataFrame:
    """(id, norm), with ``row`` if ``whole``: rows range-partitioned and sorted by normalised text; of equals the one to keep comes last.

    Splitters are sampled from the first characters, a digest and the id, so that what the driver
    sees of a sample is small however long the texts are, and a text that fills a third of all
    rows spreads over many tasks.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    norm = ascii_lower(F.coalesce(col(text), F.lit("")))
    columns = {"id": col(doc_id).cast("long"), "norm": norm}
    rows = packed(docs, **columns) if whole else docs.select(*[c.alias(n) for n, c in columns.items()])
    rows = rows.withColumns({"head": F.substring("norm", 1, HEAD), "digest": F.unhex(F.sha2("norm", 256))})
    order = F.col("id").asc_nulls_first() if keep == "max" else F.col("id").desc_nulls_first()
    dealt = rows.repartitionByRange(parts_of(docs), "head", "digest", order)
    return dealt.sortWithinPartitions("head", "digest", "norm", order).drop("head", "digest")


def _run_starts(texts: pa.Array, before: str | None) -> np.ndarray:
    """Whether each text differs, compared in full, from the one before it."""
    first = np.array([before is None or texts[0].as_py() != before])
    return first if len(texts) == 1 else np.concatenate([first, pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)])


def _label_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: its run in this partition, the run's keeper and size; text only at the partition's ends.

    Holds the ids of the run at hand and one text of it.
    """
    pid, first, text, ids = TaskContext.get().partitionId(), 0, None, []

    def out(ids: pa.Array, starts: np.ndarray, texts: list[str], last: bool) -> pa.RecordBatch:
        """The rows of whole runs, which start at ``starts`` of ``ids`` and number from ``first``."""
        sizes = np.diff(np.append(starts, len(ids)))
        ends, run = starts + sizes - 1, np.repeat(np.arange(len(sizes)), sizes)
        is_last = np.zeros(len(ids), bool)
        is_last[ends] = True
        edges = {0} if first == 0 else set()
        edges |= {len(sizes) - 1} if last else set()
        edge = pa.array([texts[i] if i in edges else None for i in range(len(sizes))], pa.string())
        at_end = pa.array(np.where(is_last, run, -1), mask=~is_last)
        sha = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])
        cols = [ids, sha.take(pa.array(run)), pa.array(np.full(len(ids), pid, np.int32)), pa.array(first + run), ids.take(pa.array(ends[run])), pa.array(sizes[run]), pa.array(is_last), edge.take(at_end)]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "sha", "pid", "run", "keep", "size", "last", "edge"])

    for batch in small(batches, 2000):
        own, texts = batch.column("id"), batch.column("norm")
        starts = np.flatnonzero(_run_starts(texts, text))
        if not len(starts):
            ids.append(own)
            continue
        if text is None:
            done, at, heads = own[: starts[-1]], starts[:-1], texts.take(pa.array(starts[:-1])).to_pylist()
        else:
            done = pa.concat_arrays([*ids, own[: starts[-1]]])
            at, heads = np.append(0, starts[:-1] + len(done) - starts[-1]), [text, *texts.take(pa.array(starts[:-1])).to_pylist()]
        if len(done):
            yield out(done, at, heads, False)
            first += len(at)
        text, ids = texts[int(starts[-1])].as_py(), [own[starts[-1] :]]
    if text is not None:
        yield out(pa.concat_arrays(ids), np.zeros(1, np.int64), [text], True)


def _stitch(runs: DataFrame) -> DataFrame:
    """Join up the runs that cross partitions: neighbours are compared in full, two texts at a time.

    Windows see at most two rows for each partition, and no texts.
    """
    ends = runs.where("edge IS NOT NULL").select("pid", "run", "keep", "size", "edge")
    order = Window.orderBy("pid", "run")
    placed = ends.join(ends.select("pid", "run").withColumn("at", F.row_number().over(order)), ["pid", "run"])
    before = placed.select((F.col("at") + 1).alias("at"), F.col("edge").alias("before"))
    flags = placed.join(before, "at", "left").select("pid", "run", "keep", "size", F.coalesce((F.col("edge") != F.col("before")).cast("int"), F.lit(1)).alias("new"))
    g = Window.partitionBy("g").orderBy("pid", "run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = flags.withColumn("g", F.sum("new").over(order))
    return groups.select("pid", "run", F.last("keep").over(g).alias("g_keep"), F.sum("size").over(g).alias("g_size"), (F.last("pid").over(g) == F.col("pid")).alias("g_last"))


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "min") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal
    texts the smallest (``keep="min"``) or largest id stays; a null id stays only where its group
    has no other. Repeated rows count each, and exactly one row of a group is kept. No rows give
    no rows; other columns, whatever their names, are not read.
    """
    labelled = _sorted(docs, text, doc_id, keep, False).mapInArrow(_label_runs, "doc_id long, sha string, pid int, run long, keep long, size long, last boolean, edge string")
    runs = materialise(labelled, "content-runs")
    joined = runs.drop("edge").join(F.broadcast(_stitch(runs)), ["pid", "run"], "left")  # two rows a partition at most
    return joined.select(
        "doc_id",
        F.when(F.col("g_size").isNotNull(), F.col("g_keep")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("g_size", "size").alias("group_size"),
        (F.col("last") & F.coalesce("g_last", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "min") -> DataFrame:
    """The kept rows with all their columns, whatever their names; the rules are those of ``exact_duplicates``."""
    rows = _sorted(docs, text, doc_id, keep, True).select("row", "norm")
    schema = T.StructType([rows.schema["row"], T.StructField("pid", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("edge", T.StringType())])

    def last_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, run, held, before = TaskContext.get().partitionId(), -1, None, None
        for batch in small(batches):
            texts, rows = batch.column("norm"), batch.column("row")
            starts = _run_starts(texts, before)
            ends = [i - 1 for i, s in enumerate(starts) if s and i]  # rows after which another run starts
            if starts[0] and held is not None:
                yield pa.RecordBatch.from_arrays([held, pa.array([pid], pa.int32()), pa.array([run], pa.int64()), pa.array([before if run == 0 else None], pa.string())], names=schema.names)
            run += int(starts[0])
            if ends:
                edges = [texts[ends[0]].as_py() if run == 0 else None] + [None] * (len(ends) - 1)
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(ends)), pa.array([pid] * len(ends), pa.int32()), pa.array(range(run, run + len(ends)), pa.int64()), pa.array(edges, pa.string())], names=schema.names)
                run += len(ends)
            held, before = rows.take(pa.array([batch.num_rows - 1])), texts[batch.num_rows - 1].as_py()
        if held is not None:
            yield pa.RecordBatch.from_arrays([held, pa.array([pid], pa.int32()), pa.array([run], pa.int64()), pa.array([before], pa.string())], names=schema.names)

    runs = materialise(rows.mapInArrow(last_of_runs, schema), "content-kept")
    goes_on = _stitch(runs.select("pid", "run", F.lit(0).alias("keep"), F.lit(0).alias("size"), "edge")).where("NOT g_last").select("pid", "run")
    return runs.join(F.broadcast(goes_on), ["pid", "run"], "left_anti").select("row.*")
