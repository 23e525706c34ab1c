"""Bootstrap with thousands of replicates: a row's weights of all replicates are one vector, so rows are never copied for each."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose weights are made at a time, and k-mers counted side by side.
ROWS, KMERS = 128, 4096
#: The largest sum that a replicate's 16-bit count holds before it is added to a double.
FULL = 65_535
#: k-mers that so many of the rows at a time have are counted by a product of matrices, if its sums are below what floats hold exactly.
DENSE, EXACT = 0.1, 1 << 24


def poisson_cdf() -> list[float]:
    """P(X <= 0), P(X <= 1), ... of Poisson(1), as far as doubles tell them from 1."""
    made, term, total, k = [], math.exp(-1), 0.0, 0
    while total + term > total:
        total += term
        made.append(total)
        k += 1
        term /= k
    return made


def _by_top_bits() -> np.ndarray:
    """The Poisson(1) weight of each value of the upper 16 bits of a uniform number, 255 where a step of the distribution lies among them."""
    edges = np.arange(65_537) * 2.0**-16
    low, high = (np.searchsorted(poisson_cdf(), e, side=side) for e, side in ((edges[:-1], "right"), (edges[1:], "left")))
    return np.where(low == high, low, 255).astype(np.uint8)


CDF, BY_TOP_BITS = np.array(poisson_cdf()), _by_top_bits()


def weights(keys: np.ndarray, replicates: int, seed: int = 1) -> np.ndarray:
    """Poisson(1) weights (row, replicate) from a hash of the row's 64-bit key and the replicate's number: the same in any task."""
    steps = (np.arange(1, replicates + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
    made = np.empty((len(keys), replicates), np.uint8)
    x, shifted = np.empty_like(steps), np.empty_like(steps)
    for row, key in zip(made, keys.astype(np.int64).view(np.uint64), strict=True):  # a row at a time stays in the cache
        np.add(steps, key, out=x)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= np.right_shift(x, np.uint64(shift), out=shifted)
            x *= np.uint64(factor)
        x ^= np.right_shift(x, np.uint64(31), out=shifted)
        np.take(BY_TOP_BITS, np.right_shift(x, np.uint64(48), out=shifted), out=row)
        open_ = np.flatnonzero(row == 255)
        row[open_] = np.searchsorted(CDF, (x[open_] >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")
    return made


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """(key, slice, whether the key is new) of batches sorted by their first columns."""
    before: tuple | None = None
    for b in batches:
        new = np.zeros(max(b.num_rows - 1, 0), bool)
        for i in range(keys if b.num_rows else 0):
            c = b.column(i).dictionary_encode()
            at = c.indices.fill_null(len(c.dictionary)).to_numpy()
            new |= at[1:] != at[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi > lo:
                name = tuple(b.column(i)[lo].as_py() for i in range(keys))
                yield name, b.slice(lo, hi - lo), name != before
                before = name


def _added(partial: DataFrame, group: str, vectors: list[str]) -> DataFrame:
    """(group, vectors): vectors of doubles, as bytes, summed by group; tasks by group and a salt sum first."""
    schema, parts = partial.schema, max(2, int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now: tuple | None = None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], schema_of_group), *[pa.array([v.tobytes()], pa.binary()) for v in held]], names=[group, *vectors])
        schema_of_group: pa.DataType | None = None
        for key, rows, new in _runs(batches, 1):
            if new and now is not None:
                yield give()
            if new:
                now, held, schema_of_group = key, [], rows.column(0).type
            for r in range(rows.num_rows):
                each = [np.frombuffer(rows.column(1 + i)[r].as_py()) for i in range(len(vectors))]
                held = [h + v for h, v in zip(held, each, strict=True)] if held else each
        if now is not None:
            yield give()

    salted = partial.withColumn("_salt", F.spark_partition_id() % 32).repartition(parts, group, "_salt").drop("_salt").sortWithinPartitions(group).mapInArrow(add, schema)
    return salted.repartition(parts, group).sortWithinPartitions(group).mapInArrow(add, schema)


def _unfolded(summed: DataFrame, group: str, vectors: list[str]) -> DataFrame:
    """(group, replicate, a column for each vector)."""
    kind = summed.schema[group].dataType.simpleString()

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                each = [np.frombuffer(b.column(1 + i)[r].as_py()) for i in range(len(vectors))]
                at = np.arange(1, len(each[0]) + 1)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[r].as_py()] * len(at), b.column(0).type), pa.array(at), *[pa.array(v) for v in each]], names=[group, "replicate", *vectors])

    return summed.mapInArrow(out, f"{group} {kind}, replicate long, " + ", ".join(f"{v} double" for v in vectors))


def replicate_counts(df: DataFrame, group: str, key: str, replicates: int, seed: int = 1) -> DataFrame:
    """(group, replicate, rows, n): how many rows of each group a replicate draws, and how often in all."""
    kind = df.schema[group].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, tuple[np.ndarray, np.ndarray]] = {}
        type_: pa.DataType | None = None
        for b in batches:
            type_ = b.column(0).type
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                w = weights(part.column(1).to_numpy(zero_copy_only=False), replicates, seed)
                names = np.array(part.column(0).to_pylist(), object)
                for name in set(names.tolist()):
                    own = w[[n == name for n in names]]
                    some, all_ = held.get(name, (0, 0))
                    held[name] = some + (own > 0).sum(axis=0).astype(np.float64), all_ + own.sum(axis=0, dtype=np.float64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), type_), *[pa.array([v[i].tobytes() for v in held.values()], pa.binary()) for i in range(2)]], names=[group, "rows", "n"])

    rows = df.select(F.col(group), F.xxhash64(F.col(key).cast("string")).alias("h")).mapInArrow(partial, f"{group} {kind}, rows binary, n binary")
    return _unfolded(_added(rows, group, ["rows", "n"]), group, ["rows", "n"]).withColumns({"rows": F.col("rows").cast("long"), "n": F.col("n").cast("long")})


def replicate_entropy(per: DataFrame, group: str, key: str, replicates: int, seed: int = 1, kmers: int = KMERS) -> DataFrame:
    """(group, replicate, total, shannon): k-mer entropy of each group when its sequences are drawn with Poisson(1) weights.

    ``per``: (group, key, kmer, n), the counts of each sequence; a k-mer may come in several rows, each with a part of them. The k-mers of a group are dealt to blocks; a block's state
    is a table of k-mers by replicates, to which each sequence adds its weights, times the count, at the k-mers that it has:
    the work is that of the counts that are there, not of sequences by k-mers; k-mers that many of some sequences have are
    added for these together, a product of counts and weights. Of a block only sums of n and n ln n for each
    replicate go on. A replicate that draws no sequence has a null entropy.
    """
    parts = max(2, int(per.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(1, -(-per.select("kmer").distinct().count() // kmers))
    kind = per.schema[group].dataType.simpleString()
    rows = per.select(group, F.pmod(F.xxhash64("kmer"), F.lit(blocks)).alias("_block"), F.xxhash64(F.col(key).cast("string")).alias("_h"), "kmer", "n")
    rows = rows.repartition(parts, group, "_block").sortWithinPartitions(group, "_block", "_h")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, places, now, type_ = np.zeros((0, replicates), np.uint16), {}, None, pa.string()
        held, whole = np.zeros(0, np.int64), {}  # what a 16-bit count may have reached, and what has gone on to doubles

        def move(k: int) -> None:
            whole[k] = whole.get(k, 0.0) + state[k].astype(np.float64)
            state[k], held[k] = 0, 0

        def give() -> pa.RecordBatch:
            total, logs = np.zeros(replicates), np.zeros(replicates)
            for k in range(len(places)):
                n = state[k] + whole[k] if k in whole else state[k].astype(np.float64)
                total += n
                logs += n * np.log(np.maximum(n, 1))
            return pa.RecordBatch.from_arrays([pa.array([now[0]], type_), pa.array([total.tobytes()], pa.binary()), pa.array([logs.tobytes()], pa.binary())], names=[group, "total", "logs"])

        for name, run, new in _runs(batches, 2):
            if new and now is not None:
                yield give()
            if new:
                now, places, type_ = name, {}, run.column(0).type
                state[:], held[:] = 0, 0
                whole.clear()
            words = run.column(3).dictionary_encode()
            known = np.array([places.setdefault(w, len(places)) for w in words.dictionary.to_pylist()], np.int64)
            at, seqs, ns = known[words.indices.to_numpy()], *(run.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
            if len(places) > len(state):
                more = max(len(places), 2 * len(state)) - len(state)
                state, held = np.concatenate([state, np.zeros((more, replicates), np.uint16)]), np.concatenate([held, np.zeros(more, np.int64)])
            ids, row = np.unique(seqs, return_inverse=True)
            order = np.lexsort((ns, row))
            at, row, ns = at[order], row[order], ns[order]
            for lo in range(0, len(ids), ROWS):
                own = slice(*np.searchsorted(row, [lo, lo + ROWS]))
                w = weights(ids[lo : lo + ROWS], replicates, seed).astype(np.uint16)
                at_, row_, ns_ = at[own], row[own] - lo, ns[own]
                added = np.bincount(at_, ns_, len(state)).astype(np.int64) * int(w.max(initial=0))
                dense = (np.bincount(at_, minlength=len(state)) >= max(2, DENSE * len(w))) & (added < EXACT)
                if dense.any():
                    ks, mine = np.flatnonzero(dense), dense[at_]
                    counts = np.zeros((len(ks), len(w)), np.float32)
                    np.add.at(counts, (np.searchsorted(ks, at_[mine]), row_[mine]), ns_[mine].astype(np.float32))
                    for k, sums in zip(ks.tolist(), counts @ w.astype(np.float32), strict=True):
                        if k in whole:
                            whole[k] += sums
                        else:
                            whole[k] = sums.astype(np.float64)
                    at_, row_, ns_ = at_[~mine], row_[~mine], ns_[~mine]
                    added[ks] = 0
                for k in np.flatnonzero(held + added > FULL).tolist():
                    move(k)
                large = added > FULL
                held += np.where(large, 0, added)
                last: tuple[int, int] | None = None
                for k, r, n in zip(at_.tolist(), row_.tolist(), ns_.tolist(), strict=True):
                    if large[k]:
                        whole[k] += w[r] * float(n)
                        continue
                    if last != (r, n):
                        times, last = w[r] if n == 1 else w[r] * np.uint16(n), (r, n)
                    state[k] += times
        if now is not None:
            yield give()

    summed = _added(rows.mapInArrow(count, f"{group} {kind}, total binary, logs binary"), group, ["total", "logs"])
    got = _unfolded(summed, group, ["total", "logs"])
    return got.select(group, "replicate", "total", F.when(F.col("total") > 0, F.greatest(F.ln("total") - F.col("logs") / F.col("total"), F.lit(0.0))).alias("shannon"))
