"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, survivors in double precision, heaps."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small

#: Queries of one block, which a task holds with their heaps.
QUERY_BLOCK = 2048
#: Candidates of one part: at least so many where there are, and at most.
PART, MOST = 2048, 1 << 20
#: Candidates that a block meets at a time: a tile of QUERY_BLOCK x TILE products.
TILE = 1024
#: Pairs that are recomputed at once.
PAIRS = 1 << 12


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, dim, v): vectors in double precision, without those that are null or zero or hold null or non-finite components."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(fine).withColumn("dim", F.size("v"))


class Int8Block:
    """Vectors as int8 steps of their own scale, with the length of what rounding left out."""

    def __init__(self, x: np.ndarray):
        with np.errstate(all="ignore"):
            self.x = x
            self.scale = np.abs(x).max(axis=1) / 127
            steps = np.rint(x / np.maximum(self.scale, 1e-300)[:, None]).clip(-127, 127).astype(np.int8)
            back = steps * self.scale[:, None]
            self.left = np.linalg.norm(x - back, axis=1)
            self.norm = np.linalg.norm(back, axis=1)
        # Products of int8 steps are whole numbers; single precision holds their sums exactly up to 2**24.
        self.steps = steps.astype(np.float32 if x.shape[1] <= 1000 else np.float64)

    def bounds(self, other: Int8Block) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of the int8 vectors, and how far the true ones can be from them."""
        with np.errstate(all="ignore"):
            near = (self.steps @ other.steps.T) * self.scale[:, None] * other.scale
            error = self.norm[:, None] * other.left + self.left[:, None] * (other.norm + other.left)
            return near, error * (1 + 1e-9) + np.abs(near) * 1e-12


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed from the first component to the last."""
    with np.errstate(all="ignore"):
        return np.add.accumulate(x * y, axis=1)[:, -1]


class QueryBlock:
    """A block of queries, each with a heap of its k best (score, -id) so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.block, self.k = ids, Int8Block(x), k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.worst = np.full(len(ids), -np.inf)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        # Equal vectors tie, and ties go to smaller ids: of each no more than k, and the query itself, can matter.
        order = np.lexsort((ids, *x.T))
        ids, x = ids[order], x[order]
        starts = np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])
        place = np.arange(len(ids)) - np.maximum.accumulate(np.where(starts, np.arange(len(ids)), 0))
        ids, x = ids[place <= self.k], x[place <= self.k]
        near, error = self.block.bounds(Int8Block(x))
        own = self.ids[:, None] == ids
        low = np.where(own, -np.inf, near - error)
        limit = self.worst
        if len(ids) > self.k:
            limit = np.fmax(limit, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        rows, cols = np.nonzero(~own & ~(near + error < limit[:, None]))
        for at in range(0, len(rows), PAIRS):
            r, c = rows[at : at + PAIRS], cols[at : at + PAIRS]
            for q, score, other in zip(r.tolist(), inner_products(self.block.x[r], x[c]).tolist(), (-ids[c]).tolist(), strict=True):
                heap = self.heaps[q]
                if len(heap) < self.k:
                    heapq.heappush(heap, (score, other))
                elif (score, other) > heap[0]:
                    heapq.heapreplace(heap, (score, other))
        self.worst = np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.heaps])

    def found(self) -> pa.RecordBatch:
        rows = [(int(q), -i, s) for q, h in zip(self.ids, self.heaps, strict=True) for s, i in h]
        q, i, s = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each query row, exactly.

    ``is_query`` is a condition on ``id``. Nearest first, ties to the smaller id; a query meets every row but those
    of its own id; fewer candidates give fewer rows. Vectors that are null, zero or hold null or
    non-finite components take no part, and vectors meet only those of their own length. Of rows
    that repeat a query's id one asks, all are found. No rows give no rows; other columns are not read.

    Cells of a query block and a part of the candidates are dealt to tasks; a task holds one block
    of queries and streams candidates past it, so neither side is ever held whole.
    """
    spark = vectors.sparkSession
    clean = usable(vectors, vec_id, embedding)
    queries = clean.where(is_query).groupBy("id", "dim").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // query_block))
    n = clean.count()
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(1, -(-n // MOST), min(-(-n // PART), -(-tasks // blocks)))
    q = queries.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "dim", F.lit(0).alias("side"), "id", "v")
    c = clean.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qb"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("part"), "dim", F.lit(1).alias("side"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asking, xs, ids = None, None, [], []
        for b in small(batches, TILE):
            key = np.stack([b.column(n).to_numpy() for n in ("qb", "part", "dim", "side")])
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [b.num_rows]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                new = tuple(key[:3, lo].tolist())
                if new != cell:
                    if asking:
                        yield asking.found()
                    cell, asking, xs, ids = new, None, [], []
                x = b.column("v").slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, cell[2])
                some = b.column("id").slice(lo, hi - lo).to_numpy()
                if key[3, lo] == 0:
                    xs.append(x)
                    ids.append(some)
                    continue
                if xs:
                    asking, xs = QueryBlock(np.concatenate(ids), np.concatenate(xs), k), []
                if asking:
                    asking.meet(some, x)
        if asking:
            yield asking.found()

    dealt = q.unionByName(c).repartition(max(2, min(parts * blocks, 4 * tasks)), "qb", "part", "dim").sortWithinPartitions("qb", "part", "dim", "side")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
