"""Trees grown on counts: rows of one class whose values fall into the same bins are one cell, so that growing does not depend on how many rows there are.

A row's part in a tree is a draw for each row; what the rows of a cell draw together is one draw (of Poisson or binomial numbers),
so trees on cells are as good as trees on rows, not trees on fewer rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import materialise

#: Bins of a variable at most.
BINS = 32
#: Rounds of boosting that are grown in passes over dealt cells, and the places that a task holds at most where more rounds are.
ROUNDS_IN_PASSES, PLACES = 3, 1 << 21


def cuts(df: DataFrame, variables: Sequence[str]) -> list[list[float]]:
    """For each variable the values that part its bins: halfway between its own where those are few, else at even shares of the rows, a thousandth off at most."""
    near = df.agg(*[F.approx_count_distinct(v).alias(v) for v in variables]).first()
    shares = df.approxQuantile(list(variables), [i / BINS for i in range(1, BINS)], 0.001)
    made = []
    for v, quantiles in zip(variables, shares, strict=True):
        values = sorted(r[0] for r in df.select(v).distinct().limit(BINS + 1).collect()) if near[v] < 2 * BINS else []  # no more than bins
        few = 0 < len(values) <= BINS
        made.append([(a + b) / 2 for a, b in zip(values, values[1:], strict=False)] if few else sorted(set(quantiles)))
    return made


def binned(df: DataFrame, variables: Sequence[str], at: Sequence[Sequence[float]]) -> DataFrame:
    """``df`` with the bin of each variable as _b0, _b1 and so on: how many cuts are smaller than the value."""
    edges = [[-np.inf, *(np.nextafter(c, np.inf) for c in (some or [0.0])), np.inf] for some in at]
    made = Bucketizer(splitsArray=[[float(x) for x in e] for e in edges], inputCols=list(variables), outputCols=[f"_b{i}" for i in range(len(at))]).transform(df)
    return made.withColumns({f"_b{i}": (F.col(f"_b{i}") if some else F.lit(0)).cast("int") for i, some in enumerate(at)})


def cells(df: DataFrame, d: int, *more: Column) -> DataFrame:
    """(_b0, ..., label, n): rows of each cell, and ``more`` of them."""
    return df.groupBy(*[f"_b{i}" for i in range(d)], F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"), *more)


def with_draws(cells: DataFrame, d: int, name: str, draw: Callable[[np.random.Generator, int], np.ndarray], seed: int) -> DataFrame:
    """Cells with ``draws``, what their rows draw together for each tree. A cell draws by its own key, so partitions do not matter."""
    parts = max(2, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = np.zeros(b.num_rows, np.uint64)
            for i in range(d + 1):
                key = key * np.uint64(BINS if i < d else 65536) + b.column(i).to_numpy().astype(np.uint64)
            rows = [draw(np.random.Generator(np.random.Philox(key=[k, seed])), n) for k, n in zip(key.tolist(), b.column(d + 1).to_pylist(), strict=True)]
            if rows:
                flat = np.concatenate(rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(rows[0]), pa.int32()), pa.array(flat))], names=[*b.schema.names, "draws"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema.fields)
    return materialise(cells.repartition(parts, *[f"_b{i}" for i in range(d)], "label").mapInArrow(run, f"{columns}, draws array<bigint>"), name)


@dataclass
class Trees:
    """Trees side by side, their nodes numbered from 1, the children of i being 2i and 2i + 1; a leaf's ``feature`` is -1."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    stats: np.ndarray

    @classmethod
    def empty(cls, n: int, depth: int, size: int) -> Trees:
        nodes = 2 << depth
        return cls(np.full((n, nodes), -1), np.zeros((n, nodes), int), np.zeros((n, nodes)), np.zeros((n, nodes, size)))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each cell in each tree."""
        trees = np.arange(len(self.feature))
        node = np.ones((len(bins), len(trees)), int)
        while True:
            f = self.feature[trees, node]
            if (f < 0).all():
                return node
            right = np.take_along_axis(bins, np.maximum(f, 0), axis=1) > self.cut[trees, node]
            node = np.where(f < 0, node, 2 * node + right)

    def importances(self, size: Callable[[np.ndarray], np.ndarray], d: int, even: bool) -> np.ndarray:
        """Share of each variable in the gains, weighed by the size of their nodes; ``even``: trees count alike."""
        weighed = np.where(self.feature >= 0, self.gain * size(self.stats), 0.0)
        each = np.stack([np.where(self.feature == f, weighed, 0.0).sum(axis=1) for f in range(d)], axis=1)
        if even:
            each = each / np.maximum(each.sum(axis=1, keepdims=True), np.finfo(float).tiny)
        total = each.sum(axis=0)
        return total / total.sum() if total.sum() > 0 else total


def bins_of(b: pa.RecordBatch, d: int) -> np.ndarray:
    return np.stack([b.column(f"_b{i}").to_numpy() for i in range(d)], axis=1).astype(int)


Stats = Callable[[pa.RecordBatch, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]
Impurity = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def best_cuts(h: np.ndarray, impurity: Impurity) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gains, weights of nodes, sums left of each cut, right of it) of sums by (variable, node, bin, place)."""
    left = h.cumsum(axis=2)
    total = left[:, :, -1:]
    right = total - left
    (w, i), (wl, il), (wr, ir) = impurity(total), impurity(left), impurity(right)
    gain = np.where((wl > 0) & (wr > 0), i - (wl * il + wr * ir) / np.maximum(w, np.finfo(float).tiny), -1.0)
    return gain, w[0, :, 0], left, right


def grow(cells: DataFrame, d: int, n: int, depth: int, size: int, stats: Stats, impurity: Impurity, tried: int, seed: int) -> Trees:
    """``n`` trees in step, a pass over the cells for each level.

    ``stats`` gives what a cell adds: pairs of a place among ``size`` and a number for each tree. ``impurity`` gives weight and
    impurity of such sums. A node takes the best cut of ``tried`` variables drawn for it, if that gains anything. Tasks add up
    their cells, a tree's sums are added and its cuts chosen by one task; sums have a fixed size whatever the cells.
    """
    trees = Trees.empty(n, depth, size)
    for level in range(depth):
        width = 1 << level

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((d, n * width * BINS * size))
            of = np.arange(n)[None, :]
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    b = whole.slice(at, 4096)
                    bins = bins_of(b, d)
                    node = trees.leaves(bins)
                    live = node >= width
                    base = ((of * width + node - width) * BINS)[live]
                    for place, x in stats(b, bins):
                        slot, x = np.broadcast_to(place, node.shape)[live], x[live]
                        for f in range(d):
                            held[f] += np.bincount((base + np.broadcast_to(bins[:, f : f + 1], node.shape)[live]) * size + slot, x, held.shape[1])
            each = held.reshape(d, n, -1).transpose(1, 0, 2).reshape(n, -1)
            some = np.flatnonzero(each.any(axis=1))
            if len(some):
                ends = pa.array(np.arange(len(some) + 1) * each.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(each[some].ravel()))], names=["tree", "sums"])

        def choose(parts: pa.Table) -> pa.Table:
            tree = parts.column("tree")[0].as_py()
            h = sum(c.flatten().to_numpy().reshape(len(c), -1).sum(axis=0) for c in parts.column("sums").chunks).reshape(d, width, BINS, size)
            gain, w, left, right = best_cuts(h, impurity)
            rows = []
            for node in np.flatnonzero(w > 0).tolist():
                own = np.sort(np.random.default_rng([seed, tree, width + node]).permutation(d)[:tried])
                best = gain[own, node]
                f, cut = np.unravel_index(best.argmax(), best.shape)
                f = int(own[f])
                rows.append((tree, width + node, f if gain[f, node, cut] > 0 else -1, int(cut), float(gain[f, node, cut]), left[f, node, cut].tolist(), right[f, node, cut].tolist()))
            names, types = ["tree", "node", "feature", "cut", "gain", "l", "r"], [pa.int32()] * 4 + [pa.float64()] + [pa.list_(pa.float64())] * 2
            return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, types, strict=True)], names=names)

        added = cells.mapInArrow(sums, "tree int, sums array<double>")
        found = added.groupBy("tree").applyInArrow(choose, "tree int, node int, feature int, cut int, gain double, l array<double>, r array<double>").collect()  # a row for each tree and node
        for r in found:
            l_, r_ = np.array(r["l"]), np.array(r["r"])
            trees.stats[r["tree"], r["node"]] = l_ + r_
            if r["feature"] >= 0:
                trees.feature[r["tree"], r["node"]], trees.cut[r["tree"], r["node"]], trees.gain[r["tree"], r["node"]] = r["feature"], r["cut"], r["gain"]
                trees.stats[r["tree"], 2 * r["node"]], trees.stats[r["tree"], 2 * r["node"] + 1] = l_, r_
        if not any(r["feature"] >= 0 for r in found):
            break
    return trees


@dataclass
class Forest:
    """Trees whose leaves vote by the shares of their classes; ``weights``: what a row of each class weighs."""

    trees: Trees
    weights: np.ndarray

    def importances(self, d: int) -> np.ndarray:
        return self.trees.importances(lambda s: s @ self.weights, d, True)

    def score(self, cells: DataFrame, d: int) -> DataFrame:
        """Cells with ``p``, the chance of each class."""
        votes = self.trees.stats * self.weights
        votes = votes / np.maximum(votes.sum(axis=2, keepdims=True), np.finfo(float).tiny)
        columns, trees = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema.fields), self.trees

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    b = whole.slice(at, 4096)
                    p = votes[np.arange(len(votes)), trees.leaves(bins_of(b, d))].mean(axis=1)
                    ends = pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], names=[*b.schema.names, "p"])

        return cells.mapInArrow(run, f"{columns}, p array<double>")


def forest(cells: DataFrame, d: int, weights: Sequence[float], trees: int, depth: int, seed: int) -> Forest:
    """A forest of class trees: each row enters a tree a Poisson number of times, a node tries the root of the variables (all, of one tree), siblings of one answer are one leaf."""
    k, w = len(weights), np.array(weights, float)
    drawn = with_draws(cells, d, "forest-cells", lambda rng, n: rng.poisson(n, trees), seed)

    def stats(b: pa.RecordBatch, bins: np.ndarray) -> list:
        return [(b.column("label").to_numpy()[:, None], b.column("draws").flatten().to_numpy().reshape(-1, trees))]

    def impurity(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = s * w
        total = x.sum(axis=-1)
        return total, 1 - (x * x).sum(axis=-1) / np.maximum(total * total, np.finfo(float).tiny)

    made = grow(drawn, d, trees, depth, k, stats, impurity, d if trees == 1 else int(np.ceil(d**0.5)), seed)
    answer = (made.stats * w).argmax(axis=2)
    for node in reversed(range(1, 1 << depth)):
        a, b = 2 * node, 2 * node + 1
        same = (made.feature[:, node] >= 0) & (made.feature[:, a] < 0) & (made.feature[:, b] < 0) & (answer[:, a] == answer[:, b])
        made.feature[same, node] = -1
    return Forest(made, w)


def _spread(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight and variance of sums of weights, of numbers and of their squares."""
    w = np.where(s[..., 0] > 0.5, s[..., 0], 0.0)  # whole numbers
    own = np.maximum(w, 1.0)
    return w, np.maximum(s[..., 2] / own - (s[..., 1] / own) ** 2, 0.0)


def boost(cells: DataFrame, d: int, k: int, rounds: int, depth: int, step: float, share: float, seed: int) -> list[np.ndarray]:
    """Importances of boosted trees for each of ``k`` classes against the rest, logistic loss: the first tree fits the class (1 or -1), each later one the slope of the loss, and adds ``step`` of what it says.

    Rounds follow one another, so many of them in passes would be a job for each level of each. Cells of equal bins are one
    place, at most BINS^variables however many rows there are: up to ``PLACES`` of them a class's trees are one task's.
    """
    if rounds > ROUNDS_IN_PASSES:
        bins, yes = [f"_b{i}" for i in range(d)], F.col("label") == F.col("of")
        each = cells.select(*bins, "label", "n", F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("of")).groupBy("of", *bins)
        places = materialise(each.agg(F.sum(F.when(yes, F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(yes, 0).otherwise(F.col("n"))).alias("no")), "boost-places")
        if places.count() <= k * PLACES:

            def run(part: pa.Table) -> pa.Table:
                of, at = part.column("of")[0].as_py(), np.stack([part.column(b).to_numpy() for b in bins], axis=1).astype(int)
                order = np.lexsort(at.T)
                gains = boosted(at[order], part.column("yes").to_numpy()[order], part.column("no").to_numpy()[order], rounds, depth, step, share, [seed, of])
                return pa.table([pa.array([of], pa.int32()), pa.array([gains.tolist()], pa.list_(pa.float64()))], names=["of", "gains"])

            got = {r["of"]: np.array(r["gains"]) for r in places.repartitionByRange(k, "of").groupBy("of").applyInArrow(run, "of int, gains array<double>").collect()}  # a row for each class
            return [got.get(i, np.zeros(d)) for i in range(k)]
    return _boost_in_passes(cells, d, k, rounds, depth, step, share, seed)


def boosted(bins: np.ndarray, yes: np.ndarray, no: np.ndarray, rounds: int, depth: int, step: float, share: float, seed: Sequence[int]) -> np.ndarray:
    """Importances of the boosted trees of a class, of places with ``yes`` rows of the class and ``no`` others: what ``boost`` says, a tree after the other."""
    d, gains, says, flat = bins.shape[1], np.zeros(bins.shape[1]), np.zeros(len(bins)), [np.ascontiguousarray(bins[:, f]) for f in range(bins.shape[1])]
    for m in range(rounds):
        rng = np.random.default_rng([*seed, m])
        mine, others = rng.binomial(yes, share).astype(float), rng.binomial(no, share).astype(float)
        up, down = (4 / (1 + np.exp(2 * says)), -4 / (1 + np.exp(-2 * says))) if m else (np.ones(len(bins)), -np.ones(len(bins)))
        sums = [mine + others, mine * up + others * down, mine * up * up + others * down * down]
        live, slot = np.arange(len(bins)), np.zeros(len(bins), int)  # places in nodes that may be cut, and which of the level's
        value, n_nodes = np.array([sums[1].sum() / max(sums[0].sum(), 1.0)]), 1
        said = np.full(len(bins), value[0])
        for _ in range(depth):
            base, mass = slot * BINS, [x[live] for x in sums]
            h = np.empty((d, n_nodes, BINS, 3))
            for f in range(d):
                at = base + flat[f][live]
                for j in range(3):
                    h[f, ..., j] = np.bincount(at, mass[j], n_nodes * BINS).reshape(n_nodes, BINS)
            gain, w, left, right = best_cuts(h, _spread)
            own = gain.transpose(1, 0, 2).reshape(n_nodes, -1)
            best = own.argmax(axis=1)
            f, cut, won = best // BINS, best % BINS, own[np.arange(n_nodes), best]
            cuts = (w > 0) & (won > 0)
            if not cuts.any():
                break
            np.add.at(gains, f[cuts], won[cuts] * w[cuts])
            ends = np.stack([x[f[cuts], np.flatnonzero(cuts), cut[cuts]] for x in (left, right)], axis=1).reshape(-1, 3)
            value, first = ends[:, 1] / np.maximum(ends[:, 0], 1.0), np.cumsum(cuts) * 2 - 2  # children side by side
            on = cuts[slot]
            live, slot = live[on], slot[on]
            slot = first[slot] + (bins[live, f[slot]] > cut[slot])
            said[live], n_nodes = value[slot], len(value)
        says += said * (step if m else 1.0)
    return gains / gains.sum() if gains.sum() > 0 else gains


def _boost_in_passes(cells: DataFrame, d: int, k: int, rounds: int, depth: int, step: float, share: float, seed: int) -> list[np.ndarray]:
    """``boost`` over dealt cells, whatever their number, a pass for each level of each round."""
    drawn = with_draws(cells, d, "boost-cells", lambda rng, n: rng.binomial(n, share, rounds), seed)
    grown: list[Trees] = []

    for m in range(rounds):
        says = [t.stats[..., 1] / np.maximum(t.stats[..., 0], 1.0) * (step if i else 1.0) for i, t in enumerate(grown)]

        def stats(b: pa.RecordBatch, bins: np.ndarray, m=m, says=says) -> list:
            y = np.where(b.column("label").to_numpy()[:, None] == np.arange(k)[None, :], 1.0, -1.0)
            goal = y
            if m:
                f = sum(s[np.arange(k), t.leaves(bins)] for s, t in zip(says, grown, strict=True))
                goal = 4 * y / (1 + np.exp(2 * y * f))
            w = b.column("draws").flatten().to_numpy().reshape(-1, rounds)[:, m : m + 1].astype(float)
            return [(np.array(0), np.broadcast_to(w, y.shape)), (np.array(1), w * goal), (np.array(2), w * goal * goal)]

        grown.append(grow(drawn, d, k, depth, 3, stats, _spread, d, seed + m))
    one = lambda i: Trees(*[np.stack([getattr(t, a)[i] for t in grown]) for a in ("feature", "cut", "gain", "stats")])
    return [one(i).importances(lambda s: s[..., 0], d, False) for i in range(k)]
