"""Grouping of spelling variants: words one edit apart, found by k-d trees over their counts of letters.

One edit changes the letter counts of a word by an L1 distance of at most two: a replaced letter is one more and one
fewer, an inserted one is one more. Words of each length have a tree of their own, whose boxes are the cells that tasks
work on; a word is sent to every cell of its own length and of the next whose box it can reach, and there a finer tree
finds the words at the right distance, of which the order of letters is checked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, col, materialise, parts_of

#: Words in a cell, about: cuts come from a sample.
CELL = 16_384
#: Words in a leaf of the tree within a cell.
LEAF = 128
#: Cells of all lengths together, at most (cells are larger beyond that), and sampled words for each.
CELLS, SAMPLED = 8_192, 32
#: Pairs of letters compared at a time.
AT_ONCE = 4_000_000
WORD = r"[A-Za-zÀ-ÿ]"


@dataclass
class Tree:
    """A k-d tree: inner node i sends points with at most ``cut[i]`` in ``dim[i]`` to ``left[i]``, others to ``right[i]``; leaves have ``dim`` -1 and a number in ``cut``."""

    dim: list[int]
    cut: list[int]
    left: list[int]
    right: list[int]
    leaves: list[np.ndarray]

    @classmethod
    def grow(cls, points: np.ndarray, room: int) -> Tree:
        """Cuts where they halve the points best, until a leaf has ``room`` or all its points are equal."""
        tree, todo = cls([-1], [0], [0], [0], []), [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            own = points[at]
            if len(at) > room:
                middle = np.partition(own, len(at) // 2, axis=0)[len(at) // 2]
                below, upto = (own < middle).sum(axis=0), (own <= middle).sum(axis=0)
                halves = np.stack([np.minimum(below, len(at) - below), np.minimum(upto, len(at) - upto)])
                which, j = np.unravel_index(int(halves.argmax()), halves.shape)
                if halves[which, j]:
                    cut = int(middle[j]) - 1 + int(which)
                    tree.dim[node], tree.cut[node] = int(j), cut
                    tree.left[node], tree.right[node] = len(tree.dim), len(tree.dim) + 1
                    for column in (tree.cut, tree.left, tree.right):
                        column += [0, 0]
                    tree.dim += [-1, -1]
                    goes = own[:, j] <= cut
                    todo += [(tree.left[node], at[goes]), (tree.right[node], at[~goes])]
                    continue
            tree.cut[node] = len(tree.leaves)
            tree.leaves.append(at)
        return tree

    def reach(self, points: np.ndarray, more: int, fewer: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``points``): the leaves whose box holds a place with up to ``more`` counts added to a point and ``fewer`` taken away."""
        n = len(points)
        far = 1 << 40
        todo = [(0, np.arange(n), np.zeros(n, int), np.zeros(n, int), {})]
        while todo:
            node, rows, up, down, box = todo.pop()
            j = self.dim[node]
            if j < 0:
                yield self.cut[node], rows
                continue
            low, high = box.get(j, (-far, far))
            x = points[rows, j].astype(np.int64)
            up0, down0 = up - np.maximum(low - x, 0), down - np.maximum(x - high, 0)
            for child, a, b in ((self.left[node], low, self.cut[node]), (self.right[node], self.cut[node] + 1, high)):
                u, d = up0 + np.maximum(a - x, 0), down0 + np.maximum(x - b, 0)
                ok = (u <= more) & (d <= fewer)
                if ok.any():
                    todo.append((child, rows[ok], u[ok], d[ok], {**box, j: (a, b)}))


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _counts(letters: np.ndarray, dims: np.ndarray) -> np.ndarray:
    """How often each word has each letter; ``dims`` numbers letters, those of no number of their own share the last."""
    n, width = len(letters), int(dims.max()) + 1
    cells = (np.arange(n)[:, None] * width + dims[letters]).reshape(-1)
    return np.bincount(cells, minlength=n * width).reshape(n, width).astype(np.int32)


def _numbered(letters: np.ndarray) -> np.ndarray:
    """A number for each of 256 code points: its place among ``letters``, or one past them all."""
    used = np.unique(letters)
    dims = np.full(256, len(used))
    dims[used] = np.arange(len(used))
    return dims


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters are one edit apart: as long and different in one place, or ``b`` longer by one inserted letter."""
    width = a.shape[1]
    if width == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(a == b[:, :width], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= width


class Cell:
    """The words of a cell under a tree, and the search for those that are one edit from others."""

    def __init__(self, words: list[str], counts: list[int]) -> None:
        self.words, self.counts = np.array(words, object), np.array(counts, np.int64)
        self.letters = _letters(words)
        self.dims = _numbered(self.letters)
        points = _counts(self.letters, self.dims)
        self.tree = Tree.grow(points, LEAF)
        self.points = points
        self.kind = np.float64 if self.letters.shape[1] > 2000 else np.float32  # exact sums of squares

    def near(self, letters: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of ``letters``, words of the cell) one edit apart; letters as long as the cell's words, or shorter by one. ``own``: of its own words, each pair once."""
        if not len(letters):
            return
        longer = self.letters.shape[1] - letters.shape[1]
        points = _counts(letters, self.dims)
        squares, held = (points.astype(self.kind) ** 2).sum(axis=1), []
        for leaf, rows in self.tree.reach(points, 1, 0 if longer else 1):
            at = self.tree.leaves[leaf]
            theirs = self.points[at].astype(self.kind)
            apart = squares[rows][:, None] + (theirs**2).sum(axis=1)[None, :] - 2 * (points[rows].astype(self.kind) @ theirs.T)
            x, y = np.nonzero(apart == (1 if longer else 2))
            x, y = rows[x], at[y]
            if own:
                x, y = x[x < y], y[x < y]
            step = max(1, AT_ONCE // self.letters.shape[1])
            for i in range(0, len(x), step):
                ok = one_edit(letters[x[i : i + step]], self.letters[y[i : i + step]])
                held.append((x[i : i + step][ok], y[i : i + step][ok]))
            if len(held) > 1000:
                yield tuple(np.concatenate(p) for p in zip(*held, strict=True))
                held = []
        if held:
            yield tuple(np.concatenate(p) for p in zip(*held, strict=True))


PAIRS = "a string, a_n long, b string, b_n long"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, asks, width, word, n) in this order: words of a cell, then the words that ask for their neighbours there."""
    names = ["a", "a_n", "b", "b_n"]

    def out(words: np.ndarray, counts: np.ndarray, cell: Cell, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for x, y in found:
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(words[x], pa.string()), pa.array(counts[x]), pa.array(cell.words[y], pa.string()), pa.array(cell.counts[y])], names=names)

    now, words, counts, cell = None, [], [], None
    for b in batches:
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        texts, ns = b.column(3), b.column(4).to_numpy(zero_copy_only=False)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            key, asks = keys[lo, 0], keys[lo, 1]
            if key != now:
                if words:
                    cell = Cell(words, counts)
                    yield from out(cell.words, cell.counts, cell, cell.near(cell.letters, True))
                now, words, counts, cell = key, [], [], None
            part = texts.slice(lo, hi - lo).to_pylist()
            if not asks:
                words += part
                counts += ns[lo:hi].tolist()
                continue
            if words:
                cell, words, counts = Cell(words, counts), [], []
                yield from out(cell.words, cell.counts, cell, cell.near(cell.letters, True))
            if cell is not None:
                yield from out(np.array(part, object), ns[lo:hi], cell, cell.near(_letters(part), False))
    if words:
        cell = Cell(words, counts)
        yield from out(cell.words, cell.counts, cell, cell.near(cell.letters, True))


def one_edit_pairs(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words of (word, n) that are one inserted, deleted or replaced code point apart, once.

    ``words`` are distinct, not null and hold code points up to U+00FF. A pair is found in one cell: that of the longer
    word, or, of words as long, the cell that comes last, where a word asks if its own comes before.
    """
    parts = parts_of(words)
    sizes = words.groupBy(F.char_length("word").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.agg(F.sum("n")).first()[0] or 0
    room = max(min(cell, whole // (4 * parts)), whole // CELLS, 64)
    large = sizes.where(F.col("n") > room)  # a row for each cell at most
    shares = {r["width"]: r["n"] for r in large.collect()}
    share = min(1.0, SAMPLED / room)
    picked = words.join(F.broadcast(large.select(F.col("width").alias("_w"))), F.char_length("word") == F.col("_w"))
    drawn: dict[int, list[str]] = {}
    for (w,) in picked.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("word").collect():  # CELLS x SAMPLED on average
        drawn.setdefault(len(w), []).append(w)
    trees = {}
    for width, sample in drawn.items():
        letters = _letters(sorted(sample))
        dims = _numbered(letters)
        tree = Tree.grow(_counts(letters, dims), max(1, room * len(sample) // shares[width]))
        tree.leaves = [np.zeros(0, int)] * len(tree.leaves)
        trees[width] = dims, tree
    held = words.sparkSession.sparkContext.broadcast(trees)  # CELLS leaves at most

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = np.array(b.column(0).to_pylist(), object)
            lengths = np.array([len(w) for w in texts], np.int64)
            cells, asks, rows = [], [], []

            def send(width: int, leaf: np.ndarray | int, at: np.ndarray, ask: int) -> None:
                cells.append(np.full(len(at), width << 24, np.int64) + leaf)  # noqa: B023
                asks.append(np.full(len(at), ask))  # noqa: B023
                rows.append(at)  # noqa: B023

            for width in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == width)
                letters = _letters(texts[at].tolist())
                home = np.zeros(len(at), np.int64)
                if width in held.value:
                    dims, tree = held.value[width]
                    points = _counts(letters, dims)
                    for leaf, own in tree.reach(points, 0, 0):
                        home[own] = leaf
                    for leaf, own in tree.reach(points, 1, 1):
                        send(width, leaf, at[own[home[own] < leaf]], 1)
                send(width, home, at, 0)
                if width + 1 in held.value:
                    dims, tree = held.value[width + 1]
                    for leaf, own in tree.reach(_counts(letters, dims), 1, 0):
                        send(width + 1, leaf, at[own], 1)
                else:
                    send(width + 1, 0, at, 1)
            at = np.concatenate(rows) if rows else np.zeros(0, int)
            cols = [pa.array(np.concatenate(cells)) if rows else pa.array([], pa.int64()), pa.array((np.concatenate(asks) if rows else at).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lengths[at].astype(np.int32)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], names=["cell", "asks", "width", "word", "n"])

    routed = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(route, "cell long, asks int, width int, word string, n long")
    return routed.repartition(parts, "cell").sortWithinPartitions("cell", "asks", "width").mapInArrow(_search, PAIRS)


def corpus_words(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = 7, least_count: int = 2, drop_every: int | None = None) -> DataFrame:
    """(word, n): maximal runs of Latin letters, A-Z lower-cased, of at least so many letters that occur so often in all texts.

    With ``drop_every``, runs whose crc32 of ``<key>:<run>`` it divides lose a letter first, at that number modulo their
    length; rows of a null key lose none. Null texts hold no words; repeated rows count again. Other columns are not read.
    """
    runs = docs.select(col(key).cast("string").alias("k"), F.explode(F.regexp_extract_all(ascii_lower(col(text)), F.lit(WORD + "{%d,}" % least_length), F.lit(0))).alias("run"))
    word: Column = F.col("run")
    if drop_every:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "k", "run").cast("binary")))
        place = (F.col("h") % F.char_length("run")).cast("int")
        cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.char_length("run")))
        word = F.when(F.col("k").isNotNull() & (F.col("h") % drop_every == 0), cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def group_variants(words: DataFrame, ratio: int = 10, cell: int = CELL) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of (word, n): its neighbours at one edit, and the spelling it stands for.

    A word's form is its most frequent neighbour, the smallest of equal ones, if that occurs ``ratio`` times as often at
    least (more than once as often); its root is where forms lead. Forms grow by ``ratio`` at each step, so there is no
    way round, and doubling the steps ends after a few rounds. An empty table gives no rows.
    """
    words = materialise(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = one_edit_pairs(words, cell)
    sides = F.array(F.struct(F.col("a").alias("_word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("_word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = pairs.select(F.inline(sides)).groupBy("_word").agg(F.count(F.lit(1)).alias("near_count"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("top"))
    far = -F.col("top.m") >= F.col("n") * ratio
    got = words.join(best, F.col("word") == F.col("_word"), "left").select("word", "n", F.coalesce("near_count", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("top.near")).alias("form"), F.when(far, -F.col("top.m")).alias("form_n"))
    got = materialise(got, "spelling-forms")
    steps = got.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = materialise(steps.join(ahead, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "spelling-roots")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    roots = steps.select(F.col("word").alias("_word"), "root")
    return got.join(roots, F.col("word") == F.col("_word"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
