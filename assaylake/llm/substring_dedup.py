"""Substring dedup: broadcast suffix automata of reference shards, past which documents stream for matching statistics.

A document need not meet all automata. Of every window of words one run of a third of its length,
chosen by its hash, is an anchor, and equal windows have equal anchors. So anchors route: only the
surroundings of anchors that occur in several documents become references, each distinct one once,
from its smallest document; a shard holds the references of a share of the anchors, and of a document
the parts around a shard's anchors stream past that shard's automaton. Which windows are equal, and
whether an earlier document has them, the automata say. Shards are of bounded size and are broadcast
in waves of bounded size, so neither the driver nor a task holds more however large the corpus.
"""

from __future__ import annotations

import gc
import hashlib
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialise, packed, parts_of, small

WINDOW = 50
#: References of one anchor; anchors of more are split by longer common parts, and in the end stand for one window each.
SHARD = 2048
#: Words of the references of one shard on average, shards of a wave, and bytes of automata that are broadcast at once.
SHARD_WORDS, WAVE_SHARDS, WAVE_BYTES = 200_000, 64, 64 << 20
#: Waves at once. With more, the next begins while one ends with few tasks, but workers unpack automata of each anew.
WAVES_AT_ONCE = 1
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64)] * 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(2 * n, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


class _Hashes(dict):
    """Words come again and again, so their hashes are remembered, within bounds."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # ASCII white space only


def anchors(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, positions, lo, hi): of each window the run of a third of its length with the least hash, the first of equals.

    The windows whose anchor it is start lo to hi words before it.
    """
    gram, n = window // 3, len(words)
    if n < window:
        return np.zeros(0, np.int64), *(np.zeros(0, np.int64),) * 3
    up, down = _powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n) * up[:n])])
    g = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    best, have = np.arange(len(g)), 1  # where the least of the next ``have`` is
    while have < window - gram + 1:
        step = min(have, window - gram + 1 - have)
        x, y = best[:-step], best[step:]
        best = np.where(g[y] < g[x], y, x)
        have += step
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    last = np.concatenate([first[1:], [len(best)]]) - 1
    at = best[first]
    return g[at].view(np.int64), at, at - last, at - first


class SuffixAutomaton:
    """All word sequences of its references, each with the smallest document; references come in order of document.

    Nearly all states have one way on, kept in lists; only the ways beyond it are dictionaries.
    """

    def __init__(self):
        self.words: dict[bytes, int] = {}
        self.docs: list[int] = []
        self.word, self.to, self.more = [-1], [0], {}
        self.link, self.length, self.doc = [-1], [0], [0]

    def _split(self, p: int, q: int, w: int) -> int:
        """A state for what is shared of q's sequences, which ends them at p's."""
        word, to, more, clone = self.word, self.to, self.more, len(self.word)
        for column, value in ((word, word[q]), (to, to[q]), (self.link, self.link[q]), (self.length, self.length[p] + 1), (self.doc, self.doc[q])):
            column.append(value)
        if q in more:
            more[clone] = dict(more[q])
        while p >= 0:
            if word[p] == w:
                if to[p] != q:
                    break
                to[p] = clone
            elif p in more and more[p].get(w) == q:
                more[p][w] = clone
            else:
                break
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[bytes], doc: int) -> None:
        if not self.docs or self.docs[-1] != doc:
            self.docs.append(doc)
        word, to, more, link, length, docs, known, own, last = self.word, self.to, self.more, self.link, self.length, self.doc, self.words, len(self.docs) - 1, 0
        for x in words:
            w = known.get(x)
            if w is None:
                w = known[x] = len(known)
            p, q = last, to[last] if word[last] == w else more[last].get(w) if last in more else None
            if q is not None:  # another reference has gone this way
                last = q if length[q] == length[p] + 1 else self._split(p, q, w)
                continue
            last = len(word)
            word.append(-1)
            to.append(0)
            link.append(0)
            length.append(length[p] + 1)
            docs.append(own)
            while p >= 0:
                if word[p] < 0:
                    word[p], to[p] = w, last
                elif word[p] == w:
                    q = to[p]
                elif p not in more:
                    more[p] = {w: last}
                elif (q := more[p].get(w)) is None:
                    more[p][w] = last
                if q is not None:
                    link[last] = q if length[q] == length[p] + 1 else self._split(p, q, w)
                    break
                p = link[p]

    def pack(self) -> bytes:
        """The automaton as flat arrays, compressed. Ways mostly lead to the next state, so they are kept as steps."""
        ways = list(self.more.values())
        more = np.repeat(np.fromiter(self.more, np.int64), np.fromiter(map(len, ways), np.int64)), *(list(chain.from_iterable(x)) for x in (ways, map(dict.values, ways)))
        step = np.array(self.to, np.int64) - np.arange(len(self.to))
        arrays = self.word, step, *more, [0, *self.link[1:]], self.length, self.doc
        parts = [np.array(self.docs, "<i8").tobytes(), *(np.asarray(x, np.int64).astype("<u4").tobytes() for x in arrays), b" ".join(self.words)]
        return zstandard.compress(struct.pack("<10Q", *map(len, parts)) + b"".join(parts), 1)


class Matcher:
    """A packed automaton, past which sequences of words stream."""

    def __init__(self, packed: bytes):
        blob, parts, at = zstandard.decompress(packed), [], 80
        for n in struct.unpack_from("<10Q", blob):
            parts.append(memoryview(blob)[at : at + n])
            at += n
        self.docs = parts[0].cast("q")
        self.word, self.link, self.length, self.doc = (parts[i].cast("I") for i in (1, 6, 7, 8))
        step, *more = (np.frombuffer(parts[i], "<u4") for i in (2, 3, 4, 5))
        self.to = memoryview(step + np.arange(len(step), dtype="<u4"))
        words = bytes(parts[9]).split(b" ") if parts[9] else []
        self.n_words, self.words = len(words), {w: i for i, w in enumerate(words)}
        self.more = dict(zip((more[0].astype(np.int64) * len(words) + more[1]).tolist(), more[2].tolist(), strict=True))

    def spans(self, words: list[bytes], window: int, doc: int) -> list[tuple[int, int]]:
        """Maximal spans of ``words`` whose windows are all in documents before ``doc``.

        Reads them off the matching statistics: at each word how long a sequence that ends there is in the automaton.
        """
        word, to, more, link, length, n_words = self.word, self.to, self.more, self.link, self.length, self.n_words
        found: list[tuple[int, int]] = []
        v = n = 0
        start = end = -1
        for i, w in enumerate(map(self.words.get, words)):
            if w is None:
                v = n = 0
                continue
            while True:
                t = to[v] if word[v] == w else more.get(v * n_words + w, 0)
                if t:
                    v, n = t, n + 1
                    break
                if not v:
                    break
                v = link[v]
                n = length[v]
            if n >= window:
                while length[link[v]] >= window:
                    v = link[v]
                    n = length[v]
                if self.docs[self.doc[v]] < doc:
                    if i - window + 1 > end:
                        if end >= 0:
                            found.append((start, end))
                        start = i - window + 1
                    end = i + 1
        return [*found, (start, end)] if end >= 0 else found


def _digest(off: int, ctx: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b"%d " % off + ctx)


def _half(words: list[bytes], off: int, lo: int, hi: int, window: int) -> tuple | None:
    """Of a reference, with ``off`` words before its anchor, the windows that start lo to hi before it: (cid, key, lo, hi, ctx, off).

    The key is a hash of the words that all such windows share. None if there are none.
    """
    least, most = max(lo, off - len(words) + window), min(hi, off)
    if least > most:
        return None
    ctx = b" ".join(words[off - most : off - least + window])
    key = xxhash.xxh64_intdigest(b" ".join(words[off - lo : off - hi + window]), lo * window + hi)
    return _digest(most, ctx), key - (1 << 64) if key >> 63 else key, lo, hi, ctx.decode(), most


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _routes(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, th, n_words, sha, anchors) of each row; th tells apart texts that share an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            n, sha, hashes, places = [], [], [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(text)
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                h, p, _, _ = anchors(words if i is not None else [], window)
                hashes.append(h)
                places.append(p)
            cols = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *cols], names=["doc_id", "th", "n_words", "sha", "hashes", "places"])

    return docs.mapInArrow(run, "doc_id long, th long, n_words long, sha string, hashes array<long>, places array<int>")


def _occurrences(shared: DataFrame, window: int) -> DataFrame:
    """(doc_id, th, pos, key, lo, hi, cid) of every shared anchor; cid stands for all that its windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "pos", "key", "lo", "hi", "cid"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for b in small(batches):
            for i, th, text, places in zip(*[b.column(c).to_pylist() for c in ("doc_id", "th", "text", "places")], strict=True):
                words, wanted = words_of(text), set(places)
                joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
                rows = []
                for key, pos, lo, hi in zip(*[x.tolist() for x in anchors(words, window)], strict=True):
                    if pos in wanted:
                        first = pos - hi
                        ctx = joined[ends[first - 1] if first else 0 : ends[pos - lo + window - 1] - 1]
                        rows.append((i, th, pos, key, lo, hi, _digest(hi, ctx)))
                yield _batch(rows, names, types)

    return shared.mapInArrow(run, "doc_id long, th long, pos int, key long, lo int, hi int, cid binary")


def _references(owners: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """The words of references that share their anchor with others, cut from the first document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cid", "key", "ctx", "off", "first", "large"]
        types = [pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_()]
        for b in small(batches):
            for i, text, cuts in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "cuts")], strict=True):
                words = words_of(text)
                rows = [(c["cid"], c["key"], b" ".join(words[c["pos"] - c["hi"] : c["pos"] - c["lo"] + window]).decode(), c["hi"], i, c["large"]) for c in cuts]
                yield _batch(rows, names, types)

    cuts = owners.groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "key", "lo", "hi", "cid", "large")).alias("cuts"))  # of one document
    texts = shared.select("doc_id", "th", "text").dropDuplicates(["doc_id", "th"])
    return texts.join(cuts, ["doc_id", "th"]).mapInArrow(run, "cid binary, key long, ctx string, off int, first long, large boolean")


def _refine(large: DataFrame, window: int) -> DataFrame:
    """The references of large shards, cut in two by where windows start, down to single windows: what each half shares is longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["parent", "cid", "key", "lo", "hi", "ctx", "off", "first"]
        types = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64()]
        for b in small(batches):
            rows = []
            for cid, lo, hi, ctx, off, first in zip(*[b.column(c).to_pylist() for c in ("cid", "lo", "hi", "ctx", "off", "first")], strict=True):
                mid = (lo + hi) // 2
                for half in ((lo, mid), (mid + 1, hi)):
                    if c := _half(ctx.encode().split(b" "), off, *half, window):
                        rows.append((cid, *c, first))
            yield _batch(rows, names, types)

    return large.mapInArrow(run, "parent binary, cid binary, key long, lo int, hi int, ctx string, off int, first long")


def _automata(references: DataFrame) -> DataFrame:
    """(shard, wave, n_bytes, automaton) from (shard, ctx, first): each shard is read in order of document, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, auto = None, None
        gc.disable()  # there are no cycles to find among so many states

        def made() -> pa.RecordBatch:
            blob = auto.pack()
            return _batch([(at, at // WAVE_SHARDS, len(blob), blob)], ["shard", "wave", "n_bytes", "automaton"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()])

        for b in small(batches):
            for shard, ctx, first in zip(*[b.column(c).to_pylist() for c in ("shard", "ctx", "first")], strict=True):
                if shard != at:
                    if auto:
                        yield made()
                    at, auto = shard, SuffixAutomaton()
                auto.add(ctx.encode().split(b" "), first)
        if auto:
            yield made()
        gc.enable()

    dealt = references.repartition(parts_of(references), "shard").sortWithinPartitions("shard", "first", "ctx")
    return dealt.mapInArrow(run, "shard int, wave int, n_bytes long, automaton binary")


def _regions(routed: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """(wave, shard, doc_id, th, at, part): what of each document streams past each shard, from (doc_id, th, pos, lo, hi, shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["wave", "shard", "doc_id", "th", "at", "part"], [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        for b in small(batches):
            for i, th, text, places in zip(*[b.column(c).to_pylist() for c in ("doc_id", "th", "text", "places")], strict=True):
                words, rows, held = words_of(text), [], None
                for shard, start, end in [*sorted((p["shard"], p["pos"] - p["hi"], p["pos"] - p["lo"] + window) for p in places), (-1, 0, 0)]:
                    if held and held[0] == shard and start <= held[2] - window + 1:
                        held[2] = max(held[2], end)
                        continue
                    if held:
                        rows.append((held[0] // WAVE_SHARDS, held[0], i, th, held[1], b" ".join(words[held[1] : held[2]]).decode()))
                    held = [shard, start, end]
                yield _batch(rows, names, types)

    places = routed.groupBy("doc_id", "th").agg(F.collect_list(F.struct("shard", "pos", "lo", "hi")).alias("places"))  # of one document
    texts = shared.select("doc_id", "th", "text").dropDuplicates(["doc_id", "th"])
    return texts.join(places, ["doc_id", "th"]).mapInArrow(run, "wave int, shard int, doc_id long, th long, at int, part string")


def _streamed(regions: DataFrame, held: Broadcast[dict[int, bytes]], window: int) -> DataFrame:
    """(doc_id, th, start, end): the words of regions that earlier documents have, by the automata of their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, matcher = None, None
        for b in small(batches, 1000):
            rows = []
            for shard, i, th, start, part in zip(*[b.column(c).to_pylist() for c in ("shard", "doc_id", "th", "at", "part")], strict=True):
                if shard != at:
                    at, matcher = shard, Matcher(held.value[shard])
                rows += [(i, th, start + a, start + e) for a, e in matcher.spans(part.encode().split(b" "), window, i)]
            yield _batch(rows, ["doc_id", "th", "start", "end"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])

    # Dealt by shard, so that few tasks unpack each automaton; Spark splits a shard that many documents meet.
    return regions.hint("rebalance", "shard").sortWithinPartitions("shard").mapInArrow(run, "doc_id long, th long, start int, end int")


def _within_bytes(sizes: list[tuple[int, int]]) -> Iterator[list[int]]:
    """The shards of (shard, bytes), as many at a time as are within ``WAVE_BYTES`` together, one at least."""
    shards, n = [], 0
    for shard, size in sorted(sizes):
        if shards and n + size > WAVE_BYTES:
            yield shards
            shards, n = [], 0
        shards.append(shard)
        n += size
    if shards:
        yield shards


def _matched(references: DataFrame, routed: DataFrame, shared: DataFrame, window: int, n_shards: int) -> DataFrame:
    """(doc_id, th, start, end) of all documents: waves of automata are built, broadcast, and streamed past, a few at once.

    A wave has ``WAVE_SHARDS`` shards at most, by number, so the driver knows the waves without a list of shards, and sees
    the sizes of a wave's shards only when its turn comes.
    """
    spark = shared.sparkSession
    automata = materialise(_automata(references), "automata", by="wave")
    regions = materialise(_regions(routed, shared, window), "regions", by="wave")

    def streamed(wave: int) -> list[str]:
        """The folders of what this wave found."""
        paths = []
        for shards in _within_bytes([(r["shard"], r["n_bytes"]) for r in automata.where(F.col("wave") == wave).select("shard", "n_bytes").collect()]):
            of_wave = (F.col("wave") == wave) & F.col("shard").isin(shards)
            some = automata.where(of_wave).select("shard", "automaton").toLocalIterator()
            held = spark.sparkContext.broadcast({r["shard"]: bytes(r["automaton"]) for r in some})  # WAVE_BYTES at most, or one shard
            paths.append(materialise(_streamed(regions.where(of_wave).drop("wave"), held, window), "matched").stored_at)
            held.destroy()
        return paths

    with ThreadPoolExecutor(WAVES_AT_ONCE) as pool:
        paths = [p for found in pool.map(streamed, range(-(-n_shards // WAVE_SHARDS))) for p in found]
    schema = "doc_id long, th long, start int, end int"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _plan(docs: DataFrame, text: str, doc_id: str, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The routes of all rows, the texts that share an anchor with others, and the word spans to remove from them."""
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"), F.xxhash64(F.coalesce(col(text), F.lit(""))).alias("th"))
    routes = materialise(_routes(rows, window), "routes")
    each = routes.select("doc_id", F.explode(F.arrays_zip("hashes", "places")).alias("a")).select("doc_id", F.col("a.hashes").alias("h"), F.col("a.places").alias("pos"))
    several = each.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")
    several = materialise(several, "shared-hashes")  # so that a join side is a plain shuffle, whose hot keys Spark can split
    places = each.join(several, "h").groupBy("doc_id").agg(F.collect_set("pos").alias("places"))  # of one document
    shared = materialise(rows.join(materialise(places, "shared-anchors"), "doc_id"), "sharing-texts")
    found = materialise(_occurrences(shared, window), "occurrences")

    owners = materialise(found.groupBy("key", "cid").agg(F.min(F.struct("doc_id", "th", "pos", "lo", "hi")).alias("o")).select("key", "cid", "o.*"), "reference-places")
    large = owners.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD).select("key")
    large = materialise(large, "large-keys")
    cut = materialise(_references(owners.join(large.withColumn("large", F.lit(True)), "key", "left").withColumn("large", F.coalesce("large", F.lit(False))), shared, window), "references")
    references = cut.where("NOT large").select("key", "ctx", "first")
    # What an anchor's only reference holds has no earlier document than that reference's own.
    alone = owners.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").select("key", "doc_id")
    routed = found.join(large, "key", "left_anti").join(alone, ["key", "doc_id"], "left_anti").select("doc_id", "th", "pos", "lo", "hi", "key")
    level = cut.where("large").select("cid", F.lit(0).alias("lo"), F.lit(window - window // 3).alias("hi"), "ctx", "off", "first")
    roots = None  # (root, cid): references and the parts that they were cut into
    while not level.isEmpty():
        halves = materialise(_refine(level, window), "halves")
        parents = halves.select("parent", "cid").distinct()
        roots = parents.withColumnRenamed("parent", "root") if roots is None else parents.join(roots.withColumnRenamed("cid", "parent"), "parent").select("root", "cid").distinct()
        roots = materialise(roots, "reference-parts")
        parts = materialise(halves.groupBy("key", "lo", "hi", "cid", "ctx", "off").agg(F.min("first").alias("first")), "parts")
        still = materialise(parts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD).select("key"), "large-shards")
        leaves = parts.join(still, "key", "left_anti")
        references = references.unionByName(leaves.select("key", "ctx", "first"))
        to = roots.join(leaves.select("key", "lo", "hi", "cid"), "cid").select(F.col("root").alias("cid"), F.col("key").alias("part_key"), F.col("lo").alias("part_lo"), F.col("hi").alias("part_hi"))
        narrow = F.greatest("lo", "part_lo").alias("lo"), F.least("hi", "part_hi").alias("hi")
        routed = routed.unionByName(found.join(to, "cid").select("doc_id", "th", "pos", *narrow, F.col("part_key").alias("key")))
        level = parts.join(still, "key", "left_semi").drop("key")
    n_words = owners.agg(F.sum(F.col("hi") - F.col("lo") + window)).first()[0] or 0
    n_shards = -(-n_words // SHARD_WORDS) or 1
    shard = F.pmod("key", F.lit(n_shards)).cast("int").alias("shard")
    spans = _matched(references.select(shard, "ctx", "first"), routed.select("doc_id", "th", "pos", "lo", "hi", shard), shared, window, n_shards)
    return routes, shared, spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # of one document


def kept_words(words: list[bytes], spans: list[dict]) -> list[bytes]:
    keep = np.ones(len(words), bool)
    for s in spans:
        keep[s["start"] : s["end"]] = False
    return [words[i] for i in np.flatnonzero(keep)]


def _cut(shared: DataFrame, spans: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows = []
            for i, th, text, cuts in zip(*[b.column(c).to_pylist() for c in ("doc_id", "th", "text", "spans")], strict=True):
                words = words_of(text)
                left = kept_words(words, cuts)
                rows.append((i, th, len(words) - len(left), b" ".join(left).decode()))
            yield _batch(rows, ["doc_id", "th", "n_removed", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.string()])

    return shared.select("doc_id", "th", "text").dropDuplicates(["doc_id", "th"]).join(spans, ["doc_id", "th"]).mapInArrow(run, "doc_id long, th long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``docs`` with the words of every window that also starts in a document of smaller id taken out of ``text``.

    Words are runs without ASCII white space; a text that loses words is joined anew by single
    spaces, others stay as they are. Windows are judged on the input. Rows with a null id neither
    lose words nor count as earlier; nulls stay null; rows that share an id are not earlier than
    one another; no rows give no rows; other columns stay, whatever their names.
    """
    _, shared, spans = _plan(docs, text, doc_id, window)
    cut = _cut(shared, spans).select("doc_id", "th", F.col("kept").alias("new"))
    rows = packed(docs, id=col(doc_id).cast("long"), hash=F.xxhash64(F.coalesce(col(text), F.lit(""))))
    joined = rows.join(cut, (F.col("id") == F.col("doc_id")) & (F.col("hash") == F.col("th")), "left")
    old = lambda c: F.col(f"row.`{c}`")
    return joined.select(*[(F.coalesce("new", old(c)) if c == text else old(c)).alias(c) for c in docs.columns])


def repeat_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) for each row; rules as in ``remove_repeats``."""
    routes, shared, spans = _plan(docs, text, doc_id, window)
    cut = _cut(shared, spans).select("doc_id", "th", "n_removed", F.sha2("kept", 256).alias("kept"))
    joined = routes.select("doc_id", "th", "n_words", "sha").join(cut, ["doc_id", "th"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))
