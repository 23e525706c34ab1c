"""k-mers and diversity: always long tables (group, k, kmer, n), never dense matrices."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaylake.functions.expressions import change_complexity, count_letter, hash_unit, information_content, letter_entropy, safe_ratio
from assaylake.functions.tails import chi2_p

from .graph import materialise
from .stats import average_ranks

#: k-mers cut from one piece of a sequence.
PIECE = 512


def _cut(text: Column, k: int) -> Column:
    """All substrings of length k of a text that has as many letters at least: one walk of a pattern that looks ahead from each letter."""
    return F.regexp_extract_all(text, F.lit("(?s)(?![\\x{DC00}-\\x{DFFF}])(?=(.{%d}))" % k), F.lit(1))


def _pieces(seq: Column, k: int) -> Column:
    """Overlapping pieces that hold all substrings of length k: a substring walks its string from the start, so strings are kept short."""
    starts = F.sequence(F.lit(0), F.floor((F.length(seq) - k) / PIECE).cast("int"))
    return F.transform(starts, lambda i: F.substring(seq, i * PIECE + 1, F.lit(PIECE + k - 1)))


def kmers(df: DataFrame, ids: Sequence[str], seq: str, ks: Sequence[int], distinct: bool = False) -> DataFrame:
    """(ids, k, kmer): all overlapping substrings; sequences shorter than k give none. ``distinct``: each once for a row.

    A letter becomes a row, so sequences, or else their pieces, are dealt out evenly first: neither a long sequence nor a
    large file holds up a task, and what is shuffled for it is a small part of the k-mers.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = None
    for k in ks:
        long_enough = df.select(*ids, seq).where(F.length(seq) >= k)
        if distinct:
            words = F.array_distinct(F.flatten(F.transform(_pieces(F.col(seq), k), lambda piece: _cut(piece, k))))  # noqa: B023
            made = long_enough.repartition(parts).select(*ids, F.lit(k).alias("k"), F.explode(words).alias("kmer"))
        else:
            cut = long_enough.select(*ids, F.explode(_pieces(F.col(seq), k)).alias("_piece")).repartition(parts)
            made = cut.select(*ids, F.lit(k).alias("k"), F.explode(_cut(F.col("_piece"), k)).alias("kmer"))
        out = made if out is None else out.unionByName(made)
    return out


#: Letters of a sequence that are counted as one row, and letters whose k-mers are counted at a time.
LONG, AT_ONCE = 1 << 16, 1 << 20
#: Letters whose runs are packed at a time, and letters of runs in a bucket of minimizers, if they are spread evenly.
PACKED, BUCKET = 1 << 24, 1 << 21
#: Letters for each bucket of words.
WORDS = 1 << 22


def _strings(letters: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    sizes = 1 + (letters >= 0x80).astype(np.int32) + (letters >= 0x800) + (letters >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))]).astype(np.int32)
    data = np.ascontiguousarray(letters, "<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.StringArray.from_buffers(len(letters), pa.py_buffer(ends), pa.py_buffer(data))


def count_kmers(texts: Sequence[str], groups: Sequence[int], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, letters, n) of the k-mers of each group, by group and then in order of letters.

    A group and k letters are one whole number; where that would not fit 64 bits, the starts so far are numbered in order.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([np.arange(at, at + n - k + 1) for at, n in zip(np.cumsum(sizes) - sizes, sizes.tolist(), strict=True)]) if len(texts) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros((0, k), np.uint32), np.zeros(0, np.int64)
    letters = np.flatnonzero(np.bincount(codes))
    number = np.zeros(int(letters[-1]) + 1, np.int64)
    number[letters] = np.arange(len(letters))
    ranks, base = number[codes], len(letters)
    key = np.repeat(np.asarray(groups, np.int64), np.maximum(sizes - k + 1, 0))
    size, packed = int(key.max()) + 1, True
    for j in range(k):
        if size > (1 << 62) // base:
            seen, key = np.unique(key, return_inverse=True)
            size, packed = len(seen), False
        key = key * base + ranks[starts + j]
        size *= base
    if not packed:
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        of = np.repeat(np.asarray(groups, np.int64), np.maximum(sizes - k + 1, 0))[first]
        return of, codes[starts[first][:, None] + np.arange(k)], n
    key, n = np.unique(key, return_counts=True)
    found = np.zeros((len(key), k), np.uint32)
    for j in reversed(range(k)):
        key, digit = np.divmod(key, base)
        found[:, j] = letters[digit]
    return key, found, n


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches in slices of ``AT_ONCE`` letters or one row, with their texts."""
    for b in batches:
        texts = b.column(text).to_pylist()
        ends, held = [0], 0
        for i, t in enumerate(texts):
            if held and held + len(t) > AT_ONCE:
                ends.append(i)
                held = 0
            held += len(t)
        for lo, hi in zip(ends, [*ends[1:], len(texts)], strict=True):
            if hi > lo:
                yield b.slice(lo, hi - lo), texts[lo:hi]


def _long_pieces(df: DataFrame, by: Sequence[str], keys: Sequence[str], seq: str, least: int, k: int) -> DataFrame:
    """(keys, _s, _last): sequences of ``least`` letters or more in pieces of ``LONG`` letters that overlap by k - 1, dealt out evenly."""
    n = F.length(seq)
    starts = F.sequence(F.lit(0), F.floor(F.greatest(n - k, F.lit(0)) / LONG).cast("int"))
    pieces = F.transform(starts, lambda i: F.struct(F.substring(F.col(seq), i * LONG + 1, F.lit(LONG + k - 1)).alias("s"), (i * LONG + LONG + k - 1 >= n).alias("last")))
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = [F.col(c).alias(g) for c, g in zip(by, keys, strict=True)]
    cut = df.where(n >= least).select(*named, F.explode(pieces).alias("_piece")).repartition(parts)
    return cut.select(*keys, F.col("_piece.s").alias("_s"), F.col("_piece.last").alias("_last"))


#: No letter, after the last one of a word.
NONE = np.uint32(0xFFFFFFFF)


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers in as few bytes as hold them, the largest number of a width standing for ``NONE``, and their width."""
    known = x[x != NONE]
    width = next(w for w in (1, 2, 4) if w == 4 or not len(known) or int(known.max()) < (1 << 8 * w) - 1)
    return width, x.astype(f"<u{width}").tobytes()  # none: all bits, in any width


def _wide(raw: np.ndarray, width: int, many: int) -> np.ndarray:
    got = np.frombuffer(raw.tobytes(), f"<u{width}", many).astype(np.uint32)
    if width < 4:
        got[got == (1 << 8 * width) - 1] = NONE
    return got


def _packed_words(of: np.ndarray, letters: np.ndarray, n: np.ndarray, least: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(group, bucket, words) of words in rows of letters that come ``n`` times each: those with the same first ``least`` letters are of one bucket, and those of a bucket are compressed together, letter by letter."""
    h = np.zeros(len(letters), np.uint64)
    for j in range(least):
        h = h * np.uint64(0x9E3779B97F4A7C15) + letters[:, j]
    bucket = (((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((bucket, of))  # within a bucket as they come
    of, bucket, letters, n = of[order], bucket[order], letters[order], n[order]
    edges = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(bucket) != 0))).tolist() if len(of) else []
    for lo, hi in zip(edges, [*edges[1:], len(of)], strict=True):
        (w, text), (v, times) = _narrow(np.ascontiguousarray(letters[lo:hi].T).ravel()), _narrow(n[lo:hi].astype(np.uint32))
        head = np.array([hi - lo, w, v], "<i8").tobytes()
        yield int(of[lo]), int(bucket[lo]), head + pa.compress(text + times, codec="zstd", asbytes=True)


def _unpacked_words(packed: bytes, longest: int) -> tuple[np.ndarray, np.ndarray]:
    many, w, v = np.frombuffer(packed, "<i8", 3).tolist()
    raw = np.frombuffer(pa.decompress(packed[24:], decompressed_size=many * (w * longest + v), codec="zstd", asbytes=True), np.uint8)
    return _wide(raw[: many * w * longest], w, many * longest).reshape(longest, many).T, _wide(raw[many * w * longest :], v, many).astype(np.int64)


def rolled_up(letters: np.ndarray, n: np.ndarray, ks: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, letters, n) of words in rows of letters and of what they start with, for each k: equal ones as one with their sum."""
    known, ranks = np.unique(letters, return_inverse=True)
    ranks = ranks.reshape(letters.shape)
    if len(known) ** letters.shape[1] < 1 << 62:
        order = np.argsort(ranks @ np.array([len(known) ** j for j in reversed(range(letters.shape[1]))], np.int64), kind="stable")
    else:
        order = np.lexsort(ranks.T[::-1])
    letters, n = letters[order], n[order]
    other = np.cumsum(letters[1:] != letters[:-1], axis=1) > 0  # from the neighbour, in the first letters
    for k in ks:
        whole = letters[:, k - 1] != NONE
        if whole.any():
            # Words that end before the k-th letter stand between others, so neighbours are those that are left.
            part, times = letters[whole, :k], n[whole]
            new = np.append(True, other[:, k - 1] if whole.all() else (part[1:] != part[:-1]).any(axis=1))
            at = np.flatnonzero(new)
            yield k, part[at], np.add.reduceat(times, at)


def kmer_counts(df: DataFrame, by: Sequence[str], seq: str, ks: Sequence[int], together: bool = False, summed: bool = True) -> DataFrame:
    """(group, k, kmer, n); a task counts what it holds before the shuffle, a million letters at a time.

    Of several k only the longest is cut: a k-mer is the start of a longer one, or of what follows the last of those, so
    counts of the longest and of each sequence's endings are rolled up to the shorter ones. They are dealt by group and
    first letters, as many as the shortest k has, many packed into one row, so that rolling up shuffles nothing more. A task takes its pieces group by
    group, so that it meets a group's k-mers at one go, however many groups there are. ``together``: all groups of a k-mer
    are dealt to one task, for what compares groups. Unless ``summed``, a k-mer of one k has a row for each task's count of it, and
    nothing is shuffled but the pieces.
    """
    least, longest = min(ks), max(ks)
    keys = [f"_g{i}" for i in range(len(by))]
    pieces = _long_pieces(df, by, keys, seq, least, longest).sortWithinPartitions(*keys) if by else _long_pieces(df, by, keys, seq, least, longest)

    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = [F.col(g).alias(c) for c, g in zip(by, keys, strict=True)]
    if least < longest and not together:
        return _counts_of_lengths(pieces, df.agg(F.sum(F.length(seq).cast("long"))).first()[0] or 0, keys, sorted(set(ks)), parts).select(*out, "k", "kmer", "n")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches, len(by)):
            names = list(zip(*[part.column(i).to_pylist() for i in range(len(by))], strict=True)) if by else [()] * len(texts)
            first: dict[tuple, int] = {}
            groups = [first.setdefault(name, i) for i, name in enumerate(names)]
            of, letters, n = count_kmers(texts, groups, longest)
            words, endings = _strings(letters), Counter()
            if least < longest:
                for group, text, last in zip(groups, texts, part.column(len(by) + 1).to_pylist(), strict=True):
                    if last:
                        endings.update((group, text[i:]) for i in range(max(len(text) - longest + 1, 0), len(text) - least + 1))
            for at, some, ns in ((pa.array(of), words, pa.array(n, pa.int64())), (pa.array([g for g, _ in endings], pa.int64()), pa.array([w for _, w in endings], pa.string()), pa.array(list(endings.values()), pa.int64()))):
                if len(at):
                    yield pa.RecordBatch.from_arrays([*[part.column(i).take(at) for i in range(len(by))], some, ns], names=[*keys, "_w", "_n"])

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields[:-2]], "_w string, _n long"])
    windows = pieces.mapInArrow(cut, schema)
    if least == longest:
        if not summed:
            return windows.select(*out, F.lit(least).alias("k"), F.col("_w").alias("kmer"), F.col("_n").alias("n"))
        if together:
            windows = windows.repartition(parts, "_w")
        return windows.groupBy(*keys, F.col("_w").alias("kmer")).agg(F.sum("_n").alias("n")).select(*out, F.lit(least).alias("k"), "kmer", "n")
    dealt = windows.withColumn("_p", F.substring("_w", 1, least)).repartition(parts, "_p").groupBy(*keys, "_p", "_w").agg(F.sum("_n").alias("_n"))
    held = F.filter(F.array(*[F.lit(k) for k in sorted(set(ks))]), lambda k: k <= F.length("_w"))
    each = dealt.select(*keys, "_p", "_w", "_n", F.explode(held).alias("k")).select(*keys, "_p", "k", F.substring(F.col("_w"), F.lit(1), F.col("k")).alias("kmer"), "_n")
    return each.groupBy(*keys, "_p", "k", "kmer").agg(F.sum("_n").alias("n")).select(*out, "k", "kmer", "n")


def _counts_of_lengths(pieces: DataFrame, letters: int, keys: Sequence[str], ks: Sequence[int], parts: int) -> DataFrame:
    """(keys, k, kmer, n) of several k: counts of the longest, and of endings, travel packed by group and bucket of first letters; a task rolls up a bucket at a time."""
    d, least, longest = len(keys), min(ks), max(ks)
    buckets = max(parts, min(1 << 12, letters // WORDS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches, d):
            names = list(zip(*[part.column(i).to_pylist() for i in range(d)], strict=True)) if d else [()] * len(texts)
            first: dict[tuple, int] = {}
            groups = [first.setdefault(name, i) for i, name in enumerate(names)]
            of, found, n = count_kmers(texts, groups, longest)
            endings = Counter()
            for group, text, last in zip(groups, texts, part.column(d + 1).to_pylist(), strict=True):
                if last:
                    endings.update((group, text[i:]) for i in range(max(len(text) - longest + 1, 0), len(text) - least + 1))
            short = np.full((len(endings), longest), NONE)
            for row, (_, word) in zip(short, endings, strict=True):
                row[: len(word)] = [ord(c) for c in word]
            of, n = np.append(of, [g for g, _ in endings]).astype(np.int64), np.append(n, list(endings.values())).astype(np.int64)
            made = list(_packed_words(of, np.concatenate([found.astype(np.uint32), short]), n, least, buckets))
            if made:
                at = pa.array([g for g, _, _ in made], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(at) for i in range(d)], pa.array([b for _, b, _ in made], pa.int64()), pa.array([w for _, _, w in made], pa.binary())], names=[*keys, "_b", "_words"])

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, group = None, []

        def made() -> Iterator[pa.RecordBatch]:
            for k, found, n in rolled_up(*(np.concatenate(x) for x in zip(*held, strict=True)), ks):
                for lo in range(0, len(n), 1 << 17):
                    own = slice(lo, lo + (1 << 17))
                    yield pa.RecordBatch.from_arrays([*[pa.repeat(g, len(n[own])) for g in group], pa.array(np.full(len(n[own]), k, np.int32)), _strings(found[own]), pa.array(n[own])], names=[*keys, "k", "kmer", "n"])
            held.clear()

        for b in batches:
            for r in range(b.num_rows):
                at = tuple(b.column(i)[r].as_py() for i in range(d + 1))
                if held and at != now:
                    yield from made()
                now, group = at, [b.column(i)[r] for i in range(d)]
                held.append(_unpacked_words(b.column(d + 1)[r].as_py(), longest))
        if held:
            yield from made()

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields[:d]]
    dealt = pieces.mapInArrow(cut, ", ".join([*kinds, "_b long, _words binary"])).repartition(parts, *keys, "_b").sortWithinPartitions(*keys, "_b")
    return dealt.mapInArrow(roll, ", ".join([*kinds, "k int, kmer string, n long"]))


#: Sums over the k-mers of a group, from which its measures come.
SUMS = "richness long, total long, _nln double, _n2 double, _max long, singletons long, low string, high string"


def _sums(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    n = F.col("n").cast("double")
    return counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("richness"), F.sum("n").alias("total"), F.sum(n * F.ln(n)).alias("_nln"), F.sum(n * n).alias("_n2"),
        F.max("n").alias("_max"), F.count_if(F.col("n") == 1).alias("singletons"), F.min("kmer").alias("low"), F.max("kmer").alias("high"),
    )


def sums_by_sequence(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(key, k, sums) of the k-mers of each key's sequences, of which nearly every key has one: no k-mer of those is shuffled.

    A key of one sequence of ``LONG`` letters at most is summed where it lies. Keys of several rows or of a longer sequence
    are counted as groups.
    """
    rows = df.where(F.length(seq) >= k).select(F.col(key).alias("_g0"), F.col(seq).alias("_s"))
    many = materialise(rows.groupBy("_g0").agg(F.count(F.lit(1)).alias("_rows"), F.max(F.length("_s")).alias("_longest")).where((F.col("_rows") > 1) | (F.col("_longest") > LONG)).select(F.col("_g0").alias("_m")), "long-keys")
    same = F.col("_g0").eqNullSafe(F.col("_m"))
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches, 1):
            of, letters, n = count_kmers(texts, range(len(texts)), k)
            at = np.flatnonzero(np.diff(of, prepend=-1))
            ends = np.append(at[1:], len(of)) - 1
            total = lambda x: np.add.reduceat(x, at)  # noqa: B023, E731
            x = n.astype(np.float64)
            made = [ends - at + 1, total(n), total(x * np.log(x)), total(x * x), np.maximum.reduceat(n, at), total((n == 1).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of[at])), *[pa.array(v) for v in made], _strings(letters[at]), _strings(letters[ends])], names=["_g0", *[c.split()[0] for c in SUMS.split(", ")]])

    alone = rows.join(many, same, "left_anti").repartition(parts).mapInArrow(sums, f"_g0 {rows.schema['_g0'].dataType.simpleString()}, {SUMS}")
    grouped = _sums(kmer_counts(rows.join(many, same, "left_semi"), ["_g0"], "_s", [k]), ["_g0"])
    return alone.unionByName(grouped).select(F.col("_g0").alias(key), F.lit(k).alias("k"), *[c.split()[0] for c in SUMS.split(", ")])


#: Letters of a sequence that are cut into runs at a time.
STRETCH = 1 << 16


def _codes(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


def _starts(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where k-mers of texts of these sizes, end to end, start, and the text of each."""
    many = np.maximum(sizes - k + 1, 0)
    before = np.cumsum(sizes) - sizes - (np.cumsum(many) - many)
    return np.arange(many.sum()) + np.repeat(before, many), np.repeat(np.arange(len(sizes)), many)


def _hashed(codes: np.ndarray, k: int) -> np.ndarray:
    """A number for each k letters in a row."""
    h = np.zeros(max(len(codes) - k + 1, 0), np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(h) + i]
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def runs_of(texts: Sequence[str], k: int, m: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, minimizer, run): texts in runs whose k-mers share the least hash of their m-mers, in order; runs overlap by k - 1 letters."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts, of = _starts(sizes, k)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    joined = "".join(texts)
    codes = _codes([joined])
    least, span = _hashed(codes, m), 1
    while span < k - m + 1:  # the least of twice as many, then of what is still wanted
        step = min(span, k - m + 1 - span)
        least, span = np.minimum(least[:-step], least[step:]), span + step
    least = least[starts]
    first = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (of[1:] != of[:-1])))
    last = np.append(first[1:], len(starts)) - 1
    size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    at = np.append(0, np.cumsum(size))
    lo, hi = at[starts[first]], at[starts[last] + k]
    ends = np.append(0, np.cumsum(hi - lo))
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)[np.arange(ends[-1]) + np.repeat(lo - ends[:-1], hi - lo)]
    return of[first], least[first].view(np.int64), pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def _stretches(text: str, k: int) -> list[str]:
    return [text[at : at + STRETCH + k - 1] for at in range(0, len(text) - k + 1, STRETCH)]


def minimizer_runs(text: str, k: int, m: int) -> Iterator[tuple[int, str]]:
    """(minimizer, run) of one text: see ``runs_of``."""
    for own in _stretches(text, k):
        _, least, runs = runs_of([own], k, m)
        yield from zip(least.tolist(), runs.to_pylist(), strict=True)


def count_runs(runs: Sequence[str], groups: np.ndarray, ns: np.ndarray, k: int, named: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """(group, letters if ``named``, n) of the k-mers of runs that come ``ns`` times each; those of many letters in several turns, each with its share of the k-mers.

    k-mers are ordered by a hash, and neighbours of one hash are compared letter by letter; should two differ, all are ordered by letters.
    """
    parts, held = [[]], 0
    for i, run in enumerate(runs):
        if held and held + len(run) > AT_ONCE:
            parts.append([])
            held = 0
        parts[-1].append(i)
        held += len(run)
    turns = -(-len(parts) // 4)
    for turn in range(turns):
        found, text, size = [], [], 0
        for part in parts:
            some = [runs[i] for i in part]
            starts, of = _starts(np.array([len(t) for t in some], np.int64), k)
            codes = _codes(some)
            h = _hashed(codes, k)[starts] if len(starts) else np.zeros(0, np.uint64)
            mine = np.flatnonzero(h % np.uint64(turns) == turn) if turns > 1 else np.arange(len(h))
            row = np.array(part, np.int64)[of[mine]]
            own = starts[mine]
            if turns > 1:  # no more letters than those of its share
                codes, own = codes[own[:, None] + np.arange(k)].ravel(), np.arange(len(mine)) * k
            found.append((h[mine], groups[row], ns[row], own + size))
            text.append(codes)
            size += len(codes)
        h, of, n, start = (np.concatenate(x) for x in zip(*found, strict=True))
        flat = np.concatenate(text)
        letters = lambda at: flat[start[at][:, None] + np.arange(k)]  # noqa: B023, E731
        if not len(h):
            continue
        h = h + of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(h)
        alike = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        new = np.ones(len(h), bool)
        new[alike + 1] = False
        x, y = order[alike], order[alike + 1]
        if (of[x] != of[y]).any() or any((flat[start[x] + i] != flat[start[y] + i]).any() for i in range(k)):
            whole = np.ascontiguousarray(np.concatenate([of[:, None].astype(np.uint32), letters(np.arange(len(h)))], axis=1))
            number = np.unique(whole.view(np.dtype((np.void, 4 * (k + 1)))).ravel(), return_inverse=True)[1]
            order = np.argsort(number)
            new = np.append(True, number[order[1:]] != number[order[:-1]])
        at = np.flatnonzero(new)
        yield of[order[at]], letters(order[at]) if named else None, np.add.reduceat(n[order], at)


def _packed(tables: Sequence[pa.Table], keys: Sequence[str], buckets: int) -> Iterator[pa.RecordBatch]:
    """(keys, _b, _size, _runs): runs of (keys, _m, _run, _n), equal ones counted, by group and bucket of the minimizer; those of a bucket in order of it, compressed together."""
    t = pa.concat_tables(tables)
    if len(tables) > 1:
        t = t.group_by([*keys, "_m", "_run"], use_threads=False).aggregate([("_n", "sum")]).rename_columns([*keys, "_m", "_run", "_n"])
    t = t.combine_chunks()
    group = np.zeros(len(t), np.int64)
    for g in keys:
        c = t.column(g).combine_chunks().dictionary_encode()
        group = group * (len(c.dictionary) + 1) + c.indices.fill_null(len(c.dictionary)).to_numpy()
    least = t.column("_m").to_numpy()
    mixed = least.view(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((least, bucket, group))
    runs, n = t.column("_run").combine_chunks().take(pa.array(order)), t.column("_n").to_numpy()[order].astype("<u8")
    ends = np.frombuffer(runs.buffers()[1], np.int32)[runs.offset : runs.offset + len(runs) + 1]
    data, sizes = np.frombuffer(runs.buffers()[2], np.uint8), np.diff(ends).astype("<u4")
    edges = np.flatnonzero(np.append(True, (np.diff(group[order]) != 0) | (np.diff(bucket[order]) != 0))).tolist()
    made, lengths = [], []
    for lo, hi in zip(edges, [*edges[1:], len(order)], strict=True):
        planes = [np.ascontiguousarray(x[lo:hi].view(np.uint8).reshape(hi - lo, -1).T).tobytes() for x in (sizes, n)]  # the upper bytes are mostly none
        raw = b"".join([*planes, data[ends[lo] : ends[hi]].tobytes()])
        made.append(pa.compress(raw, codec="zstd", asbytes=True))
        lengths.append((hi - lo) << 32 | len(raw))
    first = pa.array(order[edges])
    for lo in range(0, len(made), 1024):
        at, own = first.slice(lo, 1024), slice(lo, lo + 1024)
        yield pa.RecordBatch.from_arrays([*[t.column(g).combine_chunks().take(at) for g in keys], pa.array(bucket[order[edges[own]]]), pa.array(lengths[own], pa.int64()), pa.array(made[own], pa.binary())], names=[*keys, "_b", "_size", "_runs"])


def _unpacked(size: int, packed: bytes) -> tuple[pa.Array, np.ndarray]:
    """The runs, and how often each comes."""
    many, whole = size >> 32, size & 0xFFFFFFFF
    raw = np.frombuffer(pa.decompress(packed, decompressed_size=whole, codec="zstd", asbytes=True), np.uint8)
    sizes, n = (np.ascontiguousarray(x.reshape(w, many).T).view(f"<u{w}").ravel() for x, w in ((raw[: 4 * many], 4), (raw[4 * many : 12 * many], 8)))
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.StringArray.from_buffers(many, pa.py_buffer(ends), pa.py_buffer(raw[12 * many :].tobytes())), n.astype(np.int64)


def _dealt_runs(df: DataFrame, by: Sequence[str], keys: Sequence[str], seq: str, k: int, m: int) -> DataFrame:
    """(keys, _b, _size, _runs): runs, equal ones of ``PACKED`` letters counted, packed by group and bucket of minimizers, dealt by these and in their order."""
    rows = df.where(F.length(seq) >= k).select(*[F.col(c).alias(g) for c, g in zip(by, keys, strict=True)], F.col(seq).alias("_s"))
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    letters = df.agg(F.sum(F.length(seq).cast("long"))).first()[0] or 0
    buckets = max(parts, min(1 << 14, 4 * letters // BUCKET))  # runs have some four letters for each one of a sequence

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for part, whole in _slices(batches, len(by)):
            names = list(zip(*[part.column(i).to_pylist() for i in range(len(by))], strict=True)) if by else [()] * len(whole)
            first: dict[tuple, int] = {}
            row = [first.setdefault(name, i) for i, name in enumerate(names)]
            texts, place = [], []
            for at, text in enumerate(whole):
                own = _stretches(text, k)
                texts += own
                place += [row[at]] * len(own)
            for lo in range(0, len(texts), max(1, AT_ONCE // STRETCH)) if len(whole) == 1 else (0,):
                some = texts[lo : lo + max(1, AT_ONCE // STRETCH)] if len(whole) == 1 else texts
                of, least, runs = runs_of(some, k, m)
                if len(of):
                    got = pa.table([pa.array(np.array(place[lo:], np.int64)[of]), pa.array(least), runs], names=["of", "_m", "_run"]).group_by(["of", "_m", "_run"]).aggregate([([], "count_all")])
                    at = got.column("of").combine_chunks()
                    held.append(pa.table([*[part.column(i).take(at) for i in range(len(by))], *got.select(["_m", "_run", "count_all"]).columns], names=[*keys, "_m", "_run", "_n"]))
                    size += sum(len(t) for t in some)
                if size >= PACKED:
                    yield from _packed(held, keys, buckets)
                    held, size = [], 0
        if held:
            yield from _packed(held, keys, buckets)

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], "_b long, _size long, _runs binary"])
    return rows.mapInArrow(cut, schema).repartition(parts, *keys, "_b").sortWithinPartitions(*keys, "_b")


def _count_runs(dealt: DataFrame, keys: Sequence[str], k: int, spectrum: bool) -> DataFrame:
    """(keys, kmer, n), or (keys, multiplicity, n_kmers), of packed runs in order of group and bucket; those of one bucket are counted together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple, pa.Array, np.ndarray]] = []
        size, now, types = 0, None, []

        def made() -> Iterator[pa.RecordBatch]:
            names: dict[tuple, int] = {}
            groups = np.concatenate([np.full(len(n), names.setdefault(name, len(names)), np.int64) for name, _, n in held])
            runs, ns = pa.concat_arrays([r for _, r, _ in held]).to_pylist(), np.concatenate([n for _, _, n in held])
            held.clear()
            each = [pa.array([name[i] for name in names], x) for i, x in enumerate(types)]
            for of, letters, n in count_runs(runs, groups, ns, k, not spectrum):
                if spectrum:
                    pairs, many = np.unique(n * len(names) + of, return_counts=True)
                    of, more = pairs % len(names), [pa.array(pairs // len(names)), pa.array(many.astype(np.int64))]
                else:
                    more = [_strings(letters), pa.array(n)]
                yield pa.RecordBatch.from_arrays([*[e.take(pa.array(of)) for e in each], *more], names=[*keys, *(("multiplicity", "n_kmers") if spectrum else ("kmer", "n"))])

        for b in batches:
            types = [b.schema.field(i).type for i in range(len(keys))]
            for r in range(b.num_rows):
                at = tuple(b.column(i)[r].as_py() for i in range(len(keys) + 1))
                if at != now and size >= AT_ONCE:
                    yield from made()
                    size = 0
                now = at
                runs, n = _unpacked(b.column(len(keys) + 1)[r].as_py(), b.column(len(keys) + 2)[r].as_py())
                held.append((at[:-1], runs, n))
                size += pc.sum(pc.utf8_length(runs)).as_py()
        if held:
            yield from made()

    columns = [f"{g} {dealt.schema[g].dataType.simpleString()}" for g in keys]
    return dealt.mapInArrow(count, ", ".join([*columns, "multiplicity long, n_kmers long" if spectrum else "kmer string, n long"]))


def long_kmer_counts(df: DataFrame, by: Sequence[str], seq: str, k: int, m: int = 7) -> DataFrame:
    """(group, k, kmer, n) like ``kmer_counts``, for long k, of which nearly every one is new, so that sums before the shuffle spare nothing.

    Sequences are cut where the least hash of their m-mers changes, and runs, equal ones counted, are dealt by
    group and a bucket of that hash, many packed into one row: neighbouring k-mers travel as one string, and all places of a k-mer
    meet in one task, where it is cut and counted without another shuffle, bucket by bucket. A k-mer that fills much of the data
    has its bucket's task work longer.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    each = _count_runs(_dealt_runs(df, by, keys, seq, k, min(m, k)), keys, k, False)
    return each.select(*[F.col(g).alias(c) for c, g in zip(by, keys, strict=True)], F.lit(k).alias("k"), "kmer", "n")


def long_kmer_spectrum(df: DataFrame, by: Sequence[str], seq: str, k: int, m: int = 7) -> DataFrame:
    """``kmer_abundance_spectrum`` of ``long_kmer_counts``, of which no k-mer leaves the task that counts it."""
    keys = [f"_g{i}" for i in range(len(by))]
    each = _count_runs(_dealt_runs(df, by, keys, seq, k, min(m, k)), keys, k, True)
    return each.groupBy(*[F.col(g).alias(c) for c, g in zip(by, keys, strict=True)], F.lit(k).alias("k"), "multiplicity").agg(F.sum("n_kmers").alias("n_kmers"))


def kmer_presence(df: DataFrame, seq: str, ks: Sequence[int]) -> DataFrame:
    """(k, kmer, n_seqs): sequences that hold the k-mer."""
    return kmers(df, [], seq, ks, distinct=True).groupBy("k", "kmer").agg(F.count(F.lit(1)).alias("n_seqs"))


def kmer_relative_freq(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    totals = counts.groupBy(*by, "k").agg(F.sum("n").alias("_n"))
    return counts.join(totals, [*by, "k"]).withColumn("freq", safe_ratio(F.col("n"), F.col("_n"))).drop("_n")


def kmer_matrix(counts: DataFrame, least: int = 5) -> DataFrame:
    """Counts of k-mers whose total over all groups is at least ``least``."""
    kept = counts.groupBy("k", "kmer").agg(F.sum("n").alias("_t")).where(F.col("_t") >= least).select("k", "kmer")
    return counts.join(kept, ["k", "kmer"])


def kmer_abundance_spectrum(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many k-mers occur how often in each group."""
    return counts.groupBy(*by, "k", F.col("n").alias("multiplicity")).agg(F.count(F.lit(1)).alias("n_kmers"))


def suggested_k(df: DataFrame, by: Sequence[str], seq: str) -> DataFrame:
    """round(log4 of all letters)."""
    return df.groupBy(*by).agg(F.sum(F.length(seq)).alias("bases")).withColumn("k", F.round(F.ln(F.col("bases").cast("double")) / F.ln(F.lit(4.0))).cast("int"))


def diversity(counts: DataFrame, by: Sequence[str], alphabet: int = 4) -> DataFrame:
    """By group and k from one pass: richness, total, entropies, evenness, Rényi, Hill, Simpson, Miller-Madow and Chao-Shen.

    Sums of n ln n give the entropy without a join to totals.
    """
    return _measures(_sums(counts, [*by, "k"]), alphabet)


def _measures(got: DataFrame, alphabet: int = 4) -> DataFrame:
    t = F.col("total").cast("double")
    h = F.ln(t) - F.col("_nln") / t
    simpson = F.col("_n2") / (t * t)
    bits = F.col("shannon") / F.ln(F.lit(2.0))
    top = F.col("k") * F.log2(F.lit(float(alphabet)))
    correction = (F.col("richness") - 1) / (2 * F.ln(F.lit(2.0)) * t)
    return got.withColumn("shannon", F.greatest(h, F.lit(0.0))).withColumns({
        "shannon_bits": bits, "evenness": safe_ratio(F.col("shannon"), F.ln(F.col("richness").cast("double"))), "normalised": bits / top,
        "miller_madow": correction, "adjusted": bits / top + correction, "adjusted_scaled": (bits + correction) / top,
        "renyi0": F.log2(F.col("richness").cast("double")), "renyi2": -F.log2(simpson), "renyi_inf": -F.log2(F.col("_max") / t),
        "hill1": F.exp("shannon"), "ens_pie": 1 / simpson, "gini_simpson": 1 - simpson, "good_coverage": 1 - F.col("singletons") / t,
    }).drop("_nln", "_n2", "_max", "low", "high")


def kmer_assessment(df: DataFrame, by: Sequence[str], seq: str, ks: Sequence[int]) -> DataFrame:
    """Entropy (natural log), richness and evenness by group and k."""
    return diversity(kmer_counts(df, by, seq, ks), by).select(*by, "k", "shannon", "richness", "evenness")


def kmer_assessment_by_sequence(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """``kmer_assessment`` by a key that nearly each sequence has for itself."""
    return _measures(sums_by_sequence(df, key, seq, k)).select(key, "k", "shannon", "richness", "evenness")


def nested_assessment(df: DataFrame, key: str, seq: str, ks: Sequence[int], folds: int, fractions: Sequence[float], seed: int = 1) -> DataFrame:
    """(fold, fraction, k, total, shannon, richness, evenness): k-mers of each share of each fold's analysis set, all rows but the fold's own.

    A row has one fold and enters at the first fraction that holds it, both by hashes of its key, so its k-mers are counted
    once, by (fold, step). Running sums over steps give a fold's own rows at every fraction, and sums over folds less its
    own give its analysis set: every cell of the table comes from one row for each k-mer. An empty cell gives no row.
    """
    shares = sorted(float(f) for f in fractions)
    u = hash_unit(seed + 1, F.col(key))  # not the hash that deals the folds
    step = F.size(F.filter(F.array(*[F.lit(f) for f in shares]), lambda f: f <= u))
    placed = df.select((F.floor(hash_unit(seed, F.col(key)) * folds) * len(shares) + step).cast("int").alias("_cell"), step.alias("_s"), seq).where(F.col("_s") < len(shares)).drop("_s")
    counted = kmer_counts(placed, ["_cell"], seq, ks, together=True).groupBy("k", "kmer").agg(F.collect_list(F.struct("_cell", "n")).alias("cells"))  # a number for each fold and fraction at most

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, held = folds * len(shares), {}
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                cells, of = part.column(1).flatten(), np.repeat(np.arange(part.num_rows), part.column(1).value_lengths().to_numpy())
                n = np.zeros((part.num_rows, size))
                n[of, cells.field("_cell").to_numpy()] = cells.field("n").to_numpy()
                own = n.reshape(-1, folds, len(shares)).cumsum(axis=2)
                n = (own.sum(axis=1, keepdims=True) - own).reshape(-1, size)
                logs = n * np.log(np.maximum(n, 1))
                ks_ = part.column(0).to_numpy()
                for k in np.unique(ks_).tolist():
                    r = ks_ == k
                    held[k] = held.get(k, 0) + np.stack([n[r].sum(axis=0), logs[r].sum(axis=0), (n[r] > 0).sum(axis=0)])
        if held:
            cell = np.tile(np.arange(size), len(held))
            total, logs, richness = (np.concatenate([v[i] for v in held.values()]) for i in range(3))
            yield pa.RecordBatch.from_pydict({"k": np.repeat(list(held), size).astype(np.int32), "cell": cell.astype(np.int32), "total": total, "logs": logs, "richness": richness.astype(np.int64)})

    got = counted.select("k", "cells").mapInArrow(sums, "k int, cell int, total double, logs double, richness long").groupBy("k", "cell").agg(F.sum("total").alias("total"), F.sum("logs").alias("logs"), F.sum("richness").alias("richness")).where("total > 0")
    at = F.element_at(F.array(*[F.lit(f) for f in shares]), (F.col("cell") % len(shares) + 1).cast("int"))
    shannon = F.greatest(F.ln("total") - F.col("logs") / F.col("total"), F.lit(0.0))
    got = got.select((F.floor(F.col("cell") / len(shares)) + 1).cast("int").alias("fold"), at.alias("fraction"), "k", F.col("total").cast("long").alias("total"), shannon.alias("shannon"), "richness")
    return got.withColumn("evenness", safe_ratio(F.col("shannon"), F.ln(F.col("richness").cast("double"))))


def sample_correlation(counts: DataFrame, sample: str) -> DataFrame:
    """(a, b, rho): rank correlation of the profiles of every two samples over all k-mers that any of them has; one they lack counts as 0.

    Zeros of a sample are tied at the lowest ranks, so they enter by their number alone: only k-mers that occur are ranked,
    and only those that two samples share are joined. Samples are few; their sums are a row for each.
    """
    counts = materialise(counts.select(F.col(sample).alias("s"), "kmer", "n"), "profiles")
    size = counts.agg(F.count_distinct("kmer").cast("double").alias("K"))  # one row
    ranks = average_ranks(counts.select("s", F.col("n").alias("value")), ["s"])
    own = materialise(counts.groupBy("s").agg(F.count(F.lit(1)).cast("double").alias("m")).crossJoin(F.broadcast(size)), "profile-sizes")
    ranks = ranks.select(F.col("s").alias("_s"), "value", "rank")
    ranked = counts.join(ranks, (F.col("s") == F.col("_s")) & (F.col("n") == F.col("value"))).join(own, "s").select("s", "kmer", (F.col("rank") + F.col("K") - F.col("m")).alias("r"))
    ranked = materialise(ranked, "profile-ranks")
    zero = (F.col("K") - F.col("m") + 1) / 2  # the rank of what a sample lacks
    alone = ranked.groupBy("s").agg(F.sum("r").alias("sum"), F.sum(F.col("r") * F.col("r")).alias("sum2")).join(own, "s").withColumn("z", zero)
    mean = (F.col("K") + 1) / 2
    alone = alone.withColumn("var", F.col("sum2") + (F.col("K") - F.col("m")) * F.col("z") * F.col("z") - F.col("K") * mean * mean)
    side = lambda x: alone.select(F.col("s").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("sum", "m", "z", "var")])
    a, b = ranked.select(F.col("s").alias("a"), "kmer", F.col("r").alias("ra")), ranked.select(F.col("s").alias("b"), "kmer", F.col("r").alias("rb"))
    both = a.join(b, "kmer").where("a < b").groupBy("a", "b").agg(F.sum(F.col("ra") * F.col("rb")).alias("p"), F.sum("ra").alias("pa"), F.sum("rb").alias("pb"), F.count(F.lit(1)).alias("c"))
    pairs = side("a").join(side("b"), F.col("a") < F.col("b")).crossJoin(F.broadcast(size))  # a row for each two samples
    sums = both.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "p", "pa", "pb", "c")
    got = pairs.join(sums, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left").na.fill(0, ["p", "pa", "pb", "c"])
    product = F.col("p") + (F.col("sum_a") - F.col("pa")) * F.col("z_b") + (F.col("sum_b") - F.col("pb")) * F.col("z_a") + (F.col("K") - F.col("m_a") - F.col("m_b") + F.col("c")) * F.col("z_a") * F.col("z_b")
    return got.select("a", "b", safe_ratio(product - F.col("K") * mean * mean, F.sqrt(F.col("var_a") * F.col("var_b"))).alias("rho"))


def global_evenness(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Entropy over the log of the richness of all groups together, for each k."""
    whole = counts.groupBy("k").agg(F.count_distinct("kmer").alias("global_richness"))  # a row for each k
    return diversity(counts, by).join(F.broadcast(whole), "k").select(*by, "k", "shannon", "global_richness", safe_ratio(F.col("shannon"), F.ln(F.col("global_richness").cast("double"))).alias("global_evenness"))


def chao_shen(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Entropy estimate for unseen k-mers: proportions scaled by sample coverage, terms over their chance of being seen."""
    size = counts.groupBy(*by, "k").agg(F.sum("n").cast("double").alias("_t"), F.count_if(F.col("n") == 1).alias("_f1"))
    c = F.when(F.col("_f1") == F.col("_t"), 1 - (F.col("_f1") - 1) / F.col("_t")).otherwise(1 - F.col("_f1") / F.col("_t"))
    p = c * F.col("n") / F.col("_t")
    seen = 1 - F.pow(1 - F.col("_p"), F.col("_t"))
    term = F.when(seen > 0, -F.col("_p") * F.ln(F.col("_p")) / seen)
    return counts.join(size, [*by, "k"]).withColumn("_p", p).withColumn("_x", term).groupBy(*by, "k").agg(F.sum("_x").alias("chao_shen"))


def two_sample(counts: DataFrame, side: str, test: str, by: Sequence[str] = ()) -> DataFrame:
    """By group and k-mer the counts of the test side and of the others: one grouped pass in place of an outer join."""
    return counts.groupBy(*by, "k", "kmer").agg(F.sum(F.when(F.col(side) == test, F.col("n")).otherwise(0)).alias("n_test"), F.sum(F.when(F.col(side) != test, F.col("n")).otherwise(0)).alias("n_train"))


def divergence(merged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Square root of the Jensen-Shannon divergence (base 2) with its flag, and KL(test || train) over shared k-mers with 2 N KL and its p by chi squared of distinct k-mers less one."""
    keys = [*by, "k"]
    size = merged.groupBy(*keys).agg(F.sum("n_test").cast("double").alias("_a"), F.sum("n_train").cast("double").alias("_b"))
    p, q = F.col("n_test") / F.col("_a"), F.col("n_train") / F.col("_b")
    m = (p + q) / 2
    js = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
    kl = F.when((p > 0) & (q > 0), p * F.ln(p / q)).otherwise(0.0)
    got = merged.join(size, keys).where("_a > 0 AND _b > 0").groupBy(*keys).agg(F.sqrt(F.greatest(F.sum(js) / 2, F.lit(0.0))).alias("jsd"), F.sum(kl).alias("kl"), F.max("_a").alias("n_test"), F.count(F.lit(1)).alias("_d"))
    return got.withColumn("flag", F.when(F.col("jsd") > 0.15, "HIGH").when(F.col("jsd") > 0.10, "MOD").otherwise("LOW")).withColumn("chi2", 2 * F.col("n_test") * F.col("kl")).withColumn("p", chi2_p("chi2", F.col("_d") - 1)).drop("_d")


def held_out_entropy(counts: DataFrame, label: str, alphabet: int = 4) -> DataFrame:
    """By held-out label and k: diversity of its k-mers (test), of all others' (train), and the divergence of the two with its flag.

    A k-mer that a label lacks adds to the train side what it adds to the whole, so only k-mers that occur are summed
    for each label and the rest is subtracted from the sums of all: no grid of labels and k-mers.
    """
    xlogx = lambda c: F.when(c > 0, c * F.ln(c.cast("double"))).otherwise(0.0)
    all_ = counts.groupBy("k", "kmer").agg(F.sum("n").alias("t"))
    t, n = F.col("t"), F.col("n")
    whole = all_.groupBy("k").agg(F.sum("t").cast("double").alias("all_t"), F.sum(xlogx(t)).alias("all_l"), F.sum(t.cast("double") * t).alias("all_2"), F.count(F.lit(1)).alias("all_n"))  # a row for each k
    sizes = counts.groupBy(label, "k").agg(F.sum("n").cast("double").alias("size")).join(F.broadcast(whole), "k").withColumn("rest", F.col("all_t") - F.col("size"))
    own = counts.join(all_, ["k", "kmer"]).join(F.broadcast(sizes), [label, "k"]).withColumn("r", t - n)  # a row for each label and k
    p, q = n / F.col("size"), F.when(F.col("rest") > 0, F.col("r") / F.col("rest"))
    js = p * F.log2(2 * p / (p + q)) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0)
    r = F.col("r")
    sums = own.groupBy(label, "k").agg(
        F.sum(xlogx(r) - xlogx(t)).alias("dL"), F.sum(r.cast("double") * r - t.cast("double") * t).alias("d2"), F.count_if(r == 0).alias("gone"), F.sum("r").alias("r"), F.sum(js).alias("js"),
        *[F.first(c).alias(c) for c in ("rest", "all_l", "all_2", "all_n")],
    )
    m, bits = F.col("rest"), F.ln(F.lit(2.0))
    shannon = F.greatest(F.ln(m) - (F.col("all_l") + F.col("dL")) / m, F.lit(0.0))
    jsd = F.sqrt(F.greatest((F.col("js") + (m - F.col("r")) / m) / 2, F.lit(0.0)))
    train = sums.where("rest > 0").select(label, "k", shannon.alias("train_shannon"), (shannon / bits).alias("train_shannon_bits"), (shannon / bits / (F.col("k") * F.log2(F.lit(float(alphabet))))).alias("train_normalised"), (-F.log2((F.col("all_2") + F.col("d2")) / (m * m))).alias("train_renyi2"), (F.col("all_n") - F.col("gone")).alias("train_richness"), jsd.alias("jsd"))
    test = diversity(counts, [label], alphabet).select(label, "k", "shannon", "shannon_bits", "normalised", "adjusted", "renyi2", "richness")
    return test.join(train, [label, "k"]).withColumn("flag", F.when(F.col("jsd") > 0.15, "HIGH").when(F.col("jsd") > 0.10, "MOD").otherwise("LOW"))


def kmer_pca(counts: DataFrame, sample: str, k: int = 3) -> DataFrame:
    """(sample, component, share, score): principal components of the samples' k-mer profiles, not centred; largest loading of a component positive.

    The products of profiles are summed over all k-mers by Spark; only their table, a number for each pair of samples, is
    decomposed on the driver. Samples are labels, few in number.
    """
    a = counts.groupBy(sample, "k", "kmer").agg(F.sum("n").cast("double").alias("n"))
    pairs = a.select(F.col(sample).alias("a"), "k", "kmer", F.col("n").alias("x")).join(a.select(F.col(sample).alias("b"), "k", "kmer", F.col("n").alias("y")), ["k", "kmer"])
    rows = pairs.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("g")).collect()
    names = sorted({r["a"] for r in rows})
    at = {x: i for i, x in enumerate(names)}
    gram = np.zeros((len(names), len(names)))
    for r in rows:
        gram[at[r["a"]], at[r["b"]]] = r["g"]
    values, vectors = np.linalg.eigh(gram)
    made = []
    for c in range(min(k, len(names))):
        v, u = max(float(values[-1 - c]), 0.0), vectors[:, -1 - c]
        u = u * (1 if u[np.abs(u).argmax()] > 0 else -1)
        made += [(x, c + 1, v / float(values.sum()), float(u[i]) * v**0.5) for i, x in enumerate(names)]
    return counts.sparkSession.createDataFrame(made, f"{sample} string, component int, share double, score double")


def sequence_scores(df: DataFrame, ids: Sequence[str], seq: str, alphabet: str = "ACGT") -> DataFrame:
    """Entropy, information and change complexity of every sequence, from counts of letters."""
    return df.select(*ids, letter_entropy(F.col(seq), alphabet).alias("base_entropy"), information_content(F.col(seq), alphabet).alias("information"), change_complexity(F.col(seq)).alias("complexity"))


def kmer_score_profile(df: DataFrame, by: Sequence[str], seq: str, k: int, alphabet: str) -> DataFrame:
    """Mean scores of all k-mers by group: each distinct k-mer is scored once and weighs by its count."""
    counts = kmer_counts(df, by, seq, [k])
    scores = sequence_scores(counts.select("kmer").distinct(), ["kmer"], "kmer", alphabet)
    w = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    return counts.join(scores, "kmer").groupBy(*by).agg(F.sum("n").alias("n"), w("base_entropy"), w("information"), w("complexity"))


def length_gc_stats(df: DataFrame, by: Sequence[str], seq: str, gc: str = "GC") -> DataFrame:
    n = F.length(seq)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(n).alias("mean_len"), F.stddev_samp(n).alias("sd_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), safe_ratio(F.sum(count_letter(F.col(seq), gc)), F.sum(n)).alias("gc"))


def composition_features(df: DataFrame, ids: Sequence[str], seq: str) -> DataFrame:
    """GC share and skews, CpG count and ratio, and distinct 6-mers over 4^6 of every sequence; shorter ones have none."""
    g, c, a, t = (count_letter(F.col(seq), x) for x in "GCAT")
    complexity = F.when(F.length(seq) >= 6, F.size(F.array_distinct(_cut(F.col(seq), 6)))).otherwise(F.length(seq) * 0) / 4096
    cpg = (F.length(seq) - F.length(F.replace(F.col(seq), F.lit("CG"), F.lit("")))) / 2
    return df.select(*ids, safe_ratio(g + c, F.length(seq)).alias("prop_gc"), safe_ratio(g - c, g + c).alias("gc_skew"), safe_ratio(a - t, a + t).alias("at_skew"), cpg.cast("long").alias("cpg_count"), safe_ratio(cpg * F.length(seq), g * c).alias("cpg_ratio"), complexity.alias("linguistic_complexity_6"))


def pspm(df: DataFrame, seq: str, by: Sequence[str] = ()) -> DataFrame:
    """(group, pos, letter, n, freq): letters at each position."""
    at = df.select(*by, F.posexplode(F.split(seq, "")).alias("pos", "letter")).where("letter <> ''").groupBy(*by, (F.col("pos") + 1).alias("pos"), "letter").agg(F.count(F.lit(1)).alias("n"))
    whole = at.groupBy(*by, "pos").agg(F.sum("n").alias("_n"))
    return at.join(whole, [*by, "pos"]).withColumn("freq", safe_ratio(F.col("n"), F.col("_n"))).drop("_n")


def perplexity(df: DataFrame, key: str, seq: str, matrix: DataFrame) -> DataFrame:
    """exp of the mean -ln probability of a sequence's letters under a position matrix (pos, letter, freq); 4 under a uniform one."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.select(key, seq).repartition(parts, key)  # by key before letters are cut: no task sums the keys of a whole file
    at = dealt.select(key, F.posexplode(F.split(seq, "")).alias("pos", "letter")).where("letter <> ''").withColumn("pos", F.col("pos") + 1)
    known = materialise(matrix.select("pos", "letter", "freq"), "position-matrix")  # written, so that Spark knows whether it may broadcast it
    return at.join(known, ["pos", "letter"]).groupBy(key).agg(F.exp(-F.avg(F.ln("freq"))).alias("perplexity"))


def log_odds(matrix: DataFrame, motif: str, alphabet: int, pseudocount: float = 1.0) -> dict[object, tuple[np.ndarray, np.ndarray]]:
    """By motif the sorted code points of its letters, and for each position their log2 odds over a uniform alphabet.

    ``matrix`` is a ``pspm`` by ``motif``. A position's pseudocount is dealt evenly to the alphabet, so letters that it
    has not seen have a finite score: that of the last column. Collected: a row for each motif, position and letter.
    """
    cells: dict[object, dict[int, dict[int, int]]] = {}
    for r in matrix.select(motif, "pos", "letter", "n").collect():
        cells.setdefault(r[0], {}).setdefault(r["pos"], {})[ord(r["letter"])] = r["n"]
    made = {}
    for name, positions in cells.items():
        letters = np.array(sorted({c for seen in positions.values() for c in seen}), np.uint32)
        n = np.array([[positions[pos].get(int(c), 0) for c in letters] + [0] for pos in sorted(positions)], float)
        made[name] = letters, np.log2((n * alphabet + pseudocount) / (n.sum(axis=1, keepdims=True) + pseudocount))
    return made


def best_window(text: str, letters: np.ndarray, scores: np.ndarray) -> tuple[int, float] | None:
    """Start (from 1) and score of the window that fits best, the first of equal ones; None for shorter texts."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    n = len(codes) - len(scores) + 1
    if n < 1:
        return None
    at = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
    at[letters[at] != codes] = len(letters)
    total = np.zeros(n)
    for offset, row in enumerate(scores):
        total += row[at[offset : offset + n]]
    best = int(total.argmax())
    return best + 1, float(total[best])


def motif_scan(df: DataFrame, key: str, seq: str, matrix: DataFrame, motif: str, alphabet: int = 20, least: float = 0.8) -> DataFrame:
    """(key, motif, start, score): the best window of each whole sequence for each motif, at ``least`` of the motif's best score or above.

    ``matrix`` is a ``pspm`` by ``motif`` of equal-length members, named by strings; see ``log_odds``. All windows are scored; of equal
    ones the first start is reported. Nulls and sequences shorter than a motif give no row for it.
    """
    held = df.sparkSession.sparkContext.broadcast(log_odds(matrix, motif, alphabet))  # as large as the matrix, whatever the input
    schema = df.select(key, F.lit("").alias(motif), F.lit(0).alias("start"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least_of = {name: least * scores.max(axis=1).sum() - 1e-9 for name, (_, scores) in held.value.items()}
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for name, (letters, scores) in held.value.items() if text else ():
                    found = best_window(text, letters, scores)
                    if found and found[1] >= least_of[name]:
                        rows.append((i, name, *found))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            types = (b.schema.field(0).type, pa.string(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[key, motif, "start", "score"])

    return df.select(key, seq).mapInArrow(run, schema)


def simpson_of_clusters(clusters: DataFrame, by: Sequence[str], cluster: str) -> DataFrame:
    """1 - sum of squared cluster shares, and 1 - clusters over sequences, by group."""
    sizes = clusters.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("n_seqs"), (1 - F.sum(F.col("n") * F.col("n")).cast("double") / F.pow(F.sum("n"), F.lit(2.0))).alias("simpson"), (1 - F.count(F.lit(1)).cast("double") / F.sum("n")).alias("redundancy"))


def as_sequence(text: Column) -> Column:
    """Letters of a text as a sequence: upper case, without white space."""
    return F.regexp_replace(F.upper(text), r"\s", "")
