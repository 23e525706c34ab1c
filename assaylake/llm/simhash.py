"""SimHash near-dedup: fingerprints, candidate pairs by pigeonring chains, components of the links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, components, materialise, packed, parts_of, small

SEGMENTS, WIDTH = 8, 8  # 64 bits as a ring of eight bytes
MAX_BITS = 3
#: Cumulative differences allowed after 1, 2, ... consecutive segments: each its share of the budget, rounded down.
BUDGETS = [(i + 1) * MAX_BITS // SEGMENTS for i in range(SEGMENTS)]
#: Fingerprints of one key that a task compares at once; larger keys are compared block against block.
BLOCK = 512


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer; without words it is zero."""
    parts = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not parts:
        return 0
    joined = memoryview(b" ".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts, ends[len(parts) - n :].tolist(), strict=True)], dtype=">u8")
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        bits += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3) -> DataFrame:
    """(doc_id, fp): a signed 64-bit fingerprint for each row; a null or blank text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            fps = pa.array([fingerprint(t, words) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], names=["doc_id", "fp"])

    return docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def ring_keys(fps: np.ndarray) -> np.ndarray:
    """The 24 keys of each fingerprint, shape (n, 24).

    Of two fingerprints within three bits, some start on the ring has chains within all budgets
    0, 0, 1, 1, 1, 2, 2, 3: its first two segments agree, and so do at least two of the next
    three. A key names the start, which of the three is left out, and the four segments that agree.
    """
    seg = fps.astype(">i8").view(np.uint8).reshape(-1, SEGMENTS).astype(np.int64)
    keys = []
    for start in range(SEGMENTS):
        a, b, c, d, e = (seg[:, (start + k) % SEGMENTS] for k in range(5))
        for skip, (x, y) in enumerate(((d, e), (c, e), (c, d))):
            keys.append((start * 3 + skip) << 32 | a << 24 | b << 16 | x << 8 | y)
    return np.stack(keys, axis=1)


def within_budgets(x: np.ndarray, y: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Whether the chain from ``start`` keeps its budgets; the last one is the full Hamming check."""
    diff = np.bitwise_count((x ^ y).astype(">i8").view(np.uint8)).reshape(*np.broadcast(x, y).shape, SEGMENTS)
    ring = (np.asarray(start)[..., None] + np.arange(SEGMENTS)) % SEGMENTS
    turned = np.take_along_axis(diff, np.broadcast_to(ring, diff.shape), axis=-1)
    return (np.cumsum(turned, axis=-1) <= BUDGETS).all(axis=-1)


def _tree(fps: np.ndarray, start: int) -> tuple[list[int], list[int]]:
    """A spanning forest of one key's links: each fingerprint is compared with those not yet reached."""
    u, v, rest = [], [], fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            near = within_budgets(rest, np.full_like(rest, at := front.pop()), start)
            u += rest[near].tolist()
            v += [int(at)] * int(near.sum())
            front += list(rest[near])
            rest = rest[~near]
    return u, v


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within groups of equal (key, part), which come sorted: a forest for each group."""
    held = np.zeros((3, 0), np.int64)

    def groups(rows: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]), [True]]))
        sizes = np.diff(cuts)
        u, v = [], []
        twos = cuts[:-1][sizes == 2]
        x, y = rows[2, twos], rows[2, twos + 1]
        ok = within_budgets(x, y, (rows[0, twos] >> 32) // 3)
        u += x[ok].tolist()
        v += y[ok].tolist()
        for at, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            a, b = _tree(np.unique(rows[2, at : at + n]), int(rows[0, at] >> 32) // 3)
            u += a
            v += b
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for b in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])], axis=1) if b.num_rows else held
        if not rows.shape[1]:
            continue
        last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
        cut = int(np.flatnonzero(last)[0])
        held = rows[:, cut:]
        if cut:
            yield groups(rows[:, :cut])
    if held.shape[1]:
        yield groups(held)


def near_links(fps: DataFrame, fp: str = "fp", block: int = BLOCK) -> DataFrame:
    """(u, v): links between distinct fingerprints of at most three differing bits.

    Not every pair, but for each key a forest with the same connected fingerprints, so a large
    group gives as many links as it has members. Keys of more than ``block`` members are cut by a
    fifth segment that agrees, and what is still larger is compared part against part, in tasks of bounded size.
    """
    distinct = fps.where(F.col(fp).isNotNull()).select(F.col(fp).alias("fp")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ring_keys(x).ravel()), pa.array(np.repeat(x, 24))], names=["key", "fp"])

    keys = materialise(distinct.mapInArrow(run, "key long, fp long"), "ring-keys")
    sizes = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "ring-key-sizes")  # written, so that Spark can split a hot key
    shared = keys.join(sizes, "key")
    # Four segments agree; of the other four, with three bits between them, one agrees as well, by which large keys are cut.
    start, skipped = F.floor(F.shiftright("key", 32) / 3), F.shiftright("key", 32) % 3 + 2
    byte = lambda i: F.call_function("shiftright", F.col("fp"), (F.lit(56) - (start + i) % SEGMENTS * 8).cast("int")).bitwiseAND(F.lit(255))
    cuts = F.transform(F.array(skipped, F.lit(5), F.lit(6), F.lit(7)), lambda i: (i * 256 + byte(i).cast("long")).cast("int"))
    large = materialise(shared.where(F.col("n") > block).select("key", F.explode(cuts).alias("cut"), "fp"), "large-ring-keys")
    cut_sizes = materialise(large.groupBy("key", "cut").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "cut-key-sizes")
    whole = shared.where(F.col("n") <= block).select("key", F.lit(0).alias("cut"), "fp", "n")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda j: j != own)
    code = F.transform(others, lambda j: F.least(own, j).cast("long") * blocks + F.greatest(own, j))
    parted = whole.unionByName(large.join(cut_sizes, ["key", "cut"]).select("key", "cut", "fp", "n"))
    part = F.explode(F.when(F.col("n") <= block, F.array(F.lit(0).cast("long"))).otherwise(code))
    parted = parted.select("key", "cut", "fp", part.alias("part")).select("key", (F.col("part") * 2048 + F.col("cut")).alias("part"), "fp")
    dealt = parted.repartition(parts_of(fps), "key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(_links, "u long, v long")


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp, component_id for each row: fingerprints link at three or fewer differing bits, equal ones always.

    component_id is the smallest doc_id reachable over links (null ids are passed over). Null and
    blank texts share fingerprint zero and link like any other; repeated rows give a row each; no
    rows give no rows; other columns are not read.
    """
    prints = materialise(fingerprints(docs, text, doc_id), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(prints))
    rooted = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(of_root, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each component, that of the smallest id, with all its columns, whatever their names.

    Ids name documents: rows that share the id that stays all stay. Rows with a null id take no part: they stay, and
    make no other go. Null and blank texts link with one another; no rows give no rows.
    """
    named = docs.where(col(doc_id).isNotNull())
    keep = simhash_components(named, text, doc_id).where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    rows = packed(named, id=col(doc_id).cast("long"))
    return rows.join(keep, F.col("id") == F.col("kept"), "left_semi").select("row.*").unionByName(docs.where(col(doc_id).isNull()))
