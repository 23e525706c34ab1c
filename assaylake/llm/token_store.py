"""Token-id output: blocks of ids under an adaptive context-mixing range coder, each reset and checksummed by itself.

A block codes up to ``BLOCK`` ids. Order-2 and order-1 contexts each predict an id; whether a
prediction holds is coded with a probability mixed from what the contexts' confidences and the
recent hits say. Ids that no prediction meets are coded by adaptive order-0 statistics, four bits
at a time. All arithmetic is in whole numbers, so any machine decodes what another wrote. Blocks
know nothing of one another, so a worker codes many in step, one array lane each.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, materialise, parts_of, small

#: Short blocks, many in step: each step's array calls serve many ids, and the models of all lanes stay small.
BLOCK = 1024
#: Blocks that are coded in step; a writer gathers so many before it codes.
LANES = 2048
MAGIC = b"CMR1"
#: magic, ids, documents that start here, bytes of the code, checksum of all that follows.
HEAD = struct.Struct("<4sIIII")
DOC = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("n_tokens", "<u4")])
END = 2

U = np.uint64
TOP, BOT = U(1 << 48), U(1 << 32)
SLOTS1, SLOTS2, CONTEXTS = 1 << 9, 1 << 10, 1 + 16 + 64 + 128
#: After a nibble the cumulative counts move a 32nd of the way to one that is all that nibble, less a floor of 32 for each.
_RISE = np.array([[(16384 - 16 * 32 if i > s else 0) + 32 * i for i in range(17)] for s in range(16)], np.int16)


class _Lanes:
    """Range coder and models of many blocks in step; the coder writes if ``codes`` is None, else it reads."""

    def __init__(self, n: int, codes: list[bytes] | None = None):
        self.n, self.low, self.range = n, np.zeros(n, U), np.full(n, (1 << 64) - 1, U)
        self.at, self.reading = np.zeros(n, np.int64), codes is not None
        if self.reading:
            most = max([8, *map(len, codes)])
            self.words = np.frombuffer(b"".join(c.ljust(most + 8 + most % 2, b"\0") for c in codes), ">u2").reshape(n, -1).astype(U)
            self.code = self.words[:, 0] << U(48) | self.words[:, 1] << U(32) | self.words[:, 2] << U(16) | self.words[:, 3]
            self.at += 4
        else:
            self.words = np.zeros((n, BLOCK // 2), np.uint16)
        # Models of all lanes lie flat, one lane after another.
        self.pred1, self.conf1 = np.zeros(n * SLOTS1, np.uint16), np.zeros(n * SLOTS1, np.uint8)
        self.pred2, self.conf2 = np.zeros(n * SLOTS2, np.uint16), np.zeros(n * SLOTS2, np.uint8)
        self.by_conf, self.by_past, self.second = (np.full(n * k, 16384, np.int32) for k in (64, 16, 8))
        self.weight = np.full(n, 128, np.int32)
        self.past = np.zeros(n, np.int64)
        self.nibbles = np.tile((np.arange(17) * 1024).astype(np.int16), (n * CONTEXTS, 1))
        self.last1, self.last2 = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def _of(self, lanes: np.ndarray) -> np.ndarray | slice:
        """Lanes are distinct and in order: all of them need no lookup."""
        return slice(None) if len(lanes) == self.n else lanes

    def _narrow(self, lanes: np.ndarray, r: np.ndarray, cum: np.ndarray, freq: np.ndarray) -> None:
        """Take the share [cum, cum + freq) of each range of steps ``r``; move settled words out or in."""
        some = self._of(lanes)
        low, rng = self.low[some] + cum.astype(U) * r, r * freq.astype(U)
        self.low[some], self.range[some] = low, rng
        settled = (low ^ (low + rng)) < TOP
        due = settled | (rng < BOT)
        while due.any():
            lanes, settled = lanes[due], settled[due]
            low, rng = self.low[lanes], self.range[lanes]
            rng = np.where(settled, rng, (~low + U(1)) & (BOT - U(1)))  # a range across a carry is cut short
            at = self.at[lanes]
            if self.reading:
                self.code[lanes] = self.code[lanes] << U(16) | self.words[lanes, np.minimum(at, self.words.shape[1] - 1)]
            else:
                if at.max() >= self.words.shape[1]:
                    self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
                self.words[lanes, at] = low >> U(48)
            self.at[lanes] = at + 1
            low, rng = low << U(16), rng << U(16)
            self.low[lanes], self.range[lanes] = low, rng
            settled = (low ^ (low + rng)) < TOP
            due = settled | (rng < BOT)

    def _bit(self, lanes: np.ndarray, p: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
        """Code a bit that is one with probability p / 32768."""
        some = self._of(lanes)
        r = self.range[some] >> U(15)
        if self.reading:
            bit = (self.code[some] - self.low[some]) < p.astype(U) * r
        self._narrow(lanes, r, np.where(bit, 0, p), np.where(bit, p, 32768 - p))
        return bit

    def _nibble(self, lanes: np.ndarray, context: np.ndarray, value: np.ndarray | None) -> np.ndarray:
        row = lanes * CONTEXTS + context
        counts = self.nibbles.take(row, axis=0)
        r = self.range[lanes] >> U(14)
        if self.reading:
            target = np.minimum((self.code[lanes] - self.low[lanes]) // r, U(16383)).astype(np.int16)
            value = (counts[:, 1:16] <= target[:, None]).sum(axis=1)
        at = np.arange(0, 17 * len(row), 17) + value
        flat = counts.ravel()
        cum = flat.take(at)
        self._narrow(lanes, r, cum, flat.take(at + 1) - cum)
        rise = _RISE.take(value, axis=0)
        rise -= counts
        rise >>= 5
        counts += rise
        self.nibbles[row] = counts
        return value

    def step(self, lanes: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        """Code the next id of each of ``lanes``."""
        some = self._of(lanes)
        last1 = self.last1[some]
        h1 = ((last1 * 40503 >> 4) & (SLOTS1 - 1)) + lanes * SLOTS1
        h2 = (((last1 * 31321 + self.last2[some] * 51197) >> 3) & (SLOTS2 - 1)) + lanes * SLOTS2
        p1, c1 = self.pred1.take(h1).astype(np.int64), self.conf1.take(h1).astype(np.int64)
        p2, c2 = self.pred2.take(h2).astype(np.int64), self.conf2.take(h2).astype(np.int64)
        first = np.where(c2 > 0, p2, p1)
        ctx, past = lanes * 64 + c2 * 8 + c1, lanes * 16 + self.past[some] * 2 + (p1 == p2)
        a, b, w = self.by_conf.take(ctx), self.by_past.take(past), self.weight[some]
        p = np.clip((a * w + b * (256 - w)) >> 8, 32, 32736)
        hit = self._bit(lanes, p, None if self.reading else ids == first)
        goal = np.where(hit, 32768, 0)
        self.weight[some] = np.clip(w + np.where(np.abs(goal - a) < np.abs(goal - b), 2, -2), 16, 240)
        self.by_conf[ctx], self.by_past[past] = a + ((goal - a) >> 5), b + ((goal - b) >> 5)
        self.past[some] = (self.past[some] * 2 + hit) & 7
        out = first.copy() if self.reading else ids
        again = np.flatnonzero(~hit & (c2 > 0) & (c1 > 0) & (p1 != p2))
        rest = ~hit
        if len(again):
            own = lanes[again]
            at = own * 8 + c1[again]
            q = self.second[at]
            met = self._bit(own, np.clip(q, 32, 32736), None if self.reading else ids[again] == p1[again])
            self.second[at] = q + ((np.where(met, 32768, 0) - q) >> 5)
            rest[again] = ~met
            if self.reading:
                out[again] = p1[again]
        left = np.flatnonzero(rest)
        if len(left):
            own = lanes[left]
            v = None if self.reading else ids[left]
            n1 = self._nibble(own, np.zeros(len(own), np.int64), None if v is None else v >> 12)
            n2 = self._nibble(own, 1 + n1, None if v is None else v >> 8 & 15)
            n3 = self._nibble(own, 17 + ((n1 * 16 + n2) * 37 >> 2 & 63), None if v is None else v >> 4 & 15)
            n4 = self._nibble(own, 81 + ((n1 * 256 + n2 * 16 + n3) * 167 >> 3 & 127), None if v is None else v & 15)
            if self.reading:
                out[left] = n1 << 12 | n2 << 8 | n3 << 4 | n4
        for pred, conf, h, was, c in ((self.pred1, self.conf1, h1, p1, c1), (self.pred2, self.conf2, h2, p2, c2)):
            same = was == out
            pred[h] = np.where(c == 0, out, was)
            conf[h] = np.where(c == 0, 1, np.where(same, np.minimum(c + 1, 7), c >> 1))
        self.last2[some], self.last1[some] = last1.copy(), out
        return out

    def codes(self) -> list[bytes]:
        """The written codes: four words more than settled fix the last range."""
        out = []
        for i in range(self.n):
            tail = int(self.low[i]).to_bytes(8, "big")
            out.append(self.words[i, : self.at[i]].astype(">u2").tobytes() + tail)
        return out


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The codes of blocks of ids below 65536, LANES of them in step."""
    out: list[bytes] = []
    for at in range(0, len(blocks), LANES):
        some = blocks[at : at + LANES]
        sizes = np.array([len(b) for b in some])
        grid = np.zeros((max([0, *sizes]), len(some)), np.int32)
        for i, b in enumerate(some):
            grid[: len(b), i] = b
        coder, lanes = _Lanes(len(some)), np.arange(len(some))
        for t in range(len(grid)):
            live = lanes[sizes > t]
            coder.step(live, grid[t, live])
        out += coder.codes()
    return out


def decode_blocks(codes: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each code, of which there are as many as ``sizes`` says."""
    out: list[np.ndarray] = []
    for at in range(0, len(codes), LANES):
        n = np.array(sizes[at : at + LANES])
        coder, lanes = _Lanes(len(n), codes[at : at + LANES]), np.arange(len(n))
        grid = np.zeros((max([0, *n]), len(n)), np.int32)
        for t in range(len(grid)):
            live = lanes[n > t]
            grid[t, live] = coder.step(live, None)
        out += [grid[:k, i].astype("<u4") for i, k in enumerate(n)]
    return out


def pack(code: bytes, n_tokens: int, docs: list[tuple[int | None, int]]) -> bytes:
    """A block of the file: its head, the documents that start in it, the code."""
    starts = np.array([(i is None, i or 0, n) for i, n in docs], DOC).tobytes()
    body = starts + code
    return HEAD.pack(MAGIC, n_tokens, len(docs), len(code), zlib.crc32(body)) + body


def unpack(block: bytes) -> tuple[bytes, int, list[tuple[int | None, int]]]:
    """The parts of a block; a checksum that does not fit is an error."""
    magic, n_tokens, n_docs, n_code, crc = HEAD.unpack_from(block)
    body = block[HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != crc or len(body) != n_docs * DOC.itemsize + n_code:
        raise ValueError("a token block is damaged")
    docs = [(None if d["null"] else int(d["doc_id"]), int(d["n_tokens"])) for d in np.frombuffer(body, DOC, n_docs)]
    return body[n_docs * DOC.itemsize :], n_tokens, docs


def checked(code: bytes, ids: np.ndarray) -> bytes:
    """A block's code after a checksum of its ids, so that a fault of the decoder shows as well."""
    return zlib.crc32(ids.astype("<u4").tobytes()).to_bytes(4, "little") + code


def opened(codes: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of ``checked`` codes; ids that do not fit their checksum are an error."""
    found = decode_blocks([c[4:] for c in codes], sizes)
    if any(zlib.crc32(ids.tobytes()) != int.from_bytes(c[:4], "little") for c, ids in zip(codes, found, strict=True)):
        raise ValueError("a token block decodes to other ids")
    return found


class Vocabulary:
    """The library's ids of whole texts. Words come again and again, so their ids are remembered.

    With ``added_tokens`` the string of an added token (such as <|endoftext|>) gives that token, as the library does
    by default; without, it is ordinary text.
    """

    #: White space other than blank and newline: texts that hold it, or an added token's string, are encoded in one piece.
    OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f]")

    def __init__(self, path: str, remembered: int = 200_000, added_tokens: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if not added_tokens:
            self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def ids(self, text: str) -> np.ndarray:
        if self.OTHER_SPACE.search(text) or any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        # White space after something else always starts a new piece, so what lies between stands by itself.
        chunks = re.findall(r"[ \n]*[^ \n]+|[ \n]+", text)
        known = self.known
        if missing := [c for c in set(chunks) if c not in known]:
            if len(known) + len(missing) > self.remembered:
                known.clear()
                missing = list(set(chunks))
            for c, e in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True):
                known[c] = np.array(e.ids, "<u4").tobytes()
        return np.frombuffer(b"".join([known[c] for c in chunks]), "<u4")


@lru_cache(maxsize=2)
def vocabulary(path: str, added_tokens: bool = False) -> Vocabulary:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Vocabulary(path, added_tokens=added_tokens)


def write_tokens(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", end: int = END, added_tokens: bool = False) -> DataFrame:
    """The files' blocks (part, block, n_tokens, data) of all documents in ascending id, ``end`` after each.

    A part is a range of ids, written in order by one task that gathers LANES blocks at most.
    Whole texts; null counts as empty; a null id comes first; repeated rows come each; no rows
    give no blocks; other columns are not read. Store ``data`` anywhere: a block decodes by itself.
    ``added_tokens``: see ``Vocabulary``. An id of 65,536 or more is an error, as the format holds none.
    """
    parts = parts_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        held, size, starts = [], 0, []  # ids and documents not yet written

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, size, starts, block
            flat = np.concatenate(held) if held else np.zeros(0, np.uint32)
            n = -(-len(flat) // BLOCK) if last else len(flat) // BLOCK
            pieces = [flat[i * BLOCK : (i + 1) * BLOCK] for i in range(n)]
            inside: list[list] = [[] for _ in range(n + 1)]
            for at, i, k in starts:
                inside[min(at // BLOCK, n)].append((i, k) if at < n * BLOCK else (at, i, k))
            rows = [pack(checked(c, p), len(p), d) for c, p, d in zip(encode_blocks(pieces), pieces, inside, strict=False)]
            held, size, starts = [flat[n * BLOCK :]], len(flat) - min(len(flat), n * BLOCK), [(at - n * BLOCK, i, k) for at, i, k in inside[n]]
            block += n
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(block - n, block), pa.int64()), pa.array([len(p) for p in pieces], pa.int64()), pa.array(rows, pa.binary())], names=["part", "block", "n_tokens", "data"])

        for b in small(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(vocabulary(path, added_tokens).ids(t or ""), np.uint32(end))
                if ids.max() >= 1 << 16:
                    raise ValueError(f"token id {ids.max()} of document {i}: this format holds ids below 65,536")
                starts.append((size, i, len(ids)))
                held.append(ids)
                size += len(ids)
                if size >= LANES * BLOCK:
                    yield flush(False)
        if size:
            yield flush(True)

    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, "part int, block long, n_tokens long, data binary")


def read_tokens(blocks: DataFrame) -> DataFrame:
    """doc_id, part, start (in the part), n_tokens, ids_crc32 of each document, from the blocks alone."""
    parts = parts_of(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue: list[tuple[int, bytes]] = []
        part, at, begun = None, 0, None  # begun: the document at hand and its ids yet to come

        def drain() -> pa.RecordBatch:
            nonlocal part, at, begun
            rows: list[tuple] = []
            blocks = [unpack(data) for _, data in queue]
            for (own, _), ids, (_, _, docs) in zip(queue, opened([b[0] for b in blocks], [b[1] for b in blocks]), blocks, strict=True):
                if own != part:
                    part, at, begun = own, 0, None
                raw, here, nexts = ids.tobytes(), 0, iter(docs)
                while here < len(ids):
                    if begun is None:
                        i, n = next(nexts)
                        begun = [i, at + here, n, n, 0]
                    take = min(begun[3], len(ids) - here)
                    begun[4] = zlib.crc32(raw[4 * here : 4 * (here + take)], begun[4])
                    begun[3] -= take
                    here += take
                    if not begun[3]:
                        rows.append((begun[0], part, begun[1], begun[2], begun[4]))
                        begun = None
                at += len(ids)
            queue.clear()
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "part", "start", "n_tokens", "ids_crc32"])

        for b in small(batches):
            queue += zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True)
            if len(queue) >= LANES:
                yield drain()
        if queue:
            yield drain()

    ordered = blocks.select("part", "block", "data").repartitionByRange(parts, "part").sortWithinPartitions("part", "block")
    return ordered.mapInArrow(run, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, path: str, added_tokens: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from files written to the shared folder and read back.

    Null texts count as empty, null ids come first, repeated rows come each; no rows give no rows.
    """
    blocks = materialise(write_tokens(docs, path, added_tokens=added_tokens), "token-blocks")
    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each part
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    return read_tokens(blocks).join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
