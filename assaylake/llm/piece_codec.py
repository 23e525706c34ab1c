"""Offset-preserving SentencePiece encoding: character-map normalisation with alignment, pieces projected to bytes."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, small, with_columns

SPACE = "▁"
#: Chunks of which a worker remembers the ids.
CACHE = 200_000


class CharMap:
    """A compiled character map: a double-array trie of source strings and their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[bytes, int]:
        """The replacement of the longest mapped prefix of ``source[at:]`` and its length; else one character as it is."""
        units, found, node, i = self.units, None, 0, at
        if units:
            node = units[0] >> 10 << ((units[0] & 512) >> 6)
            while i < len(source):
                node ^= source[i]
                unit = units[node]
                if unit & 0x800000FF != source[i]:
                    break
                i += 1
                node ^= unit >> 10 << ((unit & 512) >> 6)
                if unit >> 8 & 1:
                    found = units[node] & 0x7FFFFFFF, i - at
        if found:
            return self.strings[found[0] : self.strings.index(b"\0", found[0])], found[1]
        lead = source[at]
        n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return source[at : at + n], n


class PieceCodec:
    """The model at ``path``: normalises with alignment, encodes, projects pieces to original bytes, decodes."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.spec = proto.normalizer_spec
        self.map = CharMap(self.spec.precompiled_charsmap)
        pieces = [p.piece for p in proto.pieces]
        self.widths = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)  # type 6: one byte
        # No piece goes on past a space mark, so what lies between the marks merges by itself.
        splits = proto.trainer_spec.model_type == 2 and proto.trainer_spec.byte_fallback and not any(SPACE in p.lstrip(SPACE) for p in pieces) and not any(p.type == 4 for p in proto.pieces)
        self.by_chunk = splits and not self.map.units and self.spec.escape_whitespaces and self.spec.add_dummy_prefix and not self.spec.remove_extra_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
        self.known: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end the offset of its source byte in ``text``'s UTF-8."""
        raw = text.encode()
        mark = SPACE.encode() if self.spec.escape_whitespaces else b" "
        if not raw:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.spec.remove_extra_whitespaces:  # nothing to look up: only spaces change
            widths = np.where(np.frombuffer(raw, np.uint8) == 32, len(mark), 1)
            start = mark if self.spec.add_dummy_prefix else b""
            source = np.repeat(np.arange(len(raw)), widths)
            return start + raw.replace(b" ", mark), np.concatenate([np.zeros(len(start), np.int64), source, [len(raw)]])
        out, source, at, strip = bytearray(), [], 0, self.spec.remove_extra_whitespaces
        while strip and at < len(raw):
            new, n = self.map.longest(raw, at)
            if new.strip(b" "):
                break
            at += n
        if at == len(raw):
            return b"", np.zeros(1, np.int64)
        if self.spec.add_dummy_prefix:
            out += mark
            source += [at] * len(mark)
        spaced = strip
        while at < len(raw):
            new, n = self.map.longest(raw, at)
            if spaced:
                new = new.lstrip(b" ")
            for b in new:
                piece = mark if b == 32 else bytes([b])
                out += piece
                source += [at] * len(piece)
            spaced = strip and (new.endswith(b" ") if new else spaced)
            at += n
        while strip and out.endswith(mark):  # what is left out at the end belongs to no piece
            at = source[-len(mark)]
            del out[-len(mark) :], source[-len(mark) :]
        return bytes(out), np.array([*source, at], np.int64)

    def ids(self, text: str, norm: bytes) -> np.ndarray:
        """The ids of the normalised text, without begin and end."""
        if not norm:
            return np.zeros(0, np.uint32)
        if not self.by_chunk:
            return np.array(self.sp.encode(text), np.uint32)
        chunks = re.findall(f"{SPACE}+[^{SPACE}]*", norm.decode())
        known = self.known
        if missing := [c for c in set(chunks) if c not in known]:
            if len(known) > CACHE:
                known.clear()
                missing = list(set(chunks))
            # The library puts one space mark before each; a lone mark is its own piece.
            plain = [c[1:].replace(SPACE, " ") for c in missing]
            for c, ids in zip(missing, self.sp.encode(plain, num_threads=1), strict=True):
                known[c] = np.array(ids or [self.sp.piece_to_id(SPACE)], "<u4").tobytes()
        return np.frombuffer(b"".join([known[c] for c in chunks]), "<u4")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids with begin and end, and for each the span of original bytes (start, end) that it covers."""
        norm, source = self.normalise(text)
        body = self.ids(text, norm)
        cuts = np.concatenate([[0], np.cumsum(self.widths[body])])
        if cuts[-1] != len(norm):
            raise ValueError("pieces do not tile the normalised text")
        spans = np.stack([source[cuts[:-1]], source[cuts[1:]]], axis=1) if len(body) else np.zeros((0, 2), np.int64)
        ends = [[0, 0]], spans, [[source[-1]] * 2]
        return np.concatenate([[self.sp.bos_id()], body, [self.sp.eos_id()]]).astype("<u4"), np.concatenate(ends).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with piece_ids, piece_starts and piece_ends: ids with begin and end, and the original byte span of each.

    Whole texts, exactly the library's ids; null counts as empty (begin and end only). Input columns
    of these names are replaced, others stay whatever their names; repeated rows give a row each; no rows give no rows.
    """

    def encode(texts: pa.Array) -> list[pa.Array]:
        rows = [codec(path).encode(t or "") for t in texts.to_pylist()]
        columns = [i for i, _ in rows], [s[:, 0] for _, s in rows], [s[:, 1] for _, s in rows]
        return [pa.array([x.astype(np.int64) for x in c], pa.list_(pa.int64())) for c in columns]

    return with_columns(docs, text, encode, **dict.fromkeys(("piece_ids", "piece_starts", "piece_ends"), "array<bigint>"))


def decode_pieces(encoded: DataFrame, path: str, ids: str = "piece_ids") -> DataFrame:
    """``encoded`` with decoded, the text that the library makes of the ids; null ids give the empty text; other columns stay."""

    def decode(rows: pa.Array) -> list[pa.Array]:
        return [pa.array([codec(path).sp.decode(x or []) for x in rows.to_pylist()], pa.string())]

    return with_columns(encoded, ids, decode, decoded="string")


def piece_digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32 of each whole text: ``encode_pieces`` and decoding in one pass.

    The arrays stay in the worker, so that a corpus does not cross to the JVM twice. Null counts as
    empty; repeated rows give a row each; no rows give no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in small(batches):
            rows = []
            for t in b.column(1).to_pylist():
                ids, spans = c.encode(t or "")
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest(), zlib.crc32(spans.astype("<i8").tobytes())))
            n, i, d, s = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string()), pa.array(s, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
