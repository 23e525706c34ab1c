"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point alone. A letter with its two neighbours is bound
to one vector, the product of the three, each rotated by its place; what is no letter stands for a space. A document
bundles the vectors of all its letters, a language those of its documents, and documents are compared with languages by
cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, materialise, packed, parts_of, small, with_columns

#: Length of all vectors.
DIMENSIONS = 2048
#: Vectors of distinct letter groups made at a time; a long text holds more.
AT_ONCE = 4096
#: Characters whose groups are counted at a time.
CHARACTERS = 1 << 20
#: Languages held by a task at a time; of more, documents pass block after block.
BLOCK = 1024
#: A document's vector adds to its language at this length, in whole numbers, so that sums are the same in any order.
UNIT = 1 << 20
UNDETERMINED = "und"
ADDED = ("lang_pred", "score")


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@lru_cache(maxsize=8192)
def letter_vector(code: int) -> np.ndarray:
    """+1 and -1 from a counter generator keyed by the code point: the same on every machine."""
    bits = np.random.Philox(key=code).random_raw(DIMENSIONS // 64)
    return np.unpackbits(bits.astype("<u8").view(np.uint8)).astype(np.int8) * 2 - 1


def letter_groups(pieces: list[tuple[int, str, bool, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, group's number, count) of the groups of (document, piece of its text, flags), and the groups: left, letter, right.

    The flags say whether a piece's first and last character are only there as neighbours.
    """
    codes = np.frombuffer("\n".join(["", *[p for _, p, _, _ in pieces], ""]).encode("utf-32-le", "replace"), "<u4")
    lengths = np.array([len(p) + 1 for _, p, _, _ in pieces], np.int64)
    letter = _is_letter()[codes]
    spaced = np.where(letter, codes, 32)
    ends = np.cumsum(lengths)
    letter[(ends - lengths + 1)[[lead for _, _, lead, _ in pieces]]] = False
    letter[(ends - 1)[[tail for _, _, _, tail in pieces]]] = False
    at = np.flatnonzero(letter)
    if not len(at):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros((0, 3), int)
    seen = np.zeros(0x110000, bool)
    seen[spaced] = True
    used = np.flatnonzero(seen)
    a = len(used)
    numbers = np.zeros(0x110000, np.int64)
    numbers[used] = np.arange(a)
    place = numbers[spaced]
    doc = np.repeat(np.array([d for d, _, _, _ in pieces]), lengths)[at - 1]
    key, n = np.unique(((doc * a + place[at - 1]) * a + place[at]) * a + place[at + 1], return_counts=True)
    ways, which = np.unique(key % a**3, return_inverse=True)
    return key // a**3, which, n, np.stack([used[ways // (a * a)], used[ways // a % a], used[ways % a]], axis=1)


def _pieces(texts: list[str | None]) -> Iterator[list[tuple[int, str, bool, bool]]]:
    """The lower-cased texts in lists of pieces of ``CHARACTERS`` together, about; a longer text is cut, each piece with a neighbour either side."""
    held, size = [], 0
    for doc, text in enumerate(texts):
        whole = (text or "").lower()
        for at in range(0, len(whole), CHARACTERS):
            end = at + CHARACTERS
            held.append((doc, whole[max(at - 1, 0) : end + 1], at > 0, end < len(whole)))
            size += len(held[-1][1])
            if size >= CHARACTERS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _bound(groups: np.ndarray) -> np.ndarray:
    """The vectors of letter groups: products of rotated letter vectors."""
    used, place = np.unique(groups, return_inverse=True)
    letters = np.stack([letter_vector(int(c)) for c in used])
    place = place.reshape(groups.shape)
    return np.roll(letters, 2, axis=1)[place[:, 0]] * np.roll(letters, 1, axis=1)[place[:, 1]] * letters[place[:, 2]]


def profiles(texts: list[str | None]) -> np.ndarray:
    """The bundled vector of every text, in float32 (whole numbers, exact up to 16 million letters); zeros without letters."""
    made = np.zeros((len(texts), DIMENSIONS), np.float32)
    for pieces in _pieces(texts):
        doc, which, n, ways = letter_groups(pieces)
        order = np.argsort(which, kind="stable")
        which, doc, n = which[order], doc[order], n[order]
        for start in range(0, len(ways), AT_ONCE):
            lo, hi = np.searchsorted(which, [start, start + AT_ONCE])
            docs, row = np.unique(doc[lo:hi], return_inverse=True)
            table = np.zeros((len(docs), min(AT_ONCE, len(ways) - start)), np.float32)
            table[row, which[lo:hi] - start] = n[lo:hi]
            made[docs] += table @ _bound(ways[start : start + AT_ONCE]).astype(np.float32)
    return made


def _sums(batches: Iterator[tuple[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    give = lambda: pa.RecordBatch.from_pydict({"lang": pa.array(list(held), pa.string()), "vector": pa.array([v.tobytes() for v in held.values()], pa.binary())})
    for lang, vector in batches:
        if lang in held:
            held[lang] += vector
        else:
            held[lang] = vector.copy()
            if len(held) >= BLOCK:
                yield give()
                held.clear()
    if held:
        yield give()


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, vector): a prototype for each language of ``docs``, the sum of its documents' vectors at equal length.

    Tasks sum what they read, then tasks by language and a salt sum those sums, so a language that holds most rows is
    many tasks' work. Rows whose language is null or whose text has no letter teach nothing; repeated rows count again.
    The table is written once; it has a row for each language.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[str, np.ndarray]]:
            for b in small(batches):
                vectors = profiles(b.column(1).to_pylist()).astype(np.float64)
                size = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
                whole = np.rint(vectors / np.maximum(size, 1e-9) * UNIT).astype("<i8")
                names = np.array(b.column(0).to_pylist(), object)
                for name in {x for x, s in zip(names, size[:, 0], strict=True) if s > 0}:
                    yield name, whole[(names == name) & (size[:, 0] > 0)].sum(axis=0)

        yield from _sums(each())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sums((name, np.frombuffer(v, "<i8")) for b in batches for name, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))

    schema, parts = "lang string, vector binary", parts_of(docs)
    rows = docs.where(col(lang).isNotNull() & col(text).isNotNull()).select(col(lang).cast("string").alias("lang"), col(text).alias("text"))
    partial = rows.mapInArrow(learn, schema).withColumn("salt", F.spark_partition_id() % 64).repartition(parts, "lang", "salt").drop("salt").mapInArrow(add, schema)
    return materialise(partial.repartition(parts, "lang").mapInArrow(add, schema), "language-prototypes")


def identify(docs: DataFrame, prototypes: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, the language of the nearest prototype, and ``score``, its cosine, 0 if negative.

    Of equal cosines the first language in byte order is taken. A text that is null or has no letter is ``und`` at score
    0, as is every text where nothing was learned. Repeated rows give the same; an empty table gives none; columns of the
    result's names are replaced. Texts are handled whole, in bounded memory: distinct letter groups go in blocks.
    """
    rows = packed(docs, without=ADDED, text=col(text))
    found = rows.select("row", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    langs = prototypes.count()
    for n, block in enumerate(_blocks(prototypes, langs)):
        rows = _against(rows, block, earlier=n > 0)
        found = rows
    return found.select("row.*", "lang_pred", "score")


def _blocks(prototypes: DataFrame, langs: int) -> Iterator[list[tuple[str, bytes]]]:
    """Prototypes in byte order of their names, ``BLOCK`` on the driver at a time."""
    after = None
    for _ in range(-(-langs // BLOCK)):
        rows = (prototypes if after is None else prototypes.where(F.col("lang") > after)).orderBy("lang").limit(BLOCK).collect()
        after = rows[-1]["lang"]
        yield [(r["lang"], bytes(r["vector"])) for r in rows]


def _against(rows: DataFrame, block: list[tuple[str, bytes]], earlier: bool) -> DataFrame:
    """``rows`` with the nearest language of this block and its cosine, or what earlier blocks gave, if that is as near."""
    names = np.array([n for n, _ in block], object)
    matrix = np.stack([np.frombuffer(v, "<i8") for _, v in block]).astype(np.float64)
    matrix = (matrix / np.maximum(np.sqrt((matrix * matrix).sum(axis=1, keepdims=True)), 1e-9)).T
    held = rows.sparkSession.sparkContext.broadcast((names, matrix))  # BLOCK vectors at most

    def nearest(texts: pa.Array) -> list[pa.Array]:
        names, matrix = held.value
        vectors = profiles(texts.to_pylist()).astype(np.float64)
        size = np.sqrt((vectors * vectors).sum(axis=1))
        cosines = np.clip(np.round(vectors @ matrix / np.maximum(size, 1e-9)[:, None], 12), 0, 1)  # alike in any slice
        at = cosines.argmax(axis=1)
        return [pa.array(list(np.where(size > 0, names[at], UNDETERMINED)), pa.string()), pa.array(np.where(size > 0, cosines[np.arange(len(at)), at], 0.0))]

    if not earlier:
        return with_columns(rows, "text", nearest, lang_pred="string", score="double")
    both = with_columns(rows.withColumnsRenamed({"lang_pred": "lang_before", "score": "score_before"}), "text", nearest, lang_pred="string", score="double")
    better = F.col("score") > F.col("score_before")
    return both.select("row", "text", F.when(better, F.col("lang_pred")).otherwise(F.col("lang_before")).alias("lang_pred"), F.greatest("score", "score_before").alias("score"))


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
