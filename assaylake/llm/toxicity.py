"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, materialise, packed, small, unit_hash, with_columns

GRAMS = (4, 6, 8)
BITS = 20
#: Labelled rows that a model is fitted on at most: those of the smallest hashes of their ids.
MAX_TRAIN = 12_000
SCALE = 1000.0
#: N-grams added to the length of every text, so that single ones do not decide about very short texts.
PAD = 200
#: Rows that smoothing adds to each bucket, dealt to the classes by their shares; and the least ratio that counts.
SMOOTHING = 20.0
LEAST_RATIO = 1.2
#: Intercept of a model without weights at most: what tells no texts apart scores below one half, and so rejects none.
UNTRAINED = math.log(1 / 2)


@dataclass(frozen=True)
class ToxicityModel:
    """The weight of each hashed n-gram (ratio times coefficient) and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        grams = hashed_grams(text)
        z = self.intercept + float(self.weights[grams].sum(dtype=np.float64)) / (len(grams) + PAD)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def hashed_grams(text: str | None) -> np.ndarray:
    """The bucket of every run of 4, 6 or 8 lower-cased characters, repeats included."""
    chars = np.frombuffer((text or "").lower().encode("utf-32-le"), "<u4")
    h, out = chars, []
    for n in range(2, max(GRAMS) + 1):
        if len(chars) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + chars[n - 1 :]
        if n in GRAMS:
            out.append(((h ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def is_held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text is a multiple of five; so are null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of this partition's toxic and other rows hold each bucket: as many rows as buckets at most."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for b in small(batches):
        for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
            counts[label, np.unique(hashed_grams(text))] += 1
    used = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(used), 1 << 15):
        some = used[at : at + (1 << 15)]
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c.astype(np.int64)) for c in (counts[1, some], counts[0, some]))], names=["bucket", "toxic", "other"])


def log_count_ratios(counts: DataFrame, n_toxic: int, n_other: int) -> DataFrame:
    """(bucket, ratio): ln of a bucket's share of toxic rows over its share of other rows, without small ones.

    Both shares are smoothed towards the bucket's share of all rows.
    """
    share = n_toxic / (n_toxic + n_other)
    both = counts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    ratio = F.ln((F.col("toxic") + SMOOTHING * share) / n_toxic) - F.ln((F.col("other") + SMOOTHING * (1 - share)) / n_other)
    return both.select("bucket", ratio.alias("ratio")).where(F.abs("ratio") >= LEAST_RATIO)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_train: int = MAX_TRAIN) -> ToxicityModel:
    """Fit on the documents of at most ``max_train`` labelled ids that ``docs`` holds, none of them held out.

    Where nothing can be fitted, all texts get one score below one half, so none is rejected: the smoothed share of
    toxic rows for labels of class 0 only, and at most 1/3 for no labelled document, for labels of class 1 only and
A label above 0 is toxic, any other is not; several labels of an
    id count as toxic if one is; null ids and labels are passed over. Of rows that repeat an id one teaches, that of the
    smallest text.
    """
    known = labels.select(col(doc_id).alias("_id"), col(label).alias("label")).where("_id IS NOT NULL AND label IS NOT NULL").where(~is_held_out(F.col("_id")))
    present = known.join(docs.select(col(doc_id).alias("_id")), "_id", "left_semi")  # before the limit: labels of other documents take no place
    chosen = present.groupBy("_id").agg(F.max((F.col("label") > 0).cast("int")).alias("label")).orderBy(unit_hash("toxicity", F.col("_id")), "_id").limit(max_train)
    rows = docs.select(col(doc_id).alias("_id"), F.coalesce(col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")  # max_train ids at most
    data = materialise(rows.groupBy("_id").agg(F.max("label").alias("label"), F.min("text").alias("text")).select("label", "text"), "toxicity-sample")
    n = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = n.get(1, 0), n.get(0, 0)
    flat = ToxicityModel(np.zeros(1 << BITS, np.float32), min(math.log((n_toxic + 1) / (n_other + 1)), UNTRAINED))
    if not n_toxic or not n_other:
        return flat
    counts = data.mapInArrow(_bucket_counts, "bucket long, toxic long, other long")
    got = log_count_ratios(counts, n_toxic, n_other).orderBy("bucket").toPandas()  # a row for each bucket at most
    if got.empty:
        return flat
    used, ratio = got["bucket"].to_numpy(), np.zeros(1 << BITS)
    ratio[used] = got["ratio"].to_numpy()
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    held = docs.sparkSession.sparkContext.broadcast((ratio, place))  # as large as the buckets, whatever the input

    n_used = len(used)

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sparse vectors of the n-grams' shares times their ratios; n-grams are made anew, as they are larger than the texts."""
        ratio, place = held.value
        for b in small(batches):
            indices, values = [], []
            for text in b.column("text").to_pylist():
                index, times = np.unique(hashed_grams(text), return_counts=True)
                share, kept = (times / (times.sum() + PAD)).astype(np.float32), ratio[index] != 0
                indices.append(place[index[kept]])
                values.append(SCALE * share[kept] * ratio[index[kept]])
            columns = [pa.array([0] * b.num_rows, pa.int8()), pa.array([n_used] * b.num_rows, pa.int32()), pa.array(indices, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))]
            vectors = pa.StructArray.from_arrays(columns, names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([b.column("label"), vectors], names=["label", "features"])

    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("features", VectorUDT())])
    rows = materialise(data.mapInArrow(scale, schema), "toxicity-features")
    fit = LogisticRegression(labelCol="label", maxIter=30, regParam=1e-4, standardization=False).fit(rows)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = SCALE * ratio[used] * fit.coefficients.toArray()
    return ToxicityModel(weights, float(fit.intercept))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with toxicity_score (0 to 1) of each whole text; null counts as empty and gets the intercept's score.

    Repeated rows score alike; no rows give no rows; an input column of that name is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # as large as the buckets, whatever the input

    def score(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([held.value.score(t) for t in texts.to_pylist()], pa.float64())]

    return with_columns(docs, text, score, toxicity_score="double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that a model trained on ``labels`` scores below ``threshold``, with their columns; all if none can be trained.

    Null texts are scored as empty ones; null ids are scored and not learned from; repeated rows stay or go alike; no
    rows give no rows; columns of any name stay, also one named toxicity_score.
    """
    rows = packed(docs, text=col("text"))
    return score_toxicity(rows, train(docs, labels)).where(F.col("toxicity_score") < threshold).select("row.*")
