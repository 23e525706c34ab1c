"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.operators.graph import components, materialise

__all__ = ["ascii_lower", "col", "components", "materialise", "packed", "parts_of", "small", "table", "unit_hash", "with_columns"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col(f"`{name}`")


def packed(docs: DataFrame, without: Iterable[str] = (), **columns: Column) -> DataFrame:
    """The rows as one struct ``row``, without the columns named, beside what is computed from them: no name can clash."""
    kept = [c for c in docs.columns if c not in set(without)]
    whole = F.struct(*[col(c) for c in kept]) if kept else F.struct()
    return docs.select(whole.alias("row"), *[c.alias(n) for n, c in columns.items()])


def with_columns(docs: DataFrame, source: str, make: Callable[[pa.Array], list[pa.Array]], **fields: str) -> DataFrame:
    """``docs`` with columns of these names and types, made of slices of column ``source`` in Python workers; they replace input columns of these names.

    Inside, columns go by number, so no name can clash.
    """
    column = docs.select(col(source).alias("source"), "*")
    kept = [c for c in docs.columns if c not in fields]
    plain = column.toDF("source", *[f"c{i}" for i in range(len(docs.columns))]).select("source", *[f"c{i}" for i, c in enumerate(docs.columns) if c not in fields])
    schema = T.StructType([*plain.schema.fields[1:], *[T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *make(b.column(0))], names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*kept, *fields)


def parts_of(df: DataFrame) -> int:
    """The session's number of shuffle partitions, two at least."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def small(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows: texts can be long, and what is made of them is held a slice at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does just that for pure ASCII, much faster than ``translate``."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5, alike in every SQL engine."""
    joined = F.concat_ws("-", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
