"""A book of queries: each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places: sums come in any order."""
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def query(sql: str | None = None, doubles: str = ""):
    """Register a query under its function's name; ``doubles`` are the columns that the SQL rounds."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            cols = doubles.split()
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in cols)}) FROM ({sql})" if cols else sql
        return f

    return add
