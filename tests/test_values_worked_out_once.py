"""Joins on a value that is not the same each time it is worked out, as sums of doubles in another order are not."""

import random

from pyspark.sql import functions as F

from assaylake.operators import stats as S


def unsteady(base):
    return F.udf(lambda x: x * (1 + random.SystemRandom().random() * 1e-12), "double").asNondeterministic()(base)


def test_each_test_meets_its_adjusted_p(spark):
    rows = spark.range(40).select((F.col("id") % 4).alias("g"), unsteady((F.col("id") + 1) / 50).alias("p"))
    got = S.p_adjust(rows, "p", ["g"]).collect()
    assert len(got) == 40 and all(r.p_adj is not None and r.p_adj >= r.p * (1 - 1e-9) and r.stars for r in got)


def test_each_block_meets_its_rank(spark):
    rows = spark.range(12).select((F.col("id") % 4).alias("b"), F.floor(F.col("id") / 4).alias("t"), unsteady(F.col("id") + 1.0).alias("v"))
    got = S.friedman(rows, "b", "t", "v").first()
    assert (got.k, got.b) == (3, 4) and abs(got.chi2 - 8) < 1e-9
