"""Models: grouped logistic fits by aggregates, and Spark's own learners for importances and components."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, Imputer, StandardScaler, StringIndexer, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assaylake.functions.expressions import hash_unit, safe_ratio

from . import forests
from .graph import materialise


def logistic_by_group(df: DataFrame, group: str, x: str, y: str, least: int = 10) -> DataFrame:
    """P(y) on x for every group at once: (group, n, intercept, slope, se_intercept, se_slope, midpoint -a/b, log_likelihood, steps, status).

    Newton's method on counts of (group, x, y). A step that lowers a group's likelihood is halved until it does not; a group
    is done when its step is below what its coefficients can tell, and then takes no more part. One pass serves all open
    groups, and the coefficients, a row for each group, are written and joined back. ``status`` is ``converged``, or why
    there are no coefficients: ``few rows`` (below ``least``), ``one class``, ``one value`` of x, or ``separated``, where a
    value of x parts the classes, so that no finite coefficients are best. Rows with a null x or y take no part.
    """
    number = lambda c, name: F.col(c).cast("double").alias(name)
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(group).alias("g"), number(x, "x"), number(y, "y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = materialise(cells, "logistic-cells")
    of = lambda f, c, v: f(F.when(F.col("y") == v, F.col(c)))
    known = cells.groupBy("g").agg(
        F.sum("n").alias("rows"), F.min("x").alias("low"), F.max("x").alias("high"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"),
        of(F.min, "x", 0).alias("low0"), of(F.max, "x", 0).alias("high0"), of(F.min, "x", 1).alias("low1"), of(F.max, "x", 1).alias("high1"),
    )
    status = (
        F.when(F.col("rows") < least, "few rows").when(F.col("low0").isNull() | F.col("low1").isNull(), "one class").when(F.col("low") == F.col("high"), "one value")
        .when((F.col("high0") <= F.col("low1")) | (F.col("high1") <= F.col("low0")), "separated").otherwise("open")
    )
    zero = {c: F.lit(0.0) for c in ("a", "b", "da", "db", "se_a", "se_b", "cov")}
    fit = known.select("g", "rows", "mean", (F.col("high") - F.col("low")).alias("width"), status.alias("status")).withColumns(zero | {"ll": F.lit(float("-inf")), "steps": F.lit(0)})
    fit = materialise(fit, "logistic-fit")
    # (a, b) is the last point that was taken, (da, db) the step that is tried from it.
    while not fit.where("status = 'open'").isEmpty():
        z = (F.col("x") - F.col("mean")) / F.col("width")
        eta = F.col("a") + F.col("da") + (F.col("b") + F.col("db")) * z
        p = 1 / (1 + F.exp(-eta))
        tried = cells.join(fit.where("status = 'open'").select(F.col("g").alias("_g"), "mean", "width", "a", "b", "da", "db"), F.col("g").eqNullSafe(F.col("_g")))
        w, r = F.col("n") * p * (1 - p), F.col("n") * (F.col("y") - p)
        likelihood = F.col("n") * (F.col("y") * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta))))
        sums = tried.groupBy(F.col("_g").alias("_of")).agg(F.sum(likelihood).alias("new"), F.sum(w).alias("w0"), F.sum(w * z).alias("w1"), F.sum(w * z * z).alias("w2"), F.sum(r).alias("r0"), F.sum(r * z).alias("r1"), F.lit(True).alias("seen"))
        got = fit.join(sums, F.col("g").eqNullSafe(F.col("_of")), "left")
        better = F.col("new") >= F.col("ll") - 1e-12 * F.abs(F.col("new"))
        det = F.col("w0") * F.col("w2") - F.col("w1") * F.col("w1")
        a, b = F.col("a") + F.col("da"), F.col("b") + F.col("db")
        da, db = (F.col("w2") * F.col("r0") - F.col("w1") * F.col("r1")) / det, (F.col("w0") * F.col("r1") - F.col("w1") * F.col("r0")) / det
        still = F.greatest(F.abs(da), F.abs(db)) <= 1e-10 * (1 + F.greatest(F.abs(a), F.abs(b)))
        stuck = F.greatest(F.abs(F.col("da")), F.abs(F.col("db"))) <= 1e-13 * (1 + F.greatest(F.abs(F.col("a")), F.abs(F.col("b"))))  # no step is better
        take = lambda yes, no, old: F.when(F.col("seen") & better, yes).when(F.col("seen"), no).otherwise(F.col(old)).alias(old)
        ended = F.when(F.col("seen") & better & still, "converged").when(F.col("seen") & ~better & stuck, "converged").otherwise(F.col("status")).alias("status")
        fit = materialise(
            got.select(
                "g", "rows", "mean", "width", ended, take(a, F.col("a"), "a"), take(b, F.col("b"), "b"), take(da, F.col("da") / 2, "da"), take(db, F.col("db") / 2, "db"),
                take(F.sqrt(F.col("w2") / det), F.col("se_a"), "se_a"), take(F.sqrt(F.col("w0") / det), F.col("se_b"), "se_b"), take(-F.col("w1") / det, F.col("cov"), "cov"), take(F.col("new"), F.col("ll"), "ll"),
                (F.col("steps") + F.when(F.col("seen"), 1).otherwise(0)).alias("steps"),
            ),
            "logistic-fit",
        )
    slope, shift = F.col("b") / F.col("width"), F.col("mean") / F.col("width")
    intercept = F.col("a") - F.col("b") * shift
    se = F.sqrt(F.col("se_a") * F.col("se_a") + shift * shift * F.col("se_b") * F.col("se_b") - 2 * shift * F.col("cov"))
    done = lambda c: F.when(F.col("status") == "converged", c)
    return fit.select(
        F.col("g").alias(group), F.col("rows").cast("long").alias("n"), done(intercept).alias("intercept"), done(slope).alias("slope"), done(se).alias("se_intercept"), done(F.col("se_b") / F.col("width")).alias("se_slope"),
        done(safe_ratio(-intercept, slope)).alias("midpoint"), done(F.col("ll")).alias("log_likelihood"), "steps", "status",
    )


def _features(df: DataFrame, variables: Sequence[str], cls: str | None = None) -> DataFrame:
    stages = [Imputer(strategy="median", inputCols=list(variables), outputCols=[f"_{v}" for v in variables]), VectorAssembler(inputCols=[f"_{v}" for v in variables], outputCol="features")]
    if cls:
        stages.append(StringIndexer(inputCol=cls, outputCol="label", stringOrderType="alphabetAsc"))
    df = df.withColumns({v: F.col(v).cast("double") for v in variables})
    return Pipeline(stages=stages).fit(df).transform(df)


def multinomial_model(df: DataFrame, variables: Sequence[str], cls: str) -> DataFrame:
    """(class index, variable, coefficient, odds ratio) of a multinomial regression."""
    m = LogisticRegression(family="multinomial", maxIter=20).fit(_features(df, variables, cls))
    rows = [(i, v, float(m.coefficientMatrix[i, j])) for i in range(m.numClasses) for j, v in enumerate(variables)]
    return df.sparkSession.createDataFrame(rows, "cls int, variable string, coefficient double").withColumn("odds_ratio", F.exp("coefficient"))


def class_weights(df: DataFrame, cls: str, out: str = "weight") -> DataFrame:
    """``df`` with each row's weight: one over how many rows its class has, over the sum of that of all classes. Rows of a null class have none."""
    counts = df.where(F.col(cls).isNotNull()).groupBy(F.col(cls).alias("_c")).agg((1 / F.count(F.lit(1))).alias("_w"))  # a row for each class
    whole = counts.agg(F.sum("_w").alias("_s"))
    shares = counts.crossJoin(F.broadcast(whole)).select("_c", (F.col("_w") / F.col("_s")).alias(out))
    return df.join(F.broadcast(shares), F.col(cls) == F.col("_c"), "left").drop("_c")


def _binned(data: DataFrame, variables: Sequence[str]) -> tuple[DataFrame, list[list[float]], int]:
    """Rows of ``_features`` with the bin of each variable, the cuts between bins and how many classes there are."""
    at = forests.cuts(data, [f"_{v}" for v in variables])
    return forests.binned(data, [f"_{v}" for v in variables], at), at, len(data.schema["label"].metadata["ml_attr"]["vals"])


def random_forest_importance(df: DataFrame, key: str, variables: Sequence[str], cls: str, trees: int = 1000, depth: int = 5, balanced: bool = True, seed: int = 1) -> DataFrame:
    """(variable, importance, loss, accuracy): impurity importance, and the accuracy lost on held-out rows when the variable is shuffled.

    ``balanced``: rows weigh by ``class_weights``, so that rare classes count as much as frequent ones. All variables are
    shuffled in one pass: each held-out row comes once as it is and once for each variable, with the value of another row.
    Trees grow on cells, and cells are scored: see ``forests``.
    """
    d, bins = len(variables), [f"_b{i}" for i in range(len(variables))]
    data = _features(class_weights(df, cls) if balanced else df.withColumn("weight", F.lit(1.0)), variables, cls)
    test = hash_unit(seed, F.col(key)) < 0.3
    data, _, classes = _binned(data, variables)
    cells = materialise(forests.cells(data.where(~test), d, F.max("weight").alias("weight")), "cells")
    weight = {r["label"]: r["w"] for r in cells.groupBy("label").agg(F.max("weight").alias("w")).collect()}  # a row for each class
    model = forests.forest(cells, d, [weight.get(c, 1.0) for c in range(classes)], trees, depth, seed)
    held = materialise(data.where(test).select(key, F.col("label").cast("int").alias("label"), *bins), "held-out")
    moved = held.withColumn("_of", F.lit(""))
    for v, b in zip(variables, bins, strict=True):
        # Every row takes the value of a row that is as good as random: the next one by hash.
        near = held.withColumn("_h", hash_unit(f"{seed}-{v}", F.col(key))).repartitionByRange("_h").sortWithinPartitions("_h")
        other = F.coalesce(F.lead(b).over(Window.partitionBy(F.spark_partition_id()).orderBy("_h")), F.col(b))
        moved = moved.unionByName(near.withColumn(b, other).drop("_h").withColumn("_of", F.lit(v)))
    scored = model.score(moved.groupBy("_of", *bins, "label").agg(F.count(F.lit(1)).alias("n")), d)
    met = F.array_position("p", F.array_max("p")) - 1 == F.col("label")
    right = {r["_of"]: r["a"] for r in scored.groupBy("_of").agg((F.sum(F.when(met, F.col("n")).otherwise(0)) / F.sum("n")).alias("a")).collect()}  # a row for each variable
    base, gain = right.get(""), model.importances(d)
    rows = [(v, float(gain[j]), base - right[v] if base is not None else None, base) for j, v in enumerate(variables)]
    return df.sparkSession.createDataFrame(rows, "variable string, importance double, loss double, accuracy double")


def boosted_importance(df: DataFrame, variables: Sequence[str], cls: str, rounds: int = 300, depth: int = 6, step: float = 0.1, share: float = 0.8, seed: int = 1) -> DataFrame:
    """(class index, variable, gain) of boosted trees, one class against the rest; each tree sees a ``share`` of the rows. Trees grow on cells: see ``forests``."""
    d = len(variables)
    data, _, classes = _binned(_features(df, variables, cls), variables)
    gains = forests.boost(forests.cells(data, d), d, classes, rounds, depth, step, share, seed)
    rows = [(i, v, float(g[j])) for i, g in enumerate(gains) for j, v in enumerate(variables)]
    return df.sparkSession.createDataFrame(rows, "cls int, variable string, gain double")


def partial_dependence(df: DataFrame, variables: Sequence[str], cls: str, of: str, grid: Sequence[float], trees: int = 1000, seed: int = 1) -> DataFrame:
    """(value, cls, mean probability) of a forest when ``of`` is set to each grid value for all rows. Trees grow on cells, and cells are scored: see ``forests``."""
    d, i = len(variables), list(variables).index(of)
    data, at, classes = _binned(_features(df, variables, cls), variables)
    cells = materialise(forests.cells(data, d), "cells")
    model = forests.forest(cells, d, [1.0] * classes, trees, 5, seed)
    places = F.array(*[F.struct(F.lit(float(g)).alias("value"), F.lit(bisect_left(at[i], g)).alias("b")) for g in dict.fromkeys(map(float, grid))])
    rest = [f"_b{j}" for j in range(d) if j != i]
    moved = cells.groupBy(*rest).agg(F.sum("n").alias("n")).select(*rest, "n", F.explode(places).alias("_at")).select(*rest, "n", F.col("_at.value").alias("value"), F.col("_at.b").alias(f"_b{i}"))
    each = model.score(moved, d).select("value", "n", F.posexplode("p").alias("cls", "p"))
    return each.groupBy("value", "cls").agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_probability"))


def _components(df: DataFrame, variables: Sequence[str], k: int):
    """The fitted steps: median imputation, dropping constants, scaling, components."""
    data = _features(df, variables)
    steps = [VarianceThresholdSelector(featuresCol="features", outputCol="kept"), StandardScaler(inputCol="kept", outputCol="scaled", withMean=True), PCA(k=k, inputCol="scaled", outputCol="pc")]
    return data, Pipeline(stages=steps).fit(data)


def pca_features(df: DataFrame, variables: Sequence[str], k: int = 3) -> DataFrame:
    """(component, variance, variable, loading) after median imputation, dropping constants and scaling."""
    model = _components(df, variables, k)[1]
    kept, pca = [variables[i] for i in model.stages[0].selectedFeatures], model.stages[-1]
    rows = [(c + 1, float(pca.explainedVariance[c]), v, float(pca.pc[i, c])) for c in range(k) for i, v in enumerate(kept)]
    return df.sparkSession.createDataFrame(rows, "component int, variance double, variable string, loading double")


def pca_scores(df: DataFrame, keys: Sequence[str], variables: Sequence[str], k: int = 3) -> DataFrame:
    """(keys, pc1, pc2, ...): the scores of every row on the components of ``pca_features``."""
    data, model = _components(df, variables, k)
    at = model.transform(data).select(*keys, vector_to_array("pc").alias("_pc"))
    return at.select(*keys, *[F.col("_pc")[i].alias(f"pc{i + 1}") for i in range(k)])


def binomial_glm_effects(df: DataFrame, factors: Sequence[str], successes: str, trials: str) -> DataFrame:
    """(factor, deviance share): how much the deviance rises when a factor leaves a binomial model of successes among trials."""
    data = df.withColumns({"_y": F.col(successes) / F.col(trials), "_w": F.col(trials).cast("double")} | {f"_{f}": F.col(f).cast("double") for f in factors})

    def deviance(keep: Sequence[str]) -> float:
        if not keep:
            m = data.agg(F.sum(F.col("_y") * F.col("_w")) / F.sum("_w")).first()[0]
            ll = lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(0.0)
            return data.agg(2 * F.sum(F.col("_w") * (ll(F.col("_y"), F.lit(m)) + ll(1 - F.col("_y"), F.lit(1 - m))))).first()[0]
        rows = VectorAssembler(inputCols=[f"_{f}" for f in keep], outputCol="features").transform(data)
        return GeneralizedLinearRegression(family="binomial", labelCol="_y", weightCol="_w").fit(rows).summary.deviance

    full, null = deviance(factors), deviance([])
    rows = [(f, float((deviance([x for x in factors if x != f]) - full) / null) if null else None) for f in factors]
    return df.sparkSession.createDataFrame(rows, "factor string, share double")
