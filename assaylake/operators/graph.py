"""Links between rows: lineage cuts, connected components and greedy star clusters, as joins and grouped minima."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files go with the query that wrote them.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` names, else one in the warehouse, if that is not on one machine's disk of several."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share; the warehouse {warehouse} is local")
    return warehouse.rstrip("/") + "/lineage-cuts"


_writes: dict[str, object] = {"at once": 0, "was": None}
_lock = threading.Lock()


@contextmanager
def _shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """The setting by which shuffle files go with their query, while tables are written, by one thread or several; then what it was before."""
    with _lock:
        if not _writes["at once"]:
            _writes["was"] = spark.conf.get(CLEANED, None)
            spark.conf.set(CLEANED, "true")
        _writes["at once"] += 1
    try:
        yield
    finally:
        with _lock:
            _writes["at once"] -= 1
            if not _writes["at once"]:
                spark.conf.unset(CLEANED) if _writes["was"] is None else spark.conf.set(CLEANED, _writes["was"])


def materialise(df: DataFrame, name: str, by: str | None = None, onto: DataFrame | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder, in a folder for each value of ``by`` if given, and read it again.

    With ``onto``, the rows are added to those of a table made here. The files survive lost executors and go when the
    driver's file system closes. What was shuffled for them is of no more use and goes as soon as they are written.
    """
    spark = df.sparkSession
    path = onto.stored_at if onto is not None else f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_cleaned(spark):
        (df.write.partitionBy(by) if by else df.write).mode("errorifexists" if onto is None else "append").option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components of undirected ``edges`` as (node, root), root being the smallest node.

    Alternates large-star and small-star steps (Kiveris et al. 2014) as joins against grouped
    minima, so no task holds a node's neighbourhood; each round is written to the shared folder.
    Nulls and loops take no part; no edges give no rows.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct()
    e = materialise(e, "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lows")  # written, so that Spark can split a hot node
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "edges")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "lows")
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))
        small = materialise(large.join(low, "u").select(F.explode(ends).alias("e")).select("e.*").where("u <> v").distinct(), "edges")
        if small.join(e, ["u", "v"], "left_anti").isEmpty() and e.join(small, ["u", "v"], "left_anti").isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e = small


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, rep): the clusters of a greedy pass in order of ``rank`` (small first), found in rounds.

    ``nodes``: (node, rank), ranks distinct. In each round those nodes found clusters that no open neighbour comes
    before, and they and their neighbours are open no more. In the end a node that founds none belongs to the first of
    the founders that it neighbours, as in the sequential pass.
    """
    both = edges.select("u", "v").where("u <> v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    r = nodes.select(F.col("node").alias("v"), F.col("rank").alias("rv"))
    both = materialise(both.join(r, "v").join(nodes.select(F.col("node").alias("u"), F.col("rank").alias("ru")), "u"), "star-edges")
    left = materialise(nodes.select("node"), "star-open")
    founders = materialise(left.limit(0), "star-founders")
    while not left.isEmpty():
        live = both.join(left.select(F.col("node").alias("u")), "u").join(left.select(F.col("node").alias("v")), "v")
        before = live.where("rv < ru").select(F.col("u").alias("node")).distinct()
        found = materialise(left.join(before, "node", "left_anti"), "star-found")
        materialise(found, "star-founders", onto=founders)
        taken = live.join(found.select(F.col("node").alias("u")), "u").select(F.col("v").alias("node"))
        left = materialise(left.join(found.unionByName(taken).distinct(), "node", "left_anti"), "star-open")
    founders = nodes.sparkSession.read.schema(founders.schema).parquet(founders.stored_at)
    first = both.join(founders.select(F.col("node").alias("u")), "u").groupBy(F.col("v").alias("node")).agg(F.min(F.struct("ru", "u")).alias("m"))
    members = first.join(founders, "node", "left_anti").select("node", F.col("m.u").alias("rep"))
    return founders.select("node", F.col("node").alias("rep")).unionByName(members)
