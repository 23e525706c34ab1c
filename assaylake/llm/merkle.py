"""Merkle manifest of a table: hash trees of bounded fanout over its rows by group, and over the groups' roots.

Rows of a group are numbered in order and cut into aligned blocks, which are the partitions of the method: a block hashes
its own subtree and keeps its root. Then blocks swap roots in a butterfly: in round r those meet that stand at the same
place in neighbouring runs of fanout^r blocks, so each hears the roots of the other runs of its group of runs, and each
hashes the parent by itself. After the last round every block knows its whole upper proof; nothing is sent down again.
All of it is DataFrame operations on tables of blocks; a task sees a block's rows at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.operators.stats import cumulative

from .common import col, materialise

FANOUT = 3
#: Levels of a block: it holds fanout^levels rows, 729.
LEVELS = 6
#: What a step of a proof holds: the siblings before and after, as one text each.
STEP = "struct<before:string,after:string>"


def digest_of(*nodes: Column) -> Column:
    """Lower-case hex SHA-256 of the nodes' hex texts, put together."""
    return F.sha2(F.concat(*nodes).cast("binary"), 256)


def leaf_hash(*values: Column) -> Column:
    """Of every value its UTF-8 length, a colon and itself, ``-`` for null."""
    each = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in (v.cast("string") for v in values)]
    return digest_of(*each)


def _levels(n: Column, fanout: int) -> Column:
    """How often n nodes are put together by ``fanout`` until one is left."""
    powers = [fanout**i for i in range(64) if fanout**i < 1 << 63]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < n))


def _raised(nodes: Column, fanout: int) -> Column:
    """The next level of an array of nodes."""
    starts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(starts, lambda i: digest_of(F.array_join(F.slice(nodes, i * fanout + 1, F.lit(fanout)), "")))


def _tower(nodes: Column, levels: Column, fanout: int) -> Column:
    """The array of all levels of a block, itself first."""
    rounds = F.slice(F.sequence(F.lit(0), levels), 2, 64)  # empty for a lone leaf
    return F.aggregate(rounds, F.array(nodes), lambda made, _: F.concat(made, F.array(_raised(F.element_at(made, -1), fanout))))


def _steps(tower: Column, place: Column, levels: Column, fanout: int) -> Column:
    """The proof of the leaf at ``place`` (from 0) of a block, up to the block's root."""

    def step(r: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(float(fanout)), r)).cast("int")
        own, run = at % fanout, at - at % fanout
        level = F.element_at(tower, (r + 1).cast("int"))
        return F.struct(F.array_join(F.slice(level, run + 1, own), "").alias("before"), F.array_join(F.slice(level, at + 2, F.lit(fanout - 1) - own), "").alias("after"))

    return F.transform(F.slice(F.sequence(F.lit(0), levels), 1, levels), step)


def _butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """(g, b, root, up): the group's root and the upper proof of every block of (g, b, of, node), ``of`` being the group's number of blocks.

    A last run may lack places; its members send for those too, in turn, so every block hears of every run. Each meeting
    is a row for each of ``fanout`` runs at most.
    """
    most = blocks.agg(F.max("of")).first()[0] or 1  # one number
    state = blocks.select("g", "b", "of", "node", F.array().cast(f"array<{STEP}>").alias("up"))
    width = 1
    while width < most:
        low, run = F.col("b") % width, F.floor(F.col("b") / width).cast("long")
        done = F.lit(width) >= F.col("of")  # the group had its root before this round
        held = F.least(F.lit(width).cast("long"), F.col("of") - run * width)  # places of this run that have a block
        places = F.when(done, F.array(low)).otherwise(F.sequence(low, F.lit(width - 1).cast("long"), held))
        sends = state.select("*", run.alias("run"), low.alias("low"), F.explode(places).alias("place"))
        mine = F.when(F.col("place") == F.col("low"), F.struct("b", "of", "up"))
        met = sends.groupBy("g", F.floor(F.col("run") / fanout).alias("over"), "place").agg(F.array_sort(F.collect_list(F.struct("run", "node", mine.alias("mine")))).alias("m"))
        nodes = F.transform("m", lambda x: x["node"])
        before = lambda x: F.array_join(F.transform(F.filter("m", lambda y: y["run"] < x["run"]), lambda y: y["node"]), "")
        after = lambda x: F.array_join(F.transform(F.filter("m", lambda y: y["run"] > x["run"]), lambda y: y["node"]), "")
        here = F.filter("m", lambda x: x["mine"].isNotNull())
        moved = lambda x: F.struct(x["mine"]["b"].alias("b"), x["mine"]["of"].alias("of"), x["node"].alias("old"), x["mine"]["up"].alias("up"), before(x).alias("before"), after(x).alias("after"))
        heard = met.select("g", digest_of(F.array_join(nodes, "")).alias("parent"), F.inline(F.transform(here, moved)))
        state = heard.select(
            "g", "b", "of", F.when(done, F.col("old")).otherwise(F.col("parent")).alias("node"),
            F.when(done, F.col("up")).otherwise(F.concat("up", F.array(F.struct("before", "after")))).alias("up"),
        )
        width *= fanout
    return state.select("g", "b", F.col("node").alias("root"), "up")


def _blocks(leaves: DataFrame, order: Sequence[str], fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """(g, rows, tower, local, root, up) for each block, and (g, root) for each group, of leaves (g, node, row and what ``order`` names)."""
    numbered = cumulative(leaves.withColumn("one", F.lit(1)), ["g"], list(order), "one", "rank")
    place = F.col("rank") - 1
    held = F.array_sort(F.collect_list(F.struct(place.alias("place"), "node", "row")))
    blocks = materialise(numbered.groupBy("g", F.floor(place / fanout**levels).cast("long").alias("b")).agg(held.alias("rows")), "merkle-blocks")
    groups = materialise(blocks.groupBy(F.col("g").alias("_g")).agg(F.sum(F.size("rows")).alias("n"), F.count(F.lit(1)).alias("of")), "merkle-groups")
    tall = blocks.join(groups, F.col("g") == F.col("_g")).withColumn("local", F.least(F.lit(levels), _levels(F.col("n"), fanout)))
    tall = tall.withColumn("tower", _tower(F.transform("rows", lambda x: x["node"]), F.col("local"), fanout))
    roots = materialise(tall.select("g", "b", "of", F.element_at(F.element_at("tower", -1), 1).alias("node")), "merkle-roots")
    upper = materialise(_butterfly(roots, fanout), "merkle-upper")
    known = tall.join(upper.select(F.col("g").alias("_g2"), F.col("b").alias("_b2"), "root", "up"), (F.col("g") == F.col("_g2")) & (F.col("b") == F.col("_b2")))
    return known.select("g", "rows", "tower", "local", "root", "up"), upper.where("b = 0").select("g", "root")


def _proved(over: Column, fanout: int) -> Column:
    """The rows of a block with their whole proofs: within the block, from block to group, and what is over the group."""
    path = lambda i: F.concat(_steps(F.col("tower"), i, F.col("local"), fanout), F.col("up"), over)
    return F.inline(F.transform("rows", lambda x, i: F.struct(x["node"].alias("node"), x["row"].alias("row"), path(i).alias("path"))))


def manifest(docs: DataFrame, key: str, group: str, fields: Sequence[str], payload: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(key, leaf, subroot, root, proof, payload) of every row: its leaf hash, its group's root, the manifest's root and its proof up to that.

    A leaf is the hash of ``fields``. Leaves of a group ascend by ``key`` (null first), rows of one key by their hash, so
    repeated rows have equal leaves side by side and a proof each. Groups ascend by name in byte order, null first. An
    empty table gives no rows. Only the named columns are read, so no other can clash; of texts, however long, only the
    hashes go on. ``payload`` is any column computed from the row that is to stay with it.
    """
    g = F.coalesce(F.concat(F.lit("="), col(group).cast("string")), F.lit(""))  # null sorts first, apart from the empty text
    kept = F.struct(col(key).alias("key"), (F.lit(None).cast("string") if payload is None else payload).alias("payload"))
    rows = docs.select(g.alias("g"), col(key).alias("k"), leaf_hash(*[col(f) for f in fields]).alias("node"), kept.alias("row"))
    blocks, roots = _blocks(rows, ["k", "node"], fanout, levels)
    subroots = roots.select(F.lit("").alias("g"), F.col("g").alias("k"), F.col("root").alias("node"), F.struct(F.col("g").alias("of")).alias("row"))
    tops = _blocks(subroots, ["k"], fanout, levels)[0].select(F.col("root").alias("top"), _proved(F.array().cast(f"array<{STEP}>"), fanout))
    tops = materialise(tops.select(F.col("row.of").alias("_of"), "top", F.col("path").alias("over")), "merkle-top")
    got = blocks.join(tops, F.col("g") == F.col("_of")).select(F.col("root").alias("subroot"), "top", _proved(F.col("over"), fanout))
    return got.select(F.col("row.key").alias(key), F.col("node").alias("leaf"), "subroot", F.col("top").alias("root"), F.col("path").alias("proof"), F.col("row.payload").alias("payload"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: digest_of(step["before"], node, step["after"]))


def proof_digest(proof: Column) -> Column:
    """Hash of all siblings of a proof, level by level, left to right."""
    return digest_of(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))
