"""Hits with mismatches and gaps: exact anchors of a query and a subject put together in collinear chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
ANCHOR = ["qstart", "qend", "sstart", "send"]


class PrefixMaximum:
    """Largest (value, -number) over the first places of an array, as values come in."""

    def __init__(self, size: int) -> None:
        self.best: list[tuple[int, int] | None] = [None] * (size + 1)

    def put(self, place: int, value: tuple[int, int]) -> None:
        while place < len(self.best):
            if self.best[place] is None or self.best[place] < value:
                self.best[place] = value
            place += place & -place

    def upto(self, place: int) -> tuple[int, int] | None:
        found = None
        while place:
            if self.best[place] is not None and (found is None or found < self.best[place]):
                found = self.best[place]
            place -= place & -place
        return found


def chain_scores(a: np.ndarray, match: int, gap: int) -> tuple[list[int], list[int]]:
    """Of anchors (qstart, qend, sstart, send) the score of the best chain that ends with each, and who comes before it there, or -1.

    A chain scores ``match`` for each word of its anchors less ``gap`` for each word left out between them, in the query
    and in the subject; anchors follow each other without overlap in both. Anchors are taken in order of where they start
    in the query; those that have ended are in a tree by where they end in the subject, so the best one before is a prefix
    maximum: m log m steps for m anchors. Of equal ones the first is taken.
    """
    places = np.unique(a[:, 3])
    place = (np.searchsorted(places, a[:, 3]) + 1).tolist()
    before = np.searchsorted(places, a[:, 2], side="left").tolist()  # ends below this start
    rows = a.tolist()
    tree, ended, waits = PrefixMaximum(len(places)), 0, np.argsort(a[:, 1], kind="stable").tolist()
    score, prior = [0] * len(rows), [-1] * len(rows)
    for j in np.argsort(a[:, 0], kind="stable").tolist():
        qs, qe, ss, se = rows[j]
        while ended < len(rows) and rows[waits[ended]][1] < qs:
            i = waits[ended]
            tree.put(place[i], (score[i] + gap * (rows[i][1] + rows[i][3]), -i))
            ended += 1
        score[j] = match * (qe - qs + 1)
        found = tree.upto(before[j])
        if found is not None and (gain := found[0] - gap * (qs + ss - 2)) > 0:
            score[j], prior[j] = score[j] + gain, -found[1]
    return score, prior


def best_chains(a: np.ndarray, match: int, gap: int, least: int) -> list[tuple[list[int], int]]:
    """(anchors from first to last, score) of chains that share no anchor, best first; a chain that runs into a better one keeps what it has of its own."""
    score, prior = chain_scores(a, match, gap)
    used, made = [False] * len(score), []
    for j in sorted(range(len(score)), key=lambda j: (-score[j], j)):
        if used[j]:
            continue
        chain, i = [], j
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = prior[i]
        own = score[j] - (score[i] + _step(a[i], a[chain[-1]], gap) if i >= 0 else 0)
        if own >= least:
            made.append((chain[::-1], own))
    return made


def _step(i: np.ndarray, j: np.ndarray, gap: int) -> int:
    """What it costs to go on from anchor i to anchor j, below zero."""
    return -gap * int(j[0] - i[1] - 1 + j[2] - i[3] - 1)


def chained_hits(anchors: DataFrame, match: int = 2, gap: int = 1, least: int = 8) -> DataFrame:
    """Hits of ``anchors`` as of ``maximal_matches``: (qseqid, sseqid, qstart, qend, sstart, send, qlen, slen, length, matched, pident, n_anchors, bitscore).

    ``length`` is the longer span, ``pident`` 100 matched / length. Where the subject is read from its end, sstart is above
    send. Anchors of one query, subject and direction are one task's work; others stream by in order. No anchors, no hits.
    """
    keys = ["qseqid", "sseqid", "back"]
    types = {f.name: f.dataType.simpleString() for f in anchors.schema}
    parts = max(2, int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = anchors.select(*keys, *[F.col(c).cast("long").alias(c) for c in [*ANCHOR, "qlen", "slen"]]).repartition(parts, *keys).sortWithinPartitions(*keys, *ANCHOR)
    made = ["qstart", "qend", "sstart", "send", "qlen", "slen", "matched", "n_anchors", "bitscore"]

    def chains(group: pa.Table) -> Iterator[tuple[int, ...]]:
        a = np.stack([group.column(c).to_numpy() for c in ANCHOR], axis=1)
        qlen, slen, back = group.column("qlen")[0].as_py(), group.column("slen")[0].as_py(), group.column("back")[0].as_py()
        for chain, score in best_chains(a, match, gap, least):
            at = a[chain]
            start, end = int(at[0, 2]), int(at[-1, 3])
            if back:
                start, end = slen + 1 - start, slen + 1 - end
            yield int(at[0, 0]), int(at[-1, 1]), start, end, qlen, slen, int((at[:, 1] - at[:, 0] + 1).sum()), len(chain), score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            table = pa.Table.from_batches([b])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            names = list(zip(*[held.column(k).to_pylist() for k in keys], strict=True))
            edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]]]
            yield from out(held, edges)  # the last group may go on
            held = held.slice(edges[-1])
        if held is not None and held.num_rows:
            yield from out(held, [0, held.num_rows])

    def out(held: pa.Table, edges: list[int]) -> Iterator[pa.RecordBatch]:
        found, starts = [], []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            for hit in chains(held.slice(lo, hi - lo)):
                found.append(hit)
                starts.append(lo)
        if found:
            at = pa.array(starts)
            cols = [held.column(k).take(at).combine_chunks() for k in keys[:2]]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(c, pa.int64()) for c in zip(*found, strict=True)]], names=[*keys[:2], *made])

    hits = rows.mapInArrow(run, ", ".join([f"{k} {types[k]}" for k in keys[:2]] + [f"{c} long" for c in made]))
    length = F.greatest(F.col("qend") - F.col("qstart"), F.abs(F.col("send") - F.col("sstart"))) + 1
    got = hits.withColumn("length", length).withColumn("pident", 100.0 * F.col("matched") / F.col("length"))
    return got.select("qseqid", "sseqid", *ANCHOR, "qlen", "slen", "length", "matched", "pident", "n_anchors", F.col("bitscore").cast("double").alias("bitscore"))
