"""Connected components of a table of edges, by contraction in a random order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import discard, materialise

SEED = 29
#: So many edges are contracted by one task (4 MB of ids); what is more by tables.
FEW_EDGES = 1 << 18


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in edges from a to b, and the smallest that each can reach."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    n, x, y = len(ids), at[: len(a)], at[len(a) :]
    root, rng = np.arange(n), np.random.default_rng(SEED)
    while len(x):
        order = rng.permutation(n)
        rank = np.argsort(order)
        first = rank.copy()
        np.minimum.at(first, x, rank[y])
        np.minimum.at(first, y, rank[x])
        to = order[first]
        while (to[to] != to).any():
            to = to[to]
        root, x, y = to[root], to[x], to[y]
        x, y = x[x != y], y[x != y]
    low = np.full(n, n)
    np.minimum.at(low, root, np.arange(n))
    return ids, ids[low[root]]


def _by_one_task(edges: DataFrame) -> DataFrame:
    """(id, to) of a table of a few edges, which one task scans."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i).to_numpy() for i in (0, 1)] for b in it]
        if got:
            found = smallest(*(np.concatenate([x[i] for x in got]) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["id", "to"])

    return edges.select("a", "b").coalesce(1).mapInArrow(batches, "id long, to long")


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (id, component): the smallest id that can be reached, for every id in an edge to another.

    Each round, every node goes to the first of itself and its neighbours in the order of a hash; edges within a node
    and repeated ones vanish, so the table shrinks by a constant factor in expectation, and a star is done in two
    rounds whatever its size. Neighbourhoods are only aggregated, never gathered. Once a bounded number of edges is left,
    one task does the rest. Each round's tables are written, and nothing but the number of edges left comes to the
    driver. Null ids are left out. No edges: no rows.
    """
    left = materialise(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), "edges")
    if left.count() > FEW_EDGES:
        old, left = left, materialise(_pairs(left), "edges")
        discard(old)
    maps: list[DataFrame] = []
    while left.count() > FEW_EDGES:
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(SEED)).alias("h"), "b")).alias("n"))
        mine = F.struct(F.xxhash64("a", F.lit(SEED)).alias("h"), F.col("a").alias("b"))
        step = materialise(first.select(F.col("a").alias("id"), F.least(mine, F.col("n")).getField("b").alias("to")), "contraction")
        maps.append(step)
        moved = left.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a")
        moved = moved.join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        old, left = left, materialise(_pairs(moved.select(F.col("x").alias("a"), F.col("y").alias("b"))), "edges")
        discard(old)
    rest = materialise(_by_one_task(left), "contraction")
    discard(left)
    if not maps:
        return rest.withColumnRenamed("to", "component")
    steps, roots = maps, rest
    for step in reversed(steps):
        later = roots.select(F.col("id").alias("to"), F.col("to").alias("root"))
        roots = step.join(later, "to", "left").select("id", F.coalesce("root", "to").alias("to"))
    roots = materialise(roots, "roots")
    discard(*maps, rest)
    return roots.join(roots.groupBy("to").agg(F.min("id").alias("component")), "to").select("id", "component")
