"""Shared-neighbour clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components


def neighbour_lists(hits: DataFrame, cutoff: float | None = None) -> DataFrame:
    """id, nbrs: targets in order of rank; cutoff keeps distances up to it."""
    rows = hits if cutoff is None else hits.where(F.col("dist") <= cutoff)
    return rows.groupBy(F.col("query_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "target_id"))), lambda x: x.target_id).alias("nbrs"))


def shared_neighbours(lists: DataFrame, mutual: bool = True) -> DataFrame:
    """a < b, shared: pairs of which each is in the other's list (one in the other's, if not mutual), and how many neighbours they share."""
    arcs = lists.select(F.col("id").alias("x"), F.explode("nbrs").alias("y")).where("x <> y")
    pairs = arcs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = pairs.where("n = 2") if mutual else pairs
    left, right = lists.select(F.col("id").alias("a"), F.col("nbrs").alias("na")), lists.select(F.col("id").alias("b"), F.col("nbrs").alias("nb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("na", "nb")).alias("shared"))


def connected(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """id, cluster_id: the smallest id of the component; ids without an edge are their own. edges: a, b."""
    found = components(edges.select("a", "b")).withColumnRenamed("component", "cluster_id")
    return ids.select("id").join(found, "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id"))


def jarvis_patrick(lists: DataFrame, min_shared: int, mutual: bool = True, linkage: str = "single") -> DataFrame:
    """id, cluster_id: clusters of pairs that share min_shared neighbours at least."""
    if linkage != "single":
        raise NotImplementedError(f"linkage {linkage!r}; only single")
    return connected(lists.select("id"), shared_neighbours(lists, mutual).where(F.col("shared") >= min_shared))


def cluster_sizes(clusters: DataFrame, least: int = 2) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def agreement(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: jaccard, rand, adjusted_rand of two clusterings (id, cluster_id) of the same ids, by counts of pairs."""
    pairs = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    cells = x.join(y.withColumnRenamed("cluster_id", "other"), "id").groupBy("cluster_id", "other").agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(pairs("n")).alias("both"), F.sum("n").alias("total"))
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias(name))
    r = both.first() + side("cluster_id", "x").first() + side("other", "y").first()
    a, total, sx, sy = (float(v or 0) for v in r)
    every = total * (total - 1) / 2
    expected = sx * sy / every if every else 0.0
    top = (sx + sy) / 2
    row = (a / (sx + sy - a) if sx + sy > a else 1.0, (every + 2 * a - sx - sy) / every if every else 1.0, (a - expected) / (top - expected) if top != expected else 1.0)
    return x.sparkSession.createDataFrame([row], "jaccard double, rand double, adjusted_rand double")
