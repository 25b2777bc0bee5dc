"""Recall of result lists against true ones, ground truth, and summary statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import smoothed_recall
from .search import knn

RATIOS = (1, 2, 5, 10, 20, 30, 40, 50)
SUMMARY_K = (1, 10, 20, 50, 100, 200, 500, 1000)


def statistics(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """n, total, mean, low, high, deviation (sample; 0 for one row) of a column."""
    c = F.col(column)
    return rows.groupBy(*by).agg(
        F.count(c).alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high"),
        F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("deviation"),
    )


def recall_curve(truth: DataFrame, found: DataFrame, ratios: Sequence[int] = RATIOS, max_k: int = 1000, normalizer: int | None = None) -> DataFrame:
    """ratio, k, recall: of the first k true hits, the share among the first k * ratio found ones, averaged over queries.

    truth, found: query_id, target_id, rank. A common hit counts from k = max(true rank, ceil(found rank / ratio)) on;
    only k with k * ratio up to the length of the true list are given. The mean is over the queries there are, or
    ``normalizer`` of them.
    """
    lengths = truth.groupBy("query_id").agg(F.max("rank").alias("n"))
    n = F.lit(normalizer) if normalizer else F.lit(truth.select("query_id").distinct().count())
    t, f = truth.select("query_id", "target_id", F.col("rank").alias("rt")), found.select("query_id", "target_id", F.col("rank").alias("rf"))
    common = t.join(f, ["query_id", "target_id"]).join(lengths, "query_id").withColumn("ratio", F.explode(F.array(*[F.lit(r) for r in ratios])))
    first = F.greatest("rt", F.ceil(F.col("rf") / F.col("ratio"))).cast("int")
    hits = common.withColumn("k0", first).where((F.col("k0") <= max_k) & (F.col("k0") * F.col("ratio") <= F.col("n"))).groupBy("ratio", "k0").agg(F.count("*").alias("hits"))
    longest = truth.agg(F.max("rank")).first()[0] or 0
    grid = truth.sparkSession.range(1, min(max_k, longest) + 1).select(F.col("id").cast("int").alias("k"), F.explode(F.array(*[F.lit(r) for r in ratios])).alias("ratio"))
    grid = grid.where(F.col("k") * F.col("ratio") <= longest)
    joined = grid.join(hits.withColumnRenamed("k0", "k"), ["ratio", "k"], "left")
    total = F.sum(F.coalesce("hits", F.lit(0))).over(Window.partitionBy("ratio").orderBy("k"))
    return joined.select("ratio", "k", (total / (F.col("k") * n)).alias("recall"))


def recall_summary(curve: DataFrame, ks: Sequence[int] = SUMMARY_K, ratios: Sequence[int] = RATIOS) -> DataFrame:
    """ratio and a column k<k> for each k."""
    return curve.where(F.col("k").isin(*ks)).withColumn("name", F.concat(F.lit("k"), F.col("k"))).groupBy("ratio").pivot("name", [f"k{k}" for k in ks]).agg(F.max("recall"))


def compare_search(truth: DataFrame, found: DataFrame, p: int) -> DataFrame:
    """query_id, recall: the share of the first p true hits among the first p found ones."""
    t = truth.where(F.col("rank") <= p).select("query_id", "target_id")
    f = found.where(F.col("rank") <= p).select("query_id", "target_id", F.lit(1).alias("hit"))
    return t.join(f, ["query_id", "target_id"], "left").groupBy("query_id").agg((F.count("hit") / p).alias("recall"))


def recall_report(recalls: DataFrame) -> DataFrame:
    """mean, low, and how many queries are at 1, from 0.99 on and above 0.9."""
    r = F.col("recall")
    return recalls.agg(
        F.avg(r).alias("mean"), F.min(r).alias("low"), F.count_if(r == 1).alias("whole"), F.count_if(r >= 0.99).alias("from_99"), F.count_if(r > 0.9).alias("above_90")
    )


def list_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, precision, recall, f1 of neighbour lists (id, nbrs)."""
    both = truth.join(found.withColumnRenamed("nbrs", "got"), "id")
    hit = F.size(F.array_intersect("nbrs", "got"))
    p, r = hit / F.size("got"), hit / F.size("nbrs")
    f1: Column = F.when(hit > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return both.select(F.col("id").alias("query_id"), p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def smoothed(matched: DataFrame, size: int) -> DataFrame:
    """recall_smoothed = (matched + 1) / (size + 1)."""
    return matched.withColumn("recall_smoothed", smoothed_recall("matched", F.lit(size)))


def ground_truth(queries: DataFrame, items: DataFrame, k: int = 50_000, metric: str = "l2", exclude_self: bool = False, key: str = "id", vec: str = "vec") -> DataFrame:
    """query_id, target_id, dist, rank: exact, at most k for each query."""
    return knn(queries, items, k, metric, exclude_self=exclude_self, query_key=key, item_key=key, vec=vec)
