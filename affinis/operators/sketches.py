"""Bit sketches with a Hamming filter, and histograms that embed sets of weighted vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lsh import HashFamily
from ..functions.measures import l2
from .lsh_index import LshParams
from .search import knn, matrix, refine


def sketch(items: DataFrame, params: LshParams, key: str = "id", vec: str = "vec") -> DataFrame:
    """id, words array<long> (32 bits each), bits array<int>, deltas array<double>: low bits of all projections, and how far each is from flipping."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = matrix(b.column(1))
            v = params.values(x).reshape(len(x), -1) if len(x) else np.zeros((0, params.b.size))
            bits, frac = np.floor(v).astype(np.int64) & 1, v - np.floor(v)
            pad = np.zeros((len(v), -v.shape[1] % 32), np.int64)
            words = (np.concatenate([bits, pad], 1).reshape(len(v), -1, 32) << np.arange(32)).sum(2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(words), pa.list_(pa.int64())), pa.array(list(bits.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(np.minimum(frac, 1 - frac)), pa.list_(pa.float64()))],
                names=["id", "words", "bits", "deltas"],
            )

    rows = items.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return rows.mapInArrow(batches, "id long, words array<long>, bits array<int>, deltas array<double>")


def sketch_search(
    queries: DataFrame, items: DataFrame, query_sketches: DataFrame, sketches: DataFrame, k: int, ratio: int, weighted: bool = False, exclude_self: bool = True, key: str = "id", vec: str = "vec"
) -> DataFrame:
    """query_id, target_id, dist, rank: the k nearest by exact distance of ratio * k candidates by Hamming distance.

    weighted: a differing bit counts by how far the query is from flipping it. Of bits q and x with weights d the
    distance is a constant of the query plus the product of x with d * (1 - 2q), so candidates come from the blockwise
    scan, which sends on ratio * k rows per query and task.
    """
    weights = F.col("deltas") if weighted else F.transform("bits", lambda _: F.lit(1.0))
    q = query_sketches.select("id", F.zip_with("bits", weights, lambda b, d: d * (2 * b - 1)).alias("vec"))
    x = sketches.select("id", F.col("bits").cast("array<double>").alias("vec"))
    few = knn(q, x, ratio * k, "negative_dot", exclude_self=exclude_self)
    return refine(few, queries, items, l2, k, key=key, value=vec)


def histogram(vectors: DataFrame, blocks: Sequence[Sequence[HashFamily]], key: str = "set_id", weight: str | None = "weight", vec: str = "vec", unit: bool = False) -> DataFrame:
    """set_id, slot, value: N blocks of counters, each the sum of M bounded hashes' weighted counts; unit: at unit Euclidean length.

    Rows are added up map-side by set and slot, so a set of any size meets in as many rows as it has slots.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    slots, base = [], 0
    for block in blocks:
        size = max(f.range for f in block)
        if not size:
            raise ValueError("bounded hashes only")
        slots += [F.lit(base).cast("long") + f.hash(F.col(vec)) for f in block]
        base += size
    rows = vectors.select(F.col(key), w.alias("w"), F.explode(F.array(*slots)).alias("slot"))
    out = rows.groupBy(key, "slot").agg(F.sum("w").alias("value"))
    if unit:
        norm = out.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"))
        out = out.join(norm, key).select(key, "slot", (F.col("value") / F.col("n")).alias("value"))
    return out


def densify(histograms: DataFrame, size: int, key: str = "set_id") -> DataFrame:
    """set_id, vec: all slots, zeros included."""
    m = histograms.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("m"))
    return m.select(key, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))
