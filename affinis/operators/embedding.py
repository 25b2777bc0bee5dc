"""Embedding: reference distances, classical scaling, and a bounded solver for all other items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: References come to the driver as a square matrix.
MAX_REFERENCES = 10_000


def classical_scaling(d: np.ndarray, dim: int) -> np.ndarray:
    """r x dim coordinates of a distance matrix; dimensions without a positive eigenvalue are zero."""
    r = len(d)
    centre = np.eye(r) - 1 / r
    value, vector = np.linalg.eigh(-0.5 * centre @ (d * d) @ centre)
    order = np.argsort(value)[::-1][:dim]
    out = np.zeros((r, dim))
    out[:, : len(order)] = vector[:, order] * np.sqrt(np.maximum(value[order], 0))
    return out


def solve(refs: np.ndarray, d: np.ndarray, steps: int = 200, bound: float = 0.5, tolerance: float = 1e-3) -> np.ndarray:
    """n x dim points in the box [-bound, bound] that least miss the distances d (n x r) to the references, from 0.

    Projected gradient with a Barzilai-Borwein step and a safeguard, all rows at once.
    """
    eps = 1e-9

    def value(x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (refs * refs).sum(1)[None] - 2 * x @ refs.T, eps))
        miss = gap - d
        ratio = miss / gap
        return (miss * miss).sum(1), 2 * (x * ratio.sum(1)[:, None] - ratio @ refs)

    x = np.zeros((len(d), refs.shape[1]))
    f, g = value(x, d)
    step = np.full(len(d), 0.5 / max(len(refs), 1))
    live = np.arange(len(d))
    for _ in range(steps):
        if not len(live):
            break
        to = np.clip(x[live] - step[live, None] * g[live], -bound, bound)
        f2, g2 = value(to, d[live])
        worse = f2 > f[live] + 1e-12
        step[live[worse]] /= 4
        ok = live[~worse]
        dx, dg = to[~worse] - x[ok], g2[~worse] - g[ok]
        x[ok], f[ok], g[ok] = to[~worse], f2[~worse], g2[~worse]
        num, den = (dx * dx).sum(1), (dx * dg).sum(1)
        step[ok] = np.where(den > 1e-15, np.clip(num / np.maximum(den, 1e-15), 1e-6, 10.0), step[ok])
        moves = np.abs(np.clip(x - g, -bound, bound) - x).max(1) if len(x) else np.zeros(0)
        live = live[(moves[live] > tolerance) & (step[live] > 1e-12)]
    return x


def reference_matrix(distances: DataFrame) -> tuple[list[int], np.ndarray]:
    """(left_id, right_id, dist) of all pairs of references -> their ids in order, and the square matrix."""
    n = distances.select("left_id").distinct().count()
    if n > MAX_REFERENCES:
        raise ValueError(f"{n} references; {MAX_REFERENCES} at most")
    rows = distances.select("left_id", "right_id", F.col("dist").cast("double")).toArrow()
    left, right = (rows[c].to_numpy() for c in ("left_id", "right_id"))
    ids, d = np.unique(left), np.zeros((n, n))
    d[np.searchsorted(ids, left), np.searchsorted(ids, right)] = rows["dist"].to_numpy()
    return ids.tolist(), d


def distances_to_references(distances: DataFrame, ids: list[int]) -> DataFrame:
    """(query_id, target_id, dist) -> id, dists: in order of the references; an item without all of them is left out."""
    rows = distances.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("target_id", "dist"))).alias("d"))
    return rows.where(F.size("d") == len(ids)).select("id", F.transform("d", lambda x: x.dist).alias("dists"))


def embed(dists: DataFrame, coordinates: np.ndarray, key: str = "id", column: str = "dists") -> DataFrame:
    """id, vec array<double> from the distances to the references. Works on a stream too."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                d = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                x = solve(coordinates, d)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), vec], names=["id", "vec"])

    rows = dists.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("d")).where("d IS NOT NULL")
    return rows.mapInArrow(batches, "id long, vec array<double>")


def stress(distances: DataFrame) -> float:
    """Normalised misfit of a table with dist and embedded distances."""
    row = distances.agg(F.sum(F.pow(F.col("dist") - F.col("embedded"), F.lit(2.0))), F.sum(F.pow("dist", F.lit(2.0)))).first()
    return float(np.sqrt((row[0] or 0.0) / row[1])) if row[1] else 0.0
