"""Near-duplicate vectors: an exact range join in the metric of unit vectors.

Cosine c is Euclidean distance sqrt(2 - 2c) between unit vectors. Every vector belongs to the cell of its nearest
pivot; pivots are centres of a sample. A vector y of cell q is copied into cell p < q only if some x of cell p could be
within the radius r: d(y, p) - d(y, q) <= 2r and min d(x, p) - r <= d(y, p) <= max d(x, p) + r by the triangle
inequality, and its distance to the plane between the pivots is at most r. Cells then join independently, in blocks of
bounded size; a block gives counts and a spanning forest of its links, never the pairs. Vectors are shipped as they
come (single precision stays single) and made unit vectors where they are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ._common import bounded, bounded_share, discard, materialise, settled

COSINE = 0.95
#: Rows that pivots are chosen from, rows of a cell aimed at, pivots at most.
PIVOT_ROWS, CELL_ROWS, MAX_PIVOTS = 16_384, 16_384, 4096
#: Rows of a block's two sides for 64 dimensions; fewer for more.
CORE, OUTER = 16_384, 32_768
#: Cells that there may be, over all dimensions.
MAX_CELLS = 1 << 20
_EPS = 1e-6
SLICE = 1024


def units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # so that no square over- or underflows
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def good_rows(x: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each dimension: the rows that have finite vectors other than zero, and those as they are."""
    if not isinstance(x.type, pa.ListType):
        x = x.cast(pa.list_(x.type.value_type))
    kind = pa.float32() if pa.types.is_float32(x.type.value_type) else pa.float64()
    values = pc.fill_null(x.values.cast(kind), float("nan")).to_numpy(zero_copy_only=False)
    at = np.asarray(x.offsets)
    size = np.where(np.asarray(pc.is_valid(x)), np.diff(at), 0)
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        v = values[at[rows][:, None] + np.arange(d)]
        top = np.abs(v).max(1)
        ok = np.isfinite(top) & (top > 0)
        if ok.any():
            yield d, rows[ok], v[ok]


def choose_pivots(x: np.ndarray, k: int, rounds: int = 4, seed: int = 3) -> np.ndarray:
    """Unit centres of at most k clusters of the unit vectors x: k-means from rows at random, so that cells are alike in size."""
    c = np.unique(x[np.random.default_rng(seed).permutation(len(x))[:k]], axis=0)
    for _ in range(rounds):
        near = np.concatenate([(x[lo : lo + 1024] @ c.T).argmax(1) for lo in range(0, len(x), 1024)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        length = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(length > 1e-9, total / np.maximum(length, 1e-9), c)
    return c


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (v @ pivots.T), 0))


def _binary(v: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(v)], pa.binary())


class Block:
    """Rows that are compared: side 0 with side 1, or side 0 with itself if there is no side 1; all of one dimension."""

    def __init__(self) -> None:
        self.ids: tuple[list[int], list[int]] = ([], [])
        self.vectors: tuple[list[bytes], list[bytes]] = ([], [])
        self.times: tuple[list[int], list[int]] = ([], [])

    def _units(self, side: int, kind: str) -> np.ndarray:
        return units(np.frombuffer(b"".join(self.vectors[side]), kind).astype(np.float64).reshape(len(self.ids[side]), -1))

    def solve(self, cosine: float, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids with links, how many links, and the smallest id that the links of this block connect each with."""
        self_join = not self.ids[1]
        a = self._units(0, kind)
        b = a if self_join else self._units(1, kind)
        close = max(2e-5, 2.5e-7 * (a.shape[1] + 8))  # more than single precision may be off by
        ids = np.array(self.ids[0] + self.ids[1], np.int64)
        times_a, times_b = (np.array(self.times[i], np.float64) for i in (0, 0 if self_join else 1))
        shift = 0 if self_join else len(a)
        n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if len(a) and len(b):
            a32, b32 = a.astype(np.float32), b.astype(np.float32)
            for lo in range(0, len(a), 512):
                first = lo if self_join else 0
                c = a32[lo : lo + 512] @ b32[first:].T
                near = c >= np.float32(cosine)
                x, y = np.nonzero(np.abs(c - np.float32(cosine)) < close)
                if len(x):  # too close for single precision
                    near[x, y] = np.einsum("ij,ij->i", a[lo + x], b[first + y]) >= cosine
                if self_join:
                    near &= np.arange(near.shape[1]) > np.arange(len(near))[:, None]
                some = np.flatnonzero(near.any(1))
                if len(some):
                    n[lo + some] += (near[some] @ times_b[first:]).astype(np.int64)  # whole numbers, far below 2^53
                    n[shift + first :][: near.shape[1]] += (times_a[lo + some] @ near[some]).astype(np.int64)
                for i in some:
                    there = np.append(shift + first + np.flatnonzero(near[i]), lo + i)
                    got = label[there]
                    if got.min() != got.max():
                        label[np.isin(label, got)] = got.min()
        found = np.flatnonzero(n)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label[found], ids[found])
        return ids[found], n[found], least[label[found]]


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per row of vectors: key, n_links, component_id, kept.

    Two rows are linked if their vectors have the same dimension and a cosine, in double precision, of ``cosine`` or
    more; vectors that are null, empty, zero, or hold null or non-finite components are linked with nothing.
    n_links: other rows linked directly; component_id: the smallest key that links reach, its own included; kept: the
    key is that one. Rows that repeat a key are different vectors that share a name. A null key takes the name of its
    component, if that has one. Nothing is estimated: pivots, chosen from about PIVOT_ROWS rows, only set the cost.
    """
    rows = materialise(vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("key"), F.col(vector).alias("v")), "vectors")
    count = rows.count()
    kind = "<f4" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"
    radius = float(np.sqrt(2 - 2 * cosine))

    def sampled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for d, _, v in good_rows(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(v), pa.int32()), _binary(units(v.astype(np.float64)).astype(np.float32))], names=["d", "v"])

    pivots: dict[int, np.ndarray] = {}
    sample = sorted((r[0], bytes(r[1])) for r in bounded_share(rows, "uid", None, PIVOT_ROWS).select("v").mapInArrow(sampled, "d int, v binary").collect())
    for d in sorted({d for d, _ in sample}):
        of = np.stack([np.frombuffer(v, np.float32) for e, v in sample if e == d]).astype(np.float64)
        of = of / np.sqrt((of * of).sum(1, keepdims=True))
        pivots[d] = choose_pivots(of, min(MAX_PIVOTS, max(1, round(count * len(of) / len(sample) / CELL_ROWS))))

    def pivots_of(d: int) -> np.ndarray:
        return pivots[d] if d in pivots else np.eye(1, d)

    def assigned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for d, at, v in good_rows(b.column(1)):
                for lo in range(0, len(v), SLICE):
                    part = v[lo : lo + SLICE]
                    dist = _distances(units(part.astype(np.float64)), pivots_of(d))
                    own = dist.argmin(1)
                    cell = pa.array(d * MAX_PIVOTS + own, pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[lo : lo + SLICE])), _binary(part), cell, pa.array(dist[np.arange(len(part)), own])], names=["uid", "v", "cell", "dist"])

    cells = materialise(rows.select("uid", "v").mapInArrow(assigned, "uid long, v binary, cell long, dist double"), "cells")
    # equal vectors are compared once: the smallest uid stands for all, and counts as often as there are
    alike = cells.groupBy(F.md5("v").alias("digest")).agg(F.min("uid").alias("rep"), F.count("*").alias("times"))
    alike = materialise(alike, "alike")
    same = materialise(cells.select("uid", F.md5("v").alias("digest")).join(alike.hint("merge"), "digest").select("uid", "rep", "times"), "same")
    every = cells
    cells = materialise(cells.join(same.where("uid = rep").select("uid", "times").hint("merge"), "uid").select("uid", "v", "cell", "dist", "times"), "distinct")
    discard(every, alike)
    # a row for each pivot at most
    reach = {r[0]: (r[1], r[2]) for r in cells.groupBy("cell").agg(F.min("dist"), F.max("dist")).collect()}
    bounds = {}
    for d in {c // MAX_PIVOTS for c in reach}:
        p = pivots_of(d)
        known = [reach.get(d * MAX_PIVOTS + i, (np.inf, -np.inf)) for i in range(len(p))]
        bounds[d] = np.array(known) + np.array([-radius - _EPS, radius + _EPS])

    def copied(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = {}
        for b in it:
            cell, own_dist = b.column(2).to_numpy(), b.column(3).to_numpy()
            for d in np.unique(cell // MAX_PIVOTS).tolist():
                p, (low, high) = pivots_of(d), bounds[d].T
                if d not in apart:
                    apart[d] = np.maximum(2 * _distances(p, p), 1e-9)
                rows_of = np.flatnonzero(cell // MAX_PIVOTS == d)
                for lo in range(0, len(rows_of), SLICE):
                    some = rows_of[lo : lo + SLICE]
                    own, near = cell[some] % MAX_PIVOTS, own_dist[some][:, None]
                    v = np.frombuffer(b"".join(b.column(1).take(pa.array(some)).to_pylist()), kind).astype(np.float64).reshape(len(some), d)
                    dist = _distances(units(v), p)
                    goes = (dist - near <= 2 * radius + _EPS) & (dist >= low) & (dist <= high) & ((dist**2 - near**2) / apart[d][own] <= radius + _EPS)
                    goes &= np.arange(len(p)) < own[:, None]
                    goes[np.arange(len(some)), own] = True
                    q, i = np.nonzero(goes.T)
                    take = pa.array(some[i])
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in (0, 1, 4)), pa.array(d * MAX_PIVOTS + q), pa.array(own[i] != q)], names=["uid", "v", "times", "cell", "outer"])

    held = cells.mapInArrow(copied, "uid long, v binary, times long, cell long, outer boolean")
    scale = 64.0 / max([64, *pivots])
    core, outer = max(64, int(CORE * scale)), max(256, int(OUTER * scale))
    held = held_rows = materialise(held, "held")
    sizes = held.groupBy("cell").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("outer")) / core)).cast("int").alias("ca"), F.ceil(F.count_if("outer") / outer).cast("int").alias("cb")
    )
    held = held.join(bounded(sizes, MAX_CELLS, "cells"), "cell")
    k = F.pmod(F.xxhash64("uid", F.lit(41)), F.when(F.col("outer"), F.col("cb")).otherwise(F.col("ca"))).cast("int")
    held = held.withColumn("k", k)
    to = F.expr(
        """CASE WHEN outer THEN transform(sequence(0, ca - 1), i -> named_struct('i', i, 'j', ca + k, 'side', 1))
           ELSE concat(transform(filter(sequence(0, ca + cb - 1), j -> j >= k), j -> named_struct('i', k, 'j', j, 'side', 0)),
                       transform(filter(sequence(0, ca - 1), i -> i < k), i -> named_struct('i', i, 'j', k, 'side', 1))) END"""
    )

    def joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, Block()

        def solved() -> pa.RecordBatch:
            ids, n, least = block.solve(cosine, kind)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(least)], names=["uid", "n", "to"])

        for b in it:
            c, times = [b.column(i).to_pylist() for i in range(4)], b.column(6).to_pylist()
            for i, g in enumerate(zip(*c[:3], strict=True)):
                if g != at:
                    if at is not None:
                        yield solved()
                    at, block = g, Block()
                side = c[3][i]
                block.ids[side].append(b.column(4)[i].as_py())
                block.vectors[side].append(b.column(5)[i].as_py())
                block.times[side].append(times[i])
        if at is not None:
            yield solved()

    blocks = held.select("cell", F.explode(to).alias("t"), "uid", "v", "times").select("cell", "t.i", "t.j", "t.side", "uid", "v", "times")
    blocks = blocks.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    links = materialise(blocks.mapInArrow(joined, "uid long, n long, to long"), "vector-links")
    discard(cells, held_rows)

    def whole() -> DataFrame:
        counts = links.groupBy(F.col("uid").alias("rep")).agg(F.sum("n").alias("n"))
        of = components(links.select(F.col("uid").alias("a"), F.col("to").alias("b"))).withColumnRenamed("id", "rep")
        mine = same.where("uid = rep").select("rep", "times").join(of, "rep", "left").join(counts, "rep", "left")
        mine = mine.select("rep", F.coalesce("component", "rep").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n")).where("n > 0")
        named = same.select("uid", "rep").join(mine.hint("merge"), "rep").join(rows.select("uid", "key"), "uid")
        least = named.groupBy("component").agg(F.min("key").alias("least"))
        found = named.select("uid", "component", "n").join(least.hint("merge"), "component").select("uid", "least", "n")
        return rows.select("uid", "key").join(found, "uid", "left")

    out = settled(whole, "vector-classes")
    discard(rows, links, same)
    component = F.coalesce("least", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("key"), component.isNull()).alias("kept"))
