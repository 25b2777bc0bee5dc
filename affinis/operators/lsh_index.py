"""Locality-sensitive indexes as tables of buckets: flat, multi-probe, adaptive, a-posteriori and forest.

An index is a table (tbl, bucket, id); a query is probes (query_id, tbl, depth, bucket) joined to it on (tbl, bucket).
Projections of many vectors are one matrix product per batch.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lsh import HashFamily
from ..plans.lineage import fresh, materialise
from .search import BLOCK_BYTES, _batch, _blocks, _exact, _Nearest, _rough, matrix, refine, top_k

MAX_PROBES = 200
UINT32 = 0xFFFFFFFF
#: A depth beyond all probes.
NEVER = 255
#: Queries that a worker looks up at a time, and meetings of them with items.
LOOKUP, MEETINGS = 2048, 1 << 20
#: So many blocks of queries become one plan; more are looked up in turn.
LAZY = 8


@dataclass(frozen=True)
class LshParams:
    """L tables of M projections of width W; H folds buckets (0: not at all, which only saves collisions)."""

    a: np.ndarray
    b: np.ndarray
    mix: np.ndarray
    w: float
    h: int = 0

    @classmethod
    def random(cls, dim: int, tables: int = 10, projections: int = 4, w: float = 0.8, h: int = 0, seed: int = 0) -> LshParams:
        rnd = np.random.Generator(np.random.PCG64(seed))
        return cls(rnd.standard_normal((tables, projections, dim)), rnd.uniform(0, w, (tables, projections)), rnd.integers(1, 1 << 31, (tables, projections)), w, h)

    @property
    def tables(self) -> int:
        return len(self.a)

    @property
    def projections(self) -> int:
        return self.a.shape[1]

    def values(self, x: np.ndarray) -> np.ndarray:
        """n x L x M: (a.x + b) / w."""
        flat = x @ self.a.reshape(-1, self.a.shape[2]).T
        return (flat.reshape(len(x), *self.b.shape) + self.b) / self.w

    def buckets(self, h: np.ndarray) -> np.ndarray:
        """Hash values (..., L, M) -> buckets (..., L): their mixed sum modulo 2^32, folded to h."""
        out = np.zeros(h.shape[:-1], np.uint64)
        for m in range(h.shape[-1]):
            out += (h[..., m].astype(np.int64).astype(np.uint64) & np.uint64(UINT32)) * self.mix[..., m].astype(np.uint64)
        out &= np.uint64(UINT32)
        return (out % np.uint64(self.h) if self.h else out).astype(np.int64)


@lru_cache
def probe_template(m: int, t: int) -> tuple[tuple[tuple[int, bool], ...], ...]:
    """The first t sets of moves in order of expected score; a move is (rank, away from the nearer edge)."""
    if t > MAX_PROBES:
        raise ValueError(f"{MAX_PROBES} probes at most")
    near = [(i + 1) * (i + 2) / ((m + 1) * (m + 2)) / 4 for i in range(m)]
    moves = sorted([(near[i], i, False) for i in range(m)] + [(1 - (i + 1) / (m + 1) + near[i], i, True) for i in range(m)])
    heap: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    out = []
    while heap and len(out) < t:
        score, chosen = heapq.heappop(heap)
        out.append(tuple((moves[i][1], moves[i][2]) for i in chosen))
        taken = {moves[i][1] for i in chosen}
        for i in range(chosen[-1] + 1 if chosen else 0, len(moves)):
            if moves[i][1] not in taken:
                heapq.heappush(heap, (score + moves[i][0], (*chosen, i)))
    return tuple(out)


def probes_of(values: np.ndarray, params: LshParams, t: int) -> np.ndarray:
    """n x T x L buckets: the home bucket first, then moves to neighbours by the template."""
    home = np.floor(values)
    frac = values - home
    to_edge = np.minimum(frac, 1 - frac)
    order = np.argsort(to_edge, axis=-1, kind="stable")
    nearer = np.where(frac <= 0.5, -1.0, 1.0)
    out = []
    for moves in probe_template(params.projections, t):
        h = home.copy()
        for rank, away in moves:
            which = order[..., rank : rank + 1]
            step = np.take_along_axis(nearer, which, -1) * (-1 if away else 1)
            np.put_along_axis(h, which, np.take_along_axis(h, which, -1) + step, -1)
        out.append(params.buckets(h))
    return np.stack(out, 1)


def build_index(items: DataFrame, params: LshParams, key: str = "id", vec: str = "vec") -> DataFrame:
    """(tbl, bucket, id), an id once per table. Null vectors are in no bucket."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                bucket = params.buckets(np.floor(params.values(matrix(part.column(1)))))
                n, tables = bucket.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(bucket.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), tables))], names=["tbl", "bucket", "id"]
                )

    rows = items.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return rows.mapInArrow(batches, "tbl int, bucket long, id long")


def build_probes(queries: DataFrame, params: LshParams, t: int, key: str = "id", vec: str = "vec") -> DataFrame:
    """(query_id, tbl, depth, bucket), depth from 0; t = 1 probes home buckets alone. A bucket may come at several depths."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                bucket = probes_of(params.values(matrix(part.column(1))), params, t)
                n, depths, tables = bucket.shape
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column(0).to_numpy(), depths * tables)),
                        pa.array(np.tile(np.arange(tables, dtype=np.int32), n * depths)),
                        pa.array(np.tile(np.repeat(np.arange(depths, dtype=np.int32), tables), n)),
                        pa.array(bucket.ravel()),
                    ],
                    names=["query_id", "tbl", "depth", "bucket"],
                )

    rows = queries.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return rows.mapInArrow(batches, "query_id long, tbl int, depth int, bucket long")


def candidates(probes: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, target_id, depth): each item that a probe meets once, at the first depth. A hot bucket is split by the skew join."""
    return probes.join(index, ["tbl", "bucket"]).groupBy("query_id", F.col("id").alias("target_id")).agg(F.min("depth").alias("depth"))


def flat_index(items: DataFrame, families: Sequence[HashFamily], key: str = "id", vec: str = "vec") -> DataFrame:
    """(tbl, bucket, id): a table for each hash family, by column functions alone. Null vectors are in no bucket."""
    hashes = F.posexplode(F.array(*[f.hash(F.col(vec)) for f in families])).alias("tbl", "bucket")
    return items.where(F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("id"), hashes).select("tbl", "bucket", "id")


def flat_candidates(query_index: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, target_id) that share a bucket of some table."""
    return query_index.withColumnRenamed("id", "query_id").join(index.withColumnRenamed("id", "target_id"), ["tbl", "bucket"]).select("query_id", "target_id").distinct()


class _Lookup:
    """The probes of a block of queries, sorted by bucket: an equi-join with items that holds no pair."""

    def __init__(self, q: np.ndarray, params: LshParams, t: int) -> None:
        probes = np.concatenate([probes_of(params.values(q[lo : lo + 256]), params, t) for lo in range(0, len(q), 256)])
        n, self.depths, tables = probes.shape
        key = (probes.astype(np.uint64) | (np.arange(tables, dtype=np.uint64) << np.uint64(32))).ravel()
        order = np.argsort(key, kind="stable")
        self.n, self.key = n, key[order]
        self.query, self.depth = (order // (self.depths * tables)).astype(np.int32), (order // tables % self.depths).astype(np.uint8)

    def first(self, tbl: np.ndarray, bucket: np.ndarray, owner: np.ndarray, items: int) -> np.ndarray:
        """queries x items: the first depth at which a query meets an item (owner of a bucket of a table); NEVER if at none."""
        key = bucket.astype(np.uint64) | (tbl.astype(np.uint64) << np.uint64(32))
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        out = np.full(self.n * items, NEVER, np.uint8)
        ends = np.cumsum(high - low)
        at, total = 0, int(ends[-1]) if len(ends) else 0
        while at < total:  # bounded pieces of the hits
            lo, to = int(np.searchsorted(ends, at, "right")), int(np.searchsorted(ends, at + MEETINGS, "right"))
            to = max(to, lo + 1)
            many = (high - low)[lo:to]
            mine = np.arange(many.sum()) + np.repeat(low[lo:to] - (np.cumsum(many) - many), many)
            np.minimum.at(out, self.query[mine].astype(np.int64) * items + np.repeat(owner[lo:to], many), self.depth[mine])
            at = int(ends[to - 1])
        return out.reshape(self.n, items)


class _NearestUpto:
    """What may be among the k best up to some depth, of what one task has seen: fewer than k are nearer at depths up to its own."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, depths: int) -> None:
        self.ids, self.q, self.k, self.depths = ids, q, k, depths
        self.kept = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.limit = np.full((len(ids), depths), np.inf)

    def add(self, item_ids: np.ndarray, x: np.ndarray, first: np.ndarray) -> None:
        for i in range(len(self.ids)):
            at = np.flatnonzero(first[i] != NEVER)
            if not len(at):
                continue
            rough, slack = _rough(self.q[i : i + 1], x[at], "l2")
            depth = first[i, at].astype(np.int64)
            limit = self.limit[i, depth]
            near = rough[0] - slack[0] <= limit * limit * (1 + 1e-15)
            at, depth = at[near], depth[near]
            if len(at):
                old = self.kept[i]
                self._keep(i, np.concatenate([old[0], _exact(self.q[i], x[at], "l2")]), np.concatenate([old[1], item_ids[at]]), np.concatenate([old[2], depth]))

    def _keep(self, i: int, dist: np.ndarray, ids: np.ndarray, depth: np.ndarray) -> None:
        order = np.lexsort((ids, dist))
        # a depth whose k are full is full for all later ones: only earlier depths are open
        count, open_, take = np.zeros(self.depths, np.int64), self.depths, []
        self.limit[i] = np.inf
        for at, d in zip(order.tolist(), depth[order].tolist(), strict=True):
            if d < open_:
                take.append(at)
                count[d:] += 1
                while open_ and count[open_ - 1] >= self.k:
                    open_ -= 1
                    self.limit[i, open_] = dist[at]
                if not open_:
                    break
        self.kept[i] = dist[take], ids[take], depth[take]

    def rest(self) -> pa.RecordBatch:
        n = [len(d) for d, _, _ in self.kept]
        dist, ids, depth = (np.concatenate([c[j] for c in self.kept]) for j in range(3))
        columns = [np.repeat(self.ids, n), ids.astype(np.int64), depth.astype(np.int32), dist]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "target_id", "depth", "dist"])


def _scan(queries: DataFrame, items: DataFrame, index: DataFrame, params: LshParams, k: int, t: int, upto: bool, key: str, vec: str) -> DataFrame:
    """Hits of the items in probed buckets: (query_id, target_id, dist), with upto also depth, k for each task and query.

    The index goes back to its items, with their vectors; blocks of queries go to the workers, which look their buckets up.
    """
    buckets = index.groupBy("id").agg(F.collect_list("tbl").alias("tbl"), F.collect_list("bucket").alias("bucket"))
    rows = items.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.join(buckets, "id").select("id", "v", "tbl", "bucket")
    schema = "query_id long, target_id long, " + ("depth int, dist double" if upto else "dist double")
    if t > MAX_PROBES:
        raise ValueError(f"{MAX_PROBES} probes at most")

    def task(ids: np.ndarray, q: np.ndarray):
        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = [(slice(lo, lo + LOOKUP), None, None) for lo in range(0, len(ids), LOOKUP)]
            for at, (mine, _, _) in enumerate(blocks):
                near = _NearestUpto(ids[mine], q[mine], k, t) if upto else _Nearest(ids[mine], q[mine], k, "l2", None, 1, False)
                blocks[at] = mine, _Lookup(q[mine], params, t), near
            for b in it:
                for lo in range(0, b.num_rows, 512):
                    part = b.slice(lo, 512)
                    tbl, bucket = (part.column(j).flatten().to_numpy(zero_copy_only=False) for j in (2, 3))
                    owner = np.repeat(np.arange(part.num_rows), np.diff(part.column(2).offsets.to_numpy()))
                    there, x = part.column(0).to_numpy(), matrix(part.column(1))
                    for _, lookup, near in blocks:
                        first = lookup.first(tbl, bucket, owner, part.num_rows)
                        if upto:
                            near.add(there, x, first)
                        else:
                            for _ in near.hits(there, x, first != NEVER):
                                pass
            for _, _, near in blocks:
                if upto:
                    yield near.rest()
                else:
                    yield from map(_batch, near.rest())

        return batches

    # a block of queries with its probes takes BLOCK_BYTES: 13 bytes for each probe
    found, path, n = None, None, 0
    few = max(1, BLOCK_BYTES // (8 * params.a.shape[2] + 13 * t * params.tables))
    for ids, q in _blocks(queries, key, vec)[1]:
        for lo in range(0, len(ids), 4 * few):
            got = rows.mapInArrow(task(ids[lo : lo + 4 * few], q[lo : lo + 4 * few]), schema)
            n += 1
            if n <= LAZY:
                found = got if found is None else found.unionAll(got)
            else:
                if path is None:
                    path = fresh(queries.sparkSession, "lookups")
                    found.write.mode("append").parquet(path)
                got.write.mode("append").parquet(path)
    if path is not None:
        return queries.sparkSession.read.schema(schema).parquet(path)
    return queries.sparkSession.createDataFrame([], schema) if found is None else found


def search(queries: DataFrame, items: DataFrame, params: LshParams, k: int, t: int, index: DataFrame | None = None, key: str = "id", vec: str = "vec", distance=None) -> DataFrame:
    """query_id, target_id, dist, rank: the k best of the candidates by the exact distance (Euclidean by default).

    By Euclidean distance candidates are met and measured in the workers and never become rows; another distance takes a
    table of candidates. Ids of items are distinct.
    """
    from ..functions.measures import l2

    index = index if index is not None else build_index(items, params, key, vec)
    if distance is None or distance is l2:
        return top_k(_scan(queries, items, index, params, k, t, False, key, vec), k)
    return refine(candidates(build_probes(queries, params, t, key, vec), index), queries, items, distance, k, key=key, value=vec)


def cost(found: DataFrame, n_items: int) -> DataFrame:
    """query_id, scanned, cost: distinct candidates and their share of all items."""
    return found.groupBy("query_id").agg(F.count_distinct("target_id").alias("scanned")).withColumn("cost", F.col("scanned") / F.lit(n_items))


def adaptive(queries: DataFrame, items: DataFrame, params: LshParams, k: int, t: int, recall: float, key: str = "id", vec: str = "vec") -> DataFrame:
    """query_id, target_id, dist, rank, depth: as search, but each query stops at the first depth whose k best are expected to hold ``recall`` of the true ones.

    The expectation for a neighbour at distance d after j probes comes from the model of recall, as a table of 200 steps.
    """
    from .tuning import recall_table

    table = recall_table(params.w, params.projections, params.tables, t)

    def ranked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best up to each depth, of rows that come by query, distance and id."""

        def best(q: int, ids: np.ndarray, depth: np.ndarray, dist: np.ndarray) -> list[np.ndarray]:
            first = [np.flatnonzero(depth <= j)[:k] for j in range(t)]
            n, at = [len(f) for f in first], np.concatenate(first)
            rank = np.concatenate([np.arange(1, x + 1) for x in n])
            return [np.full(len(at), q), ids[at], dist[at], np.repeat(np.arange(t), n), rank]

        kinds, names = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), ["query_id", "target_id", "dist", "depth", "rank"]
        at, open_ = None, []
        for b in it:
            c, out = [b.column(i).to_numpy() for i in range(4)], []
            cut = np.flatnonzero(np.append(True, c[0][1:] != c[0][:-1])) if b.num_rows else []
            for lo, hi in zip(cut, np.append(cut[1:], b.num_rows), strict=True) if len(cut) else ():
                if open_ and c[0][lo] != at:
                    out.append(best(at, *(np.concatenate(x) for x in zip(*open_, strict=True))))
                    open_ = []
                at = int(c[0][lo])
                open_.append([x[lo:hi].copy() for x in c[1:]])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)).cast(kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if open_:
            out = best(at, *(np.concatenate(x) for x in zip(*open_, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x).cast(kind) for x, kind in zip(out, kinds, strict=True)], names=names)

    few = _scan(queries, items, build_index(items, params, key, vec), params, k, t, True, key, vec)
    dealt = few.repartition("query_id").sortWithinPartitions("query_id", "dist", "target_id").select("query_id", "target_id", "depth", "dist")
    best = materialise(dealt.mapInArrow(ranked, "query_id long, target_id long, dist double, depth int, rank int"), "upto-depths")
    step = F.floor((F.log(F.greatest("dist", F.lit(table.low))) - float(np.log(table.low))) * table.steps / float(np.log(table.high / table.low)) + 0.5).cast("int")
    flat = F.array(*[F.lit(float(v)) for v in table.values.ravel()])
    at = F.col("depth") * table.steps + F.least(step, F.lit(table.steps - 1)) + 1
    expected = F.when(F.col("dist") < table.low, 1.0).when(F.col("dist") >= table.high, 0.0).otherwise(F.element_at(flat, at))
    means = best.withColumn("e", expected).groupBy("query_id", "depth").agg(F.sum("e").alias("e"), F.count("*").alias("n"))
    stop = means.groupBy("query_id").agg(F.coalesce(F.min(F.when((F.col("n") >= k) & (F.col("e") / k >= recall), F.col("depth"))), F.max("depth")).alias("depth"))
    return best.join(stop, ["query_id", "depth"])


class APosteriori:
    """Which buckets a query's neighbours fall into, learned from example queries and their neighbours."""

    THRESHOLD = 1e-7

    def __init__(self, params: LshParams, queries: np.ndarray, neighbours: list[np.ndarray], cells: int = 100, sigma: float = 0.2, expand: float = 0.1) -> None:
        self.params, self.cells = params, cells
        tables, m = params.b.shape
        q = params.values(queries).reshape(len(queries), -1)
        v = [params.values(x).reshape(len(x), -1) for x in neighbours]
        mean = np.stack([x.mean(0) for x in v])
        var = np.stack([x.var(0, ddof=1) if len(x) > 1 else np.zeros(x.shape[1]) for x in v])
        every = np.concatenate([q, *v])
        low, high = every.min(0), every.max(0)
        self.low, self.high = low - expand * (high - low), high + expand * (high - low)
        centres = self.low + (np.arange(cells)[:, None] + 0.5) * (self.high - self.low) / cells
        self.mean, self.std = np.zeros((cells, tables * m)), np.zeros((cells, tables * m))
        for j in range(tables * m):
            k = np.exp(-0.5 * ((q[:, j][None] - centres[:, j][:, None]) / sigma) ** 2) + 1e-300
            k /= k.sum(1, keepdims=True)
            self.mean[:, j], self.std[:, j] = k @ mean[:, j], np.sqrt(np.maximum(k @ var[:, j], 1e-12))

    def choices(self, value: float, j: int) -> list[tuple[float, int]]:
        """Hash values of component j by falling probability: the normal law of its cell, cut at whole numbers."""
        width = max(self.high[j] - self.low[j], 1e-12)
        cell = int(np.clip((value - self.low[j]) / width * self.cells, 0, self.cells - 1))
        mean, std = self.mean[cell, j], self.std[cell, j]
        reach = std * math.sqrt(-2 * math.log(self.THRESHOLD)) + 1  # less than THRESHOLD lies beyond
        edges = np.arange(math.floor(mean - reach), math.floor(mean + reach) + 2)
        p = np.diff([math.erf((e - mean) / (std * math.sqrt(2))) / 2 for e in edges])
        likely = np.lexsort((edges[:-1], -p))
        likely = likely[p[likely] >= self.THRESHOLD]
        return [(float(p[i]), int(edges[i])) for i in likely]

    def probes(self, values: np.ndarray, t: int, recall: float) -> list[tuple[int, ...]]:
        """Hash tuples of one table (values: its offset and M values) by falling probability, until t or enough in sum."""
        offset, values = int(values[0]), values[1:]
        options = [self.choices(v, offset + i) for i, v in enumerate(values)]
        enough = 1 - (1 - recall) ** (1 / self.params.tables)
        start = (0,) * len(options)
        score = lambda c: float(np.prod([options[i][x][0] for i, x in enumerate(c)]))
        heap, seen, out, total = [(-score(start), start)], {start}, [], 0.0
        while heap and len(out) < t and total < enough:
            p, c = heapq.heappop(heap)
            out.append(tuple(options[i][x][1] for i, x in enumerate(c)))
            total -= p
            for i, x in enumerate(c):
                n = (*c[:i], x + 1, *c[i + 1 :])
                if x + 1 < len(options[i]) and n not in seen:
                    seen.add(n)
                    heapq.heappush(heap, (-score(n), n))
        return out


def a_posteriori_probes(queries: DataFrame, model: APosteriori, t: int, recall: float = 0.9, key: str = "id", vec: str = "vec") -> DataFrame:
    """(query_id, tbl, depth, bucket) by the model's probabilities."""
    params = model.params

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows: list[tuple[int, int, int, int]] = []
            if b.num_rows:
                ids, values = b.column(0).to_pylist(), params.values(matrix(b.column(1)))
                for i, q in enumerate(ids):
                    for tbl in range(params.tables):
                        hs = model.probes(np.concatenate([[tbl * params.projections], values[i, tbl]]), t, recall)
                        h = np.zeros((len(hs), *params.b.shape))
                        h[:, tbl] = hs
                        rows += [(q, tbl, d, x) for d, x in enumerate(params.buckets(h)[:, tbl].tolist())]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["query_id", "tbl", "depth", "bucket"])

    rows = queries.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return rows.mapInArrow(batches, "query_id long, tbl int, depth int, bucket long")


def prefixes(items: DataFrame, params: LshParams, key: str = "id", vec: str = "vec") -> DataFrame:
    """(id, tbl, bits): a string of the low bits of the projections, the path of an item in each tree of a forest."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            bits = (np.floor(params.values(matrix(b.column(1)))).astype(np.int64) & 1) if b.num_rows else np.zeros((0, *params.b.shape), np.int64)
            n, tables, _ = bits.shape
            text = ["".join(map(str, r)) for r in bits.reshape(n * tables, -1).tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(b.column(0).to_numpy(), tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(text, pa.string())], names=["id", "tbl", "bits"]
            )

    rows = items.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return rows.mapInArrow(batches, "id long, tbl int, bits string")


def prefix_counts(paths: DataFrame) -> DataFrame:
    """tbl, depth, prefix, n: how many items are below each node of the trees (depth 0 is the root)."""
    depths = F.explode(F.sequence(F.lit(0), F.length("bits"))).alias("depth")
    return paths.select("tbl", "bits", depths).groupBy("tbl", "depth", F.expr("substring(bits, 1, depth)").alias("prefix")).agg(F.count("*").alias("n"))


def forest_candidates(query_paths: DataFrame, paths: DataFrame, m: int) -> DataFrame:
    """(query_id, target_id): items below the deepest common depth at which a query's nodes in all trees hold m items together."""
    counts = prefix_counts(paths)
    q = query_paths.select(F.col("id").alias("query_id"), "tbl", "bits", F.explode(F.sequence(F.lit(0), F.length("bits"))).alias("depth"))
    q = q.withColumn("prefix", F.expr("substring(bits, 1, depth)"))
    at = q.join(counts, ["tbl", "depth", "prefix"], "left").groupBy("query_id", "depth").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    depth = at.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("n") >= m, F.col("depth"))), F.lit(0)).alias("depth"))
    nodes = q.join(depth, ["query_id", "depth"]).select("query_id", "tbl", "depth", "prefix")
    used = nodes.select("tbl", "depth").distinct()
    below = paths.join(used, "tbl").select("tbl", "depth", F.expr("substring(bits, 1, depth)").alias("prefix"), F.col("id").alias("target_id"))
    return nodes.join(below, ["tbl", "depth", "prefix"]).select("query_id", "target_id").distinct()
