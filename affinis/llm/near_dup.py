"""Near-duplicate texts: ProbMinHash signatures of word shingles, banding, exact verification, classes.

ProbMinHash: each shingle is a Poisson process whose rate is its weight; every arrival falls on a random component, and
a component keeps the shingle that arrives there first. Arrivals are made in order of time, and no more of them once
every component has one earlier. Two signatures agree at a component with the probability Jaccard similarity.

Texts that agree on a band meet in a bucket. Buckets are never turned into pairs: their smallest id ties them into
coarse components, within which every link is found or made needless exactly (see _verified).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ._common import discard, give_back, materialise, parts_of, settled, small_batches, told
from ._words import mix64, shingles, words

SHINGLE, SIMILARITY = 5, 0.8
#: 36 bands of 7: a pair of Jaccard similarity 0.8 meets with probability 0.9998, of 0.5 with 0.25, of 0.3 with 0.01.
BANDS, ROWS = 36, 7
#: Texts, and bytes of shingles, that are compared in one task at a time.
CHUNK_TEXTS, CHUNK_BYTES = 256, 4 << 20
HUBS = 16
#: Cells that shingles are counted in, to tell the rare from the common.
CELL_BITS = 18


def signatures(h: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, k: int, block: int) -> np.ndarray:
    """n x k: the shingle that arrives first at each component. h: distinct shingles of each owner (0 to n - 1)."""
    total = np.bincount(owner, weight, n)
    first, kept = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    last, window = np.full(n, np.inf), k * (np.log(k) + 2.0) / total
    time, made = np.zeros(len(h)), np.zeros(len(h), np.uint64)
    live = np.arange(len(h))
    while True:
        if not len(live):
            short = window < last  # an arrival behind the window can still be the first somewhere
            if not short.any():
                return kept.reshape(n, k)
            window[short] *= 2
            live = np.flatnonzero(time < np.minimum(last, window)[owner])
            continue
        j = made[live, None] + np.arange(1, block + 1, dtype=np.uint64)
        r = mix64(h[live, None] + j * np.uint64(0x9E3779B97F4A7C15))
        u = ((r >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40
        step = -np.log(u) / weight[live, None]
        step[:, 0] += time[live]
        at = np.cumsum(step, 1)
        time[live] = at[:, -1]
        made[live] += np.uint64(block)
        cell = owner[live, None] * k + ((r & np.uint64(0xFFFFFF)) % np.uint64(k)).astype(np.int64)
        near = at < first[cell]
        at, cell, who = at[near], cell[near], np.broadcast_to(live[:, None], near.shape)[near]
        np.minimum.at(first, cell, at)
        won = at == first[cell]
        kept[cell[won]] = h[who[won]]
        last = first.reshape(n, k).max(1)
        live = live[time[live] < np.minimum(last, window)[owner[live]]]


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands keys, different for different bands."""
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    for j in range(rows):
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + sig[:, j : bands * rows : rows])
    return key.view(np.int64)


def sketch(docs: DataFrame, key: str, text: str, bands: int, rows: int, size: int, tf: bool) -> DataFrame:
    """id, text_key (of equal texts; null for null), bands, n and shingles (sorted 32-bit hashes), in the partitions that docs has."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for w in words(b.column(1)):
                n = len(w.first) - 1
                h, owner = shingles(w, size)
                o = np.lexsort((h, owner))
                h, owner = h[o], owner[o]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(h)))
                h, owner = h[at], owner[at]
                weight = 1.0 + np.log(times) if tf else np.ones(len(h))
                per, sig = np.bincount(owner, minlength=n), np.zeros((n, bands * rows), np.uint64)
                for few in (True, False):
                    who = np.flatnonzero((per > 0) & ((per < 48) == few))
                    if len(who):
                        place = np.full(n, -1)
                        place[who] = np.arange(len(who))
                        ours = place[owner] >= 0
                        sig[who] = signatures(h[ours], weight[ours], place[owner[ours]], len(who), bands * rows, 64 if few else 2)
                keys, cut = band_keys(sig, bands, rows), np.concatenate([[0], np.cumsum(per)])
                small = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                ids, texts = b.column(0).slice(w.lo, n), b.column(1).slice(w.lo, n).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([None if x is None else hashlib.blake2b(x.encode(), digest_size=16).digest() for x in texts], pa.binary()),
                        pa.array([keys[i] if per[i] else [] for i in range(n)], pa.list_(pa.int64())),
                        pa.array(per, pa.int32()),
                        pa.array([np.unique(small[cut[i] : cut[i + 1]]).tobytes() for i in range(n)], pa.binary()),
                    ],
                    names=["id", "text_key", "bands", "n", "shingles"],
                )
            del b
        give_back()

    rows_of = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows_of.mapInArrow(batches, "id long, text_key binary, bands array<long>, n int, shingles binary")


def link(ids: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs that tie together what links (Jaccard similarity of at least ``similarity``) connect, and are links themselves."""
    n = len(ids)
    owner, size = np.repeat(np.arange(n), [len(s) for s in sets]), np.array([len(s) for s in sets])
    value = np.unique(np.concatenate(sets), return_inverse=True)[1]
    cut = np.concatenate([[0], np.cumsum(size)])
    mark, free, pairs = np.zeros(int(value.max(initial=-1)) + 1, bool), np.ones(n, bool), []
    for root in range(n):
        if not free[root]:
            continue
        free[root], todo = False, [root]
        while todo:
            x = todo.pop()
            if not free.any():
                return pairs
            mine = value[cut[x] : cut[x + 1]]
            mark[mine] = True
            shared = np.bincount(owner[mark[value]], minlength=n)
            mark[mine] = False
            near = np.flatnonzero(free & (shared > 0) & (shared >= similarity * (size + size[x] - shared) - 1e-9))
            free[near] = False
            todo += near.tolist()
            pairs += [(ids[x], ids[y]) for y in near.tolist()]
            keep = free[owner]  # those that are tied need not be compared again
            if len(near) > 8 and keep.sum() < 0.7 * len(owner):
                stay = keep | np.isin(owner, todo)
                owner, value = owner[stay], value[stay]
                cut = np.searchsorted(owner, np.arange(n + 1))
    return pairs


def _linked(groups: DataFrame, similarity: float) -> DataFrame:
    """groups(g1, g2, g3, id, shingles): links that tie together the rows of each (g1, g2, g3), which has a bounded size."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets, out = None, [], [], []

        def close() -> None:
            if len(ids) > 1:
                out.extend(link(ids, sets, similarity))

        for b in it:
            c = [b.column(i).to_pylist() for i in range(4)]
            for i, g in enumerate(zip(*c[:3], strict=True)):
                if g != at:
                    close()
                    at, ids, sets = g, [], []
                ids.append(c[3][i])
                sets.append(np.frombuffer(b.column(4)[i].as_py(), np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], names=["a", "b"])
            out = []
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], names=["a", "b"])

    dealt = groups.select("g1", "g2", "g3", "id", "shingles").repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3", "id")
    return dealt.mapInArrow(batches, "a long, b long")


def _blocks(texts: Column, shingles: Column) -> Column:
    """How many blocks of bounded size so many texts with so many shingles in all make."""
    return F.greatest(F.ceil(texts / CHUNK_TEXTS), F.ceil(4 * shingles / CHUNK_BYTES)).cast("int")


def _each(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _rare(rows: DataFrame, similarity: float) -> DataFrame:
    """rows(component, id, part, n, shingles) -> (component, id, part, n, token): the rarest shingles of each row.

    Two sets of similarity s, both in one order, share one of the first n - ceil(s * n) + 1 of each. The order is by
    counts over all rows in a fixed number of cells, so that what many texts hold (boilerplate) comes last.
    """

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for b in it:
            every = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32)
            total += np.bincount(every >> np.uint32(32 - CELL_BITS), minlength=1 << CELL_BITS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["cell", "n"])

    cells = rows.select("shingles").mapInArrow(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    common = np.zeros(1 << CELL_BITS, np.int64)  # one number for each cell, whatever the number of texts
    common[cells["cell"].to_numpy()] = cells["n"].to_numpy()

    def rarest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            taken = []
            for x in b.column(4):
                s = np.frombuffer(x.as_py(), np.uint32)
                order = np.lexsort((s, common[s >> np.uint32(32 - CELL_BITS)]))
                taken.append(s[order[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1]])
            again = pa.array(np.repeat(np.arange(b.num_rows), [len(t) for t in taken]))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(again) for i in range(4)), pa.array(np.concatenate(taken).astype(np.int64))], names=["component", "id", "part", "n", "token"])

    return rows.select("component", "id", "part", "n", "shingles").mapInArrow(rarest, "component long, id long, part long, n int, token long")


def _merged(met: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """met(component, id, part, n, token, texts, total) and groups(component, token, low, parts), with fewer groups where these compare pairs again and again.

    Texts made from one base share many rare shingles, and a pair of them would meet for each. Groups that have a part in
    common hang together in a cluster; where the comparisons of its groups add up to more than all its texts with each
    other would take, the cluster becomes one group (of the token -1, named by its smallest part), which holds all pairs of its groups.
    """
    arcs = met.join(groups.select("component", "token", "low").hint("merge"), ["component", "token"]).where("part <> low")
    tied = materialise(components(arcs.select(F.col("part").alias("a"), F.col("low").alias("b")).distinct()).toDF("part", "cluster"), "tied")
    size = lambda by: met.groupBy(*by, "part").agg(F.count_distinct("id").alias("c"))
    each = size(["component", "token"]).join(tied.hint("merge"), "part").groupBy("cluster", "component", "token").agg(F.sum("c").alias("t"), F.max("c").alias("m"))
    apart = each.groupBy("cluster").agg(F.sum(F.expr("double(t) * (t - m)")).alias("apart"))
    once = size([]).join(tied.hint("merge"), "part").groupBy("cluster").agg(F.sum("c").alias("t"), F.max("c").alias("m"))
    one = materialise(apart.join(once.hint("merge"), "cluster").where("double(t) * (t - m) < apart").select("cluster"), "one-group")
    if one.isEmpty():
        return met, groups
    # one is a table, so the parts of a large cluster are not gathered where it has been summed up
    few = met.groupBy("part").agg(parts_of("id")).join(tied.join(one.hint("merge"), "cluster").hint("merge"), "part", "left")
    named = materialise(told(met, few, ["part"], "id"), "met-clusters")
    rows = named.where("cluster IS NOT NULL").select(F.col("cluster").alias("component"), "id", "part", "n", F.lit(-1).cast("long").alias("token")).distinct()
    whole = rows.groupBy("component", "token").agg(F.count("*").alias("texts"), F.sum("n").alias("total"), F.min("part").alias("low"), parts_of("id"))
    rows = told(rows, whole.drop("low"), ["component", "token"], "id")
    rest = named.where("cluster IS NULL").drop("cluster")
    kept = groups.join(rest.select("component", "token").distinct().hint("merge"), ["component", "token"], "left_semi")
    return materialise(rest.unionByName(rows), "met-merged"), materialise(kept.unionByName(whole.select(groups.columns)), "groups-merged")


def _verified(coarse: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(id, component): connected components of the links among the texts of each coarse component.

    A coarse component is cut into chunks of bounded size and each chunk's links are found exactly. Of a component of
    several chunks, some texts (hubs) go to every chunk, which ties most copies into parts; then texts of different
    parts meet in groups that share one of their rarest shingles, as any two that are linked do (see _rare). So each
    pair of texts has been compared, is in one part anyhow, or can't be linked. Groups that share most of their texts
    become one (see _merged). Groups are cut into blocks in the same way: each text outside a group's largest part goes to all of its chunks, none of that part meets another of it.
    """
    # what a component is told by goes to its texts without their shingles: its rows may be most of all
    members = materialise(sketches.select("id", "n").join(coarse.hint("merge"), "id"), "members")
    sizes = members.groupBy("component").agg(F.count("*").alias("texts"), F.sum("n").alias("total"), parts_of("id"))
    sizes = sizes.select("component", "texts", _blocks(F.col("texts"), F.col("total")).alias("chunks"), "parts")
    placed = materialise(told(members.select("id", "component").distinct(), sizes, ["component"], "id"), "placed")
    rows = materialise(sketches.select("id", "n", "shingles").join(placed.hint("merge"), "id"), "placed-shingles")
    discard(members, placed)
    chunk = F.pmod(F.xxhash64("id", F.lit(17)), F.col("chunks")).cast("int")
    columns = ["g1", "g2", "g3", "id", "shingles"]
    one = rows.select(F.col("component").alias("g1"), chunk.alias("g2"), F.lit(0).alias("g3"), "id", "shingles")
    large = rows.where("chunks > 1")
    if large.isEmpty():
        return components(_linked(one, similarity))
    hubs = large.where(F.pmod(F.xxhash64("id", F.lit(23)), F.col("texts")) < HUBS)
    spread = hubs.select(F.col("component").alias("g1"), _each("chunks").alias("g2"), F.lit(0).alias("g3"), "id", "shingles")
    # a hub is in its own chunk twice, which changes no component
    links = materialise(_linked(one.unionByName(spread), similarity), "links")
    parts = materialise(components(links), "parts")
    left = large.select("component", "id", "n", "shingles").join(parts.withColumnRenamed("component", "part").hint("merge"), "id", "left")
    left = materialise(left.withColumn("part", F.coalesce("part", "id")), "parts-of")
    tokens = materialise(_rare(left, similarity), "rare")
    by_token = tokens.groupBy("component", "token").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("texts"), F.sum("n").alias("total"), F.sum(F.xxhash64("id", F.lit(37)).cast("decimal(20,0)")).alias("who"), parts_of("id")
    )
    # tokens of the same texts make one group
    groups = by_token.where("low < high").groupBy("component", "texts", "total", "who").agg(F.min(F.struct("token", "low", "parts")).alias("first"))
    groups = materialise(groups.select("component", "first.token", "first.low", "texts", "total", "first.parts"), "groups")
    if groups.isEmpty():
        return parts
    met = materialise(told(tokens, groups, ["component", "token"], "id").drop("low"), "met")
    met, groups = _merged(met, groups.select("component", "token", "low", "parts"))
    sums = met.groupBy("component", "token", "part").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.first("texts").alias("texts"), F.first("total").alias("total"))
    main = sums.groupBy("component", "token").agg(F.max(F.struct("c", "part", "s")).alias("main"), F.first("texts").alias("texts"), F.first("total").alias("total"))
    main = main.select(
        "component", "token", F.col("main.part").alias("main"), _blocks(F.col("texts"), F.col("total")).alias("chunks"),
        _blocks(F.col("texts") - F.col("main.c"), F.col("total") - F.col("main.s")).alias("blocks"),
    )
    main = main.join(groups.select("component", "token", "parts").hint("merge"), ["component", "token"])
    dealt = told(met.select("component", "token", "id", "part"), main, ["component", "token"], "id")
    dealt = materialise(dealt.select("id", F.xxhash64("component", "token").alias("g1"), "chunks", "blocks", (F.col("part") != F.col("main")).alias("rest")), "dealt")
    discard(tokens, groups, met)
    again = dealt.join(left.select("id", "shingles").hint("merge"), "id")
    ours = again.select("g1", chunk.alias("g2"), _each("blocks").alias("g3"), "id", "shingles")
    block = F.pmod(F.xxhash64("id", F.lit(31)), F.col("blocks")).cast("int")
    theirs = again.where("rest AND chunks * blocks > 1").select("g1", _each("chunks").alias("g2"), block.alias("g3"), "id", "shingles")
    out = components(links.unionByName(_linked(ours.unionByName(theirs).select(columns), similarity)))
    discard(links, parts, left, dealt, rows)
    return out


def classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, tf: bool = False
) -> DataFrame:
    """One row per row of docs: key, class_id, kept.

    Two texts are linked if they are equal, or if the sets of their shingles (runs of ``shingle`` words; a text with
    fewer words is one shingle) have a Jaccard similarity of ``similarity`` or more; a class is what links connect,
    class_id its smallest key, kept whether the row has that key. Signatures weigh all shingles alike, as the link rule
    does; with tf by one plus the logarithm of how often one occurs, which loses links of texts that repeat a passage
    unequally often. Shingles are compared by hashes of 32 bits. Texts without a word are
    linked to equal ones alone; a null text is a class of its own. Rows that repeat a key are one document. Rows with a
    null key have the class of texts equal to theirs, null if there are none. key must be an integer; only key and text are read.
    """
    small_batches(docs.sparkSession)
    # the joins of what grows with the texts are sort-merge joins at every size, never broadcasts
    made = materialise(sketch(docs, key, text, bands, rows, shingle, tf), "sketches")
    equal = made.where("text_key IS NOT NULL").groupBy("text_key").agg(F.min("id").alias("rep"), parts_of("id"))
    equal = materialise(equal, "equal-texts")
    some = made.where("size(bands) > 0")
    reps = some.join(equal.select(F.col("rep").alias("id")).distinct().hint("merge"), "id", "left_semi")

    def found() -> DataFrame:
        buckets = reps.select("id", F.explode("bands").alias("bucket"))
        hubs = buckets.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("other"), parts_of("id")).where("hub < other").drop("other")
        coarse = components(told(buckets, hubs, ["bucket"], "id").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")))
        return _verified(coarse, some, similarity).select(F.col("id").alias("rep"), "component")

    def whole() -> DataFrame:
        named = equal.join(settled(found, "found").hint("merge"), "rep", "left")
        out = told(made.select("id", "text_key"), named, ["text_key"], "id", "left")
        return out.select(F.col("id").alias(key), F.coalesce("component", "rep", "id").alias("class_id"))

    out = settled(whole, "classes")
    discard(made, equal)
    return out.withColumn("kept", F.coalesce(F.col("class_id") == F.col(key), F.lit(True)))
