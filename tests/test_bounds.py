"""Memory and tables of the searches do not grow with the number of queries, or with pairs of them and items."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.functions import measures
from affinis.operators import lsh_index, search
from affinis.sources import writers


def table(spark, n, seed=3, dim=8):
    x = np.random.Generator(np.random.PCG64(seed)).standard_normal((n, dim)).round(2)
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vec array<double>"), x


def test_a_product_is_bounded_whatever_the_block(monkeypatch):
    sizes, inner = [], search._rough
    monkeypatch.setattr(search, "_rough", lambda q, x, metric: sizes.append(len(q) * len(x)) or inner(q, x, metric))
    x = np.random.Generator(np.random.PCG64(1)).standard_normal((2048, 4))
    near = search._Nearest(np.arange(2048), x, 3, "l2", None, 1, True)
    near.add(np.arange(2048), x)
    assert max(sizes) <= 1 << 20 and sum(sizes) == 2048 * 2048
    assert all(len(b) == 3 for b in near.best)


def test_reference_bounds_are_those_of_the_table_of_distances(spark):
    x, _ = table(spark, 60)
    refs = x.where("id % 7 = 0")
    pairs = x.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    d = search.distances(refs, x).select(F.col("target_id").alias("id"), F.col("query_id").alias("ref"), (F.col("dist") / 4).alias("dist"))
    want = sorted(map(tuple, search.triangle_bounds(pairs, d).select("a", "b", "low", "high").collect()))
    got = sorted(map(tuple, search.reference_bounds(pairs, x, refs, 0.25).collect()))
    assert len(got) == 59 and got == want


def test_a_lookup_is_that_of_the_table_of_candidates(spark):
    """Also by an index of some of the items, by another seed's buckets."""
    x, _ = table(spark, 400)
    few, params = x.where("id % 9 = 0"), lsh_index.LshParams.random(8, 3, 4, 1.5, seed=2)
    for index in (lsh_index.build_index(x, params), lsh_index.build_index(x.where("id % 3 > 0"), params)):
        found = lsh_index.candidates(lsh_index.build_probes(few, params, 12), index)
        want = search.refine(found, few, x, measures.l2, 5)
        got = lsh_index.search(few, x, params, 5, 12, index)
        as_ = lambda df: sorted((r["query_id"], r["rank"], r["target_id"], round(r["dist"], 9)) for r in df.collect())
        assert as_(got) == as_(want)
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString() and "depth" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_what_is_kept_for_all_depths_is_the_k_best_up_to_each():
    rnd = np.random.Generator(np.random.PCG64(8))
    x, q = rnd.standard_normal((300, 4)).round(1), rnd.standard_normal((3, 4)).round(1)
    first = rnd.integers(0, 7, (3, 300)).astype(np.uint8)
    first[first == 6] = lsh_index.NEVER
    near = lsh_index._NearestUpto(np.arange(3), q, 4, 6)
    for lo in range(0, 300, 37):
        near.add(np.arange(300)[lo : lo + 37], x[lo : lo + 37], first[:, lo : lo + 37])
    for i in range(3):
        d = search._exact(q[i], x, "l2")
        dist, ids, depth = near.kept[i]
        assert len(ids) < 60
        for j in range(6):
            want = sorted((d[a], a) for a in range(300) if first[i, a] <= j)[:4]
            assert sorted((a, b) for a, b, c in zip(dist.tolist(), ids.tolist(), depth.tolist(), strict=True) if c <= j)[:4] == want


@pytest.mark.parametrize("block", [search.BLOCK_BYTES, 400])
def test_rows_of_a_matrix_whole_and_in_pieces(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK_BYTES", block)
    x, _ = table(spark, 50)
    few = x.where("id % 5 = 0")
    monkeypatch.setattr(search, "distances", None)
    got = {r[0]: r[1] for r in search.distance_rows(few, x).collect()}
    monkeypatch.undo()
    d = search.distances(few, x).select(F.col("query_id").alias("left_id"), F.col("target_id").alias("right_id"), "dist")
    assert got == {r[0]: r[1] for r in writers.dense_rows(d).collect()}


def test_text_of_rows_is_that_of_the_matrix(spark):
    x, _ = table(spark, 30)
    d = search.distances(x, x).select(F.col("query_id").alias("left_id"), F.col("target_id").alias("right_id"), "dist")
    assert sorted(map(tuple, writers.row_text(search.distance_rows(x, x)).collect())) == sorted(map(tuple, writers.matrix_text(d).collect()))
