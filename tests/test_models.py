"""Embedding, tuning, clustering, evaluation, streaming and the verbs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.functions import lsh
from affinis.operators import clustering, embedding, evaluation, lsh_index, search, sketches, tuning
from affinis.plans import api
from affinis.streaming import serving
from tests.test_chemistry import sdf


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


def test_scaling_and_solver_bring_distances_back(spark):
    x = np.random.default_rng(3).uniform(-0.2, 0.2, (40, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    c = embedding.classical_scaling(d[:15, :15], 3)
    assert np.allclose(np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)), d[:15, :15], atol=1e-8)
    rows = spark.createDataFrame([(i, d[i, :15].tolist()) for i in range(40)], "id long, dists array<double>")
    got = {r["id"]: r["vec"] for r in embedding.embed(rows, c).collect()}
    y = np.array([got[i] for i in range(40)])
    assert np.abs(np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)) - d).max() < 0.03
    assert embedding.classical_scaling(d[:4, :4], 6).shape == (4, 6)


def test_tuning_parts():
    assert tuning.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-9)
    rnd = np.random.default_rng(0).gamma(3.0, 2.0, 200_000)
    g = tuning.fit_gamma(rnd.mean(), float(np.exp(np.log(rnd).mean())))
    assert g.shape == pytest.approx(3.0, rel=0.03) and g.scale == pytest.approx(2.0, rel=0.03)
    r = [tuning.recall_at(d, 1.0, 4, 5, 8) for d in (0.05, 0.2, 0.8, 3.0)]
    assert all(a > b - 1e-4 for a, b in zip(r, r[1:])) and r[0] > 0.99
    assert tuning.recall_at(0.5, 1.0, 4, 5, 16) >= tuning.recall_at(0.5, 1.0, 4, 5, 4)
    assert tuning.tune([(0, 10), (0, 10)], lambda v: v[0] * v[1] >= 12) == [2, 6]
    assert tuning.tune([(0, 3)], lambda v: False) is None


def test_recall_model_meets_measurement(spark):
    """A pair at distance d shares a bucket as often as the model says (home buckets alone)."""
    rnd = np.random.default_rng(9)
    x = rnd.standard_normal((2000, 12))
    step = rnd.standard_normal((2000, 12))
    y = x + 0.5 * step / np.sqrt((step**2).sum(1, keepdims=True))
    p = lsh_index.LshParams.random(12, 3, 2, 1.0, seed=8)
    same = (np.floor(p.values(x)) == np.floor(p.values(y))).all(2).any(1).mean()
    assert same == pytest.approx(tuning.recall_at(0.5, 1.0, 2, 3, 1), abs=0.1)


def test_fit_and_tune(spark):
    x = frame(spark, np.random.default_rng(1).standard_normal((400, 6)))
    model = tuning.fit_data(x, search.pair_distances(spark.createDataFrame([(i, (i * 7 + 1) % 400) for i in range(400)], "a long, b long"), x, lambda a, b: lsh_l2(a, b)), k=5, folds=3, n_queries=10)
    w, m, recall, cost = tuning.tune_index(model, 400, 5, 6, 8, 0.6, steps=12, most=4)
    assert recall >= 0.6 and 0 < cost < 1 and 0 < w < 10 and 1 <= m <= 4


def lsh_l2(a, b):
    from affinis.functions.measures import l2

    return l2(a, b)


def test_recall_curve_by_hand(spark):
    rank = lambda ids: spark.createDataFrame([(0, x, i + 1) for i, x in enumerate(ids)], "query_id long, target_id long, rank int")
    got = {(r["ratio"], r["k"]): r["recall"] for r in evaluation.recall_curve(rank([1, 2, 3, 4]), rank([2, 1, 9, 3]), (1, 2), 4).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 1.0, (1, 3): pytest.approx(2 / 3), (1, 4): 0.75, (2, 1): 1.0, (2, 2): 1.0}
    assert evaluation.compare_search(rank([1, 2, 3, 4]), rank([2, 1, 9, 3]), 3).first()["recall"] == pytest.approx(2 / 3)


def test_statistics_of_one_row(spark):
    assert evaluation.statistics(spark.range(1), "id").first()["deviation"] == 0


def test_clusters(spark):
    x = np.concatenate([np.random.default_rng(i).normal(5 * i, 0.1, (10, 2)) for i in range(3)])
    lists = clustering.neighbour_lists(search.knn(frame(spark, x), frame(spark, x), 10))
    got = clustering.jarvis_patrick(lists, 5).cache()
    assert sorted((r["cluster_id"], r["n"]) for r in clustering.cluster_sizes(got).collect()) == [(0, 10), (10, 10), (20, 10)]
    same = got.select("id", (F.col("id") / 10).cast("int").alias("cluster_id"))
    assert tuple(clustering.agreement(got, same).first()) == (1.0, 1.0, 1.0)
    chain = clustering.connected(spark.range(50), spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert chain.where("cluster_id = 0").count() == 41 and chain.select("cluster_id").distinct().count() == 10
    with pytest.raises(NotImplementedError):
        clustering.jarvis_patrick(lists, 5, linkage="average")


def test_histogram(spark):
    planes = [[lsh.Threshold(0, 0.0), lsh.Threshold(1, 0.0)], [lsh.Threshold(0, 5.0)]]
    rows = spark.createDataFrame([("s", 2.0, [1.0, -1.0]), ("s", 0.5, [9.0, 1.0])], "set_id string, weight double, vec array<double>")
    got = sketches.densify(sketches.histogram(rows, planes), 4).first()["vec"]
    assert got == [2.0, 3.0, 2.0, 0.5]
    unit = sketches.densify(sketches.histogram(rows, planes, unit=True), 4).first()["vec"]
    assert sum(v * v for v in unit) == pytest.approx(1)


def test_streams(spark, tmp_path):
    x = np.random.default_rng(2).standard_normal((60, 4))
    p = lsh_index.LshParams.random(4, 3, 2, 2.0, seed=1)
    items = frame(spark, x)
    items.where("id < 40").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(items.schema).parquet(f"{tmp_path}/in")
    run = lambda: serving.add_to_index(stream(), p, f"{tmp_path}/index", f"{tmp_path}/items", f"{tmp_path}/state").awaitTermination()
    run()
    items.where("id >= 40").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert spark.read.parquet(f"{tmp_path}/index").count() == 180 and spark.read.parquet(f"{tmp_path}/items").count() == 60
    serving.answer(stream().where("id < 5"), items, lsh_index.build_index(items, p), p, 3, 8, f"{tmp_path}/answers", f"{tmp_path}/state2").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/answers")
    assert {r["target_id"] for r in got.where("rank = 1").collect()} == set(range(5))
    near = serving.compare_to_references(stream().where("id < 5"), items.limit(3))
    q = near.writeStream.format("memory").queryName("near").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("near").count() == 15


@pytest.fixture(scope="module")
def database(spark):
    rnd = np.random.default_rng(4)
    rows = []
    for i in range(60):
        n = int(rnd.integers(4, 10))
        atoms = rnd.choice(list("CCCNOS"), n).tolist()
        rows.append((i + 1, sdf(f"m{i + 1}", atoms, [(int(rnd.integers(1, j)), j, int(rnd.integers(1, 3))) for j in range(2, n + 1)])))
    rows.append((1000, "broken"))
    inputs = spark.createDataFrame(rows, "compound_id long, sdf string")
    c = api.Config(n_references=20, dim=10, width=1.0, projections=3, tables=8, probes=16)
    return inputs, api.build_embedding(api.init_db(inputs.where("compound_id <= 50 OR compound_id = 1000"), "sdf", c))


def test_build(database):
    _, db = database
    assert db.compounds.count() == 50 and len(db.references) == 20 and db.coordinates.shape == (20, 10)
    assert db.vectors.count() == 50 and db.index.count() == 50 * 8


@pytest.mark.parametrize("refs", ["list", "table"])
def test_given_references(spark, database, refs):
    _, db = database
    ids = [3, 5, 8, 9, 20, 21]
    made = api.build_embedding(db, ids if refs == "list" else spark.createDataFrame([(i,) for i in ids], "compound_id long"))
    assert made.references == ids
    with pytest.raises(ValueError):
        api.build_embedding(db, [3, 10_000])


def test_queries_find_themselves(spark, database):
    inputs, db = database
    for fmt, rows in (("sdf", inputs.where("compound_id IN (7, 9)")), ("compound_id", spark.createDataFrame([(7,), (9,)], "compound_id long")), ("name", spark.createDataFrame([("m7",), ("m9",)], "name string"))):
        got = api.query(db, rows, fmt, 5).where("rank = 1").collect()
        assert all(r["distance"] == 0 for r in got) and len(got) == 2, fmt
    assert api.query(db, inputs.where("compound_id = 7"), "sdf", 5).agg(F.max("distance")).first()[0] <= 1
    with pytest.raises(ValueError):
        api.query(db, spark.createDataFrame([("nobody",)], "name string"), "name", 5).count()


def test_add_evaluate_cluster(database):
    inputs, db = database
    new = inputs.where("compound_id > 50 AND compound_id < 1000")
    more = api.add(db, new, "sdf")
    got = api.query(more, new, "sdf", 3).where("rank = 1").collect()
    assert len(got) == 10 and all(r["distance"] == 0 for r in got)
    curve, indexed = api.evaluate(db, 10, 5)
    assert indexed.count() == 10 and indexed.agg(F.avg("recall")).first()[0] > 0.3
    assert curve.where("ratio = 1 AND k = 50").first()["recall"] == pytest.approx(1.0)
    clusters = api.cluster(db, 5, 2)
    assert clusters.count() == 50 and api.cluster(db, 5, 2, matrix_only=True).count() == 50


def test_transforms_are_checked():
    with pytest.raises(ValueError):
        api.add_transform("new", None, None)
    with pytest.raises(ValueError):
        api.get_transform("new", "sdf")
    api.add_transform("new", None, None, lambda c: c, lambda c: c)
    api.add_transform("new", "SDF", lambda df: df)
    assert api.get_transform("NEW", "sdf").make is not None and math.pi > 3
