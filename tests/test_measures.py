import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.functions import lsh, measures


@pytest.fixture(scope="module")
def pairs(spark):
    rnd = np.random.default_rng(1)
    a, b = rnd.standard_normal((20, 7)), rnd.standard_normal((20, 7))
    return a, b, spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b)], "a array<double>, b array<double>")


def test_vector_distances(pairs):
    a, b, df = pairs
    want = {
        "l1": np.abs(a - b).sum(1),
        "l2": np.sqrt(((a - b) ** 2).sum(1)),
        "l2_squared": ((a - b) ** 2).sum(1),
        "chebyshev": np.abs(a - b).max(1),
        "cosine": 1 - (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1)),
        "negative_dot": -(a * b).sum(1),
    }
    for name, f in measures.VECTOR_DISTANCES.items():
        assert np.allclose([r[0] for r in df.select(f("a", "b")).collect()], want[name]), name


def test_bits(spark):
    df = spark.createDataFrame([([5, 0], [4, 3], [1, 0, 1], [1, 1, 0], [0.5, 2.0, 4.0])], "a array<long>, b array<long>, x array<int>, y array<int>, w array<double>")
    r = df.select(measures.hamming("a", "b"), measures.weighted_hamming("x", "y", "w"), measures.fingerprint_tanimoto("a", "b"), measures.set_jaccard("a", "b"), measures.hamming_words(F.lit(6), F.lit(3))).first()
    assert tuple(r) == (3, 6.0, 0.25, 0.0, 2)


def test_registry(spark):
    measures.set_default_distance("Mine", lambda a, b: measures.l1(a, b) * 2)
    df = spark.createDataFrame([([1.0], [3.0])], "a array<double>, b array<double>")
    assert df.select(measures.default_distance("mine")("a", "b")).first()[0] == 4.0
    with pytest.raises(ValueError):
        measures.default_distance("unknown")
    assert df.select(measures.common_substructure_distance(F.lit(2), F.lit(4), F.lit(3))).first()[0] == pytest.approx(0.6)


def test_families(spark):
    rnd = np.random.default_rng(2)
    x = rnd.standard_normal((30, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").orderBy("id")
    value = lambda f: np.array([r[0] for r in df.select(f.hash(F.col("vec"))).collect()])
    p = [lsh.PStable.random(5, 0.7, rnd) for _ in range(3)]
    h = [np.floor((x @ np.array(f.a) + f.b) / f.w).astype(int) for f in p]
    assert (value(p[0]) == h[0]).all()
    r = lsh.RepeatHash.random(p, rnd)
    assert value(r).tolist() == [sum((int(v) % 2**32) * a for v, a in zip(row, r.a)) % 2**32 for row in zip(*h)]
    assert (value(lsh.Tail(r, 97)) == value(r) % 97).all() and (value(lsh.LowBit(p[1])) == h[1] % 2).all()
    assert (value(lsh.Xor((lsh.LowBit(p[0]), lsh.LowBit(p[1])))) == (h[0] % 2) ^ (h[1] % 2)).all()
    planes = tuple(lsh.Hyperplane.random(5, rnd) for _ in range(3))
    signs = [(x @ np.array(f.a) >= 0).astype(int) for f in planes]
    assert (value(lsh.Repeat(planes)) == signs[0] * 4 + signs[1] * 2 + signs[2]).all()
    q = lsh.fit_quantiser(x, 4)
    assert (value(q) == ((x[:, None] - np.array(q.centroids)[None]) ** 2).sum(2).argmin(1)).all()
    s = lsh.fit_spectral(x, 6)
    assert s.range == 64 and 0 <= value(s).min() and value(s).max() < 64 and len(set(value(s).tolist())) > 4
    with pytest.raises(ValueError):
        lsh.Repeat((p[0],))
    d = np.array([r[0] for r in df.select(lsh.LowBit(p[0]).delta(F.col("vec"))).collect()])
    assert (d >= 0).all() and (d <= 0.5).all()
