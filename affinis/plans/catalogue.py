"""Queries over the driver's tables, one or more for each operator, with equivalent SQL.

Query sets of searches are the rows whose id is divisible by 20, against all rows. Floating results are rounded to six
decimals after all ordering.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chemistry, lsh, measures
from ..operators import clustering, embedding, evaluation, lsh_index, search, sets, sketches, tuning
from ..streaming import serving
from .lineage import fresh, materialise

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def asked(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id") % 20 == 0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
Q = "q AS (SELECT id AS query_id, v AS w FROM v WHERE id % 20 = 0)"
_EACH = "list_transform(range(1, len(v) + 1), lambda i: {})"
DISTANCE = {
    "l2": "list_distance(w, v)",
    "l1": f"list_sum({_EACH.format('abs(w[i] - v[i])')})",
    "chebyshev": f"list_max({_EACH.format('abs(w[i] - v[i])')})",
    "cosine": "1 - list_cosine_similarity(w, v)",
    "negative_dot": "-list_inner_product(w, v)",
}


def _ranked(metric: str = "l2", where: str = "true", order: str = "dist, target_id", k: int = 10, source: str = "q, v") -> str:
    return f"""WITH {V}, {Q}, d AS (SELECT query_id, id AS target_id, {DISTANCE[metric]} AS dist FROM {source} WHERE {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order})::INTEGER AS rank FROM d)
    SELECT query_id, target_id, round(dist, 6) AS dist, rank FROM r WHERE rank <= {k}"""


# ---- exact search


@register(_ranked())
def knn_l2_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return rounded(search.knn(asked(x), x, 10), "dist")


for _metric in ("l1", "cosine", "chebyshev", "negative_dot"):

    def _knn(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        x = vectors(spark, sf_dir)
        return rounded(search.knn(asked(x), x, 10, metric), "dist")

    register(_ranked(_metric), f"knn_{_metric}")(_knn)


@register(_ranked(order="dist DESC, target_id"))
def knn_farthest(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return rounded(search.knn(asked(x), x, 10, farthest=True), "dist")


@register(f"WITH {V}, {Q} SELECT query_id, id AS target_id, round(list_distance(w, v), 6) AS dist FROM q, v WHERE list_distance(w, v) < 1.2 AND id <> query_id")
def radius_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return rounded(search.within(asked(x), x, 1.2, exclude_self=True), "dist")


@register(_ranked(where="id <> query_id AND list_distance(w, v) < 1.3", k=5))
def knn_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return rounded(search.knn(asked(x), x, 5, radius=1.3, exclude_self=True), "dist")


_ALL = _ranked(where="id <> query_id", k=5).replace("WHERE id % 20 = 0", "")


@register(_ALL)
def self_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return rounded(search.knn(x, x, 5, exclude_self=True), "dist")


@register(_ranked(source="q JOIN v l ON l.id = query_id JOIN v ON v.label = l.label", metric="l2").replace("list_distance(w, v)", "list_distance(w, v.v)").replace("query_id, id AS", "query_id, v.id AS"))
def limited_knn_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates: rows with the query's label."""
    x = vectors(spark, sf_dir)
    found = asked(x).select(F.col("id").alias("query_id"), "label").join(x.select(F.col("id").alias("target_id"), "label"), "label")
    return rounded(search.refine(found, asked(x), x, measures.l2, 10), "dist")


@register(f"WITH {V}, {Q} SELECT query_id AS left_id, list(round(list_distance(w, v), 4) ORDER BY id)[1] AS first_dist, round(sum(list_distance(w, v)), 4) AS total FROM q, v GROUP BY query_id")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the matrix of the query set against all."""
    x = vectors(spark, sf_dir)
    total = F.aggregate("dists", F.lit(0.0), lambda s, v: s + v)
    return search.distance_rows(asked(x), x).select("left_id", F.round(F.col("dists")[0], 4).alias("first_dist"), F.round(total, 4).alias("total"))


#: A bounded sample, as many references whatever the size of the table.
N_REFS = 50
REFS = f"refs AS (SELECT id FROM v ORDER BY (id * 2654435761) % 4294967296, id LIMIT {N_REFS}), r AS (SELECT id AS ref, v AS w FROM v SEMI JOIN refs USING (id))"


def references(x: DataFrame) -> DataFrame:
    return sets.select_rows(x, sets.sample(x.select("id"), N_REFS))


@register(f"WITH {V}, {REFS} SELECT id, round(min(list_distance(w, v)), 6) AS nearest, round(max(list_distance(w, v)), 6) AS furthest, count(*) AS refs FROM v, r GROUP BY id")
def ref_distance_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    refs = references(x)
    d = search.distances(refs, x).select(F.col("target_id").alias("query_id"), F.col("query_id").alias("target_id"), "dist")
    wide = embedding.distances_to_references(d, [r[0] for r in refs.select("id").collect()])
    return wide.select("id", F.round(F.array_min("dists"), 6).alias("nearest"), F.round(F.array_max("dists"), 6).alias("furthest"), F.size("dists").cast("long").alias("refs"))


@register(f"WITH {V} SELECT a.id AS a, b.id AS b, round(1 - list_distance(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON b.id = a.id + 1")
def pair_list_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    pairs = x.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return search.pair_distances(pairs, x, measures.l2).select("a", "b", F.round(1 - F.col("dist"), 6).alias("similarity"))


@register(f"""WITH {V}, r AS (SELECT id AS ref, v AS w FROM v WHERE id % 20 = 0), d AS (SELECT id, ref, list_distance(w, v) / 2 AS dist FROM v, r)
SELECT x.id AS a, y.id AS b, round(greatest(0, max(abs(x.dist - y.dist))), 6) AS low, round(least(1, min(x.dist + y.dist)), 6) AS high FROM d x JOIN d y ON y.id = x.id + 1 AND y.ref = x.ref GROUP BY x.id, y.id""")
def triangle_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    pairs = x.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return rounded(search.reference_bounds(pairs, x, asked(x), 0.5), "low", "high")


@register(f"WITH {V} SELECT id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS length, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM v")
def normalise_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return x.select("id", F.round(measures.norm("vec"), 6).alias("length"), F.round(measures.normalise("vec")[0], 6).alias("first"))


# ---- multisets: the parts of an order

_B = """lines AS (SELECT l_orderkey AS id, l_partkey AS tok, count(*) AS c FROM lineitem GROUP BY ALL), n AS (SELECT id, sum(c) AS n FROM lines GROUP BY id),
s AS (SELECT a.id AS a, b.id AS b, sum(least(a.c, b.c)) AS shared FROM lines a JOIN lines b ON a.tok = b.tok {on} GROUP BY a.id, b.id),
t AS (SELECT a, b, shared, x.n AS n_a, y.n AS n_b, shared / (x.n + y.n - shared) AS similarity FROM s JOIN n x ON x.id = a JOIN n y ON y.id = b)"""


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("tok")).agg(F.count("*").alias("c"))


@register(f"WITH {_B.format(on='AND a.id < b.id')} SELECT a, b, shared::BIGINT AS shared, round(similarity, 6) AS similarity FROM t")
def tanimoto_multiset_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = baskets(spark, sf_dir)
    return rounded(search.overlaps(x, x, distinct_pairs=True).select("a", "b", "shared", "similarity"), "similarity")


_EVERY = f"""WITH {_B.format(on='AND a.id % 20 = 0')}, d AS (SELECT q.id AS query_id, i.id AS target_id, 1 - coalesce(similarity, 0) AS dist FROM n q JOIN n i ON q.id % 20 = 0 LEFT JOIN t ON t.a = q.id AND t.b = i.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist {{}}, target_id)::INTEGER AS rank FROM d WHERE query_id <> target_id) SELECT query_id, target_id, round(dist, 6) AS dist, rank FROM r WHERE rank <= 5"""


@register(_EVERY.format(""))
def tanimoto_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = baskets(spark, sf_dir)
    return rounded(search.tanimoto_knn(asked(x), x, 5, exclude_self=True), "dist")


@register(_EVERY.format("DESC"))
def tanimoto_farthest(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = baskets(spark, sf_dir)
    return rounded(search.tanimoto_knn(asked(x), x, 5, exclude_self=True, farthest=True), "dist")


@register(f"WITH {_B.format(on='AND a.id % 20 = 0 AND a.id <> b.id')} SELECT a AS query_id, b AS target_id, round(1 - similarity, 6) AS dist FROM t WHERE similarity > 1 - 0.75")
def tanimoto_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = baskets(spark, sf_dir)
    return rounded(search.tanimoto_within(asked(x), x, 0.75, exclude_self=True), "dist")


@register("""WITH b AS (SELECT l_orderkey AS id, list(DISTINCT l_partkey) AS s, list(l_partkey ORDER BY l_linenumber) AS m FROM lineitem GROUP BY ALL)
SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 6) AS jaccard FROM b x JOIN b y ON y.id = x.id + 1""")
def jaccard_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("s"))
    pairs = b.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return search.pair_distances(pairs, b, measures.set_jaccard, value="s").select("a", "b", F.round("dist", 6).alias("jaccard"))


@register("""WITH w AS (SELECT l_orderkey AS id, l_suppkey % 8 AS tok, count(*) AS c FROM lineitem GROUP BY ALL), n AS (SELECT id, sum(c) AS n FROM w GROUP BY id)
SELECT x.id AS a, y.id AS b, round(1 - coalesce(s, 0) / (x.n + y.n - coalesce(s, 0)), 6) AS dist FROM n x JOIN n y ON y.id = x.id + 1
LEFT JOIN (SELECT p.id AS i, sum(least(p.c, q.c)) AS s FROM w p JOIN w q ON q.id = p.id + 1 AND q.tok = p.tok GROUP BY p.id) ON i = x.id""")
def multiset_tanimoto_rowwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_suppkey") % 8).alias("m"))
    pairs = b.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return rounded(search.pair_distances(pairs, b, measures.default_distance("ap"), value="m"), "dist")


# ---- subsets, sets and samples


@register("WITH ids AS (SELECT l_partkey AS p_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS pos FROM lineitem) SELECT pos, p_partkey, p_name FROM ids JOIN part USING (p_partkey)")
def iddb_subset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.numbering import positions

    lines = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("at"), F.col("l_partkey").alias("p_partkey"))
    ids = positions(lines, "at").select("p_partkey", (F.col("pos") + 1).alias("pos"))
    return sets.subset(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ids, "p_partkey").select("pos", "p_partkey", "p_name")


@register(f"WITH {V} SELECT a.id AS left_id, b.id AS right_id, round(list_distance(a.v, b.v), 6) AS dist FROM v a, v b WHERE a.id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 0) AND b.id IN (SELECT s_suppkey FROM supplier)")
def iddb_cross_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between two subsets given by id lists."""
    x = vectors(spark, sf_dir)
    left = sets.select_rows(x, table(spark, sf_dir, "customer").where("c_nationkey = 0").select(F.col("c_custkey").alias("id")))
    right = sets.select_rows(x, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))
    return search.distances(left, right).select(F.col("query_id").alias("left_id"), F.col("target_id").alias("right_id"), F.round("dist", 6).alias("dist"))


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set_difference_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return sets.difference(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def select_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return sets.select_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


@register("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def db_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return sets.merge(c, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@register("SELECT vec_id AS id FROM embeddings ORDER BY (vec_id * 2654435761) % 4294967296, vec_id LIMIT 50")
def sample_refs_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.sample(vectors(spark, sf_dir).select("id"), 50)


@register("SELECT vec_id AS id, ntile(7) OVER (ORDER BY vec_id)::INTEGER AS part FROM embeddings")
def split_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.split_even(vectors(spark, sf_dir).select("id"), 7)


@register("SELECT o_orderkey AS id, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000)::BIGINT AS slice FROM orders")
def split_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.split_slices(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), 1000)


@register("SELECT query_id FROM (SELECT vec_id AS query_id FROM embeddings) WHERE query_id BETWEEN 100 AND 400 AND query_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def resume_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("query_id"))
    return sets.unfinished(vectors(spark, sf_dir).select(F.col("id").alias("query_id")), done, 100, 400)


@register("SELECT o.o_orderkey, c.c_name AS name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    return sets.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), names, "o_custkey").select("o_orderkey", "name")


# ---- aggregates


@register("SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high, round(coalesce(stddev_samp(value), 0), 6) AS deviation FROM events GROUP BY event_type")
def stat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.statistics(table(spark, sf_dir, "events"), "value", ["event_type"])
    return rounded(s.withColumn("total", F.round("total", 4)), "mean", "low", "high", "deviation")


@register("SELECT l_returnflag, round(avg(l_extendedprice), 4) AS arithmetic, round(exp(avg(ln(l_extendedprice))), 4) AS geometric FROM lineitem WHERE l_extendedprice > 0 GROUP BY l_returnflag")
def arith_geo_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    arithmetic, geometric = tuning.mean_columns("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(arithmetic, 4).alias("arithmetic"), F.round(geometric, 4).alias("geometric"))


@register("""WITH m AS (SELECT avg(l_extendedprice) AS y, avg(l_quantity) AS a, avg(l_discount) AS b, var_pop(l_quantity) AS aa, var_pop(l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab,
covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS by_, count(*) AS n FROM lineitem),
c AS (SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS ca, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS cb FROM m)
SELECT round(y - ca * a - cb * b, 3) AS intercept, round(ca, 3) AS quantity, round(cb, 3) AS discount, n FROM c""")
def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    at = tuning.least_squares(lines, "l_extendedprice", ["l_quantity", "l_discount"])
    return spark.createDataFrame([(*[round(x, 3) for x in at], lines.count())], "intercept double, quantity double, discount double, n long")


@register("SELECT l_orderkey AS id, l_partkey AS tok, count(*) AS c FROM lineitem GROUP BY ALL")
def descriptor_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("parts"))
    return search.token_counts(orders, "id", "parts")


# ---- hash families, with parameters as literals in both forms

_RND = np.random.Generator(np.random.PCG64(20240501))
DIM = 64
P = lsh_index.LshParams.random(DIM, 4, 4, 0.8, seed=7)
#: The index of the searches: a recall of 0.9 at the least share of items scanned of those tried (see README).
I = lsh_index.LshParams.random(DIM, 16, 10, 2.4, seed=7)  # noqa: E741
PLANES = [lsh.Hyperplane.random(DIM, _RND) for _ in range(8)]
THRESHOLDS = [lsh.Threshold.random(DIM, -0.1, 0.1, _RND) for _ in range(8)]
STABLE = [lsh.PStable(tuple(P.a[0, m].tolist()), float(P.b[0, m]), P.w) for m in range(4)]
CAUCHY = lsh.PStable.random(DIM, 4.0, _RND, "cauchy")
MIXED = lsh.RepeatHash(tuple(STABLE), tuple(int(x) for x in P.mix[0]))
QUANTISER = lsh.Quantiser(tuple(tuple(x) for x in (_RND.standard_normal((6, DIM)) / 8).tolist()))


def _list(a) -> str:
    return "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in a) + "]"


def _value(f: lsh.PStable) -> str:
    return f"(list_inner_product(v, {_list(f.a)}) + {f.b!r}::DOUBLE) / {f.w!r}::DOUBLE"


_HASHES = [f"floor({_value(f)})::BIGINT" for f in STABLE]
_MIX = "(" + " + ".join(f"((({h}) & 4294967295) * {a} & 4294967295)" for h, a in zip(_HASHES, MIXED.a, strict=True)) + ") & 4294967295"


@register(f"WITH {V} SELECT id, " + ", ".join(f"{h} AS h{i}" for i, h in enumerate(_HASHES)) + f", round({_value(STABLE[0])} - floor({_value(STABLE[0])}), 6) AS delta0, floor({_value(CAUCHY)})::BIGINT AS cauchy FROM v")
def lsh_gaussian_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec")
    hashes = {f"h{i}": f.hash(v) for i, f in enumerate(STABLE)}
    return vectors(spark, sf_dir).withColumns(hashes | {"delta0": F.round(STABLE[0].delta(v), 6), "cauchy": CAUCHY.hash(v)}).drop("vec", "label")


def _bits(signs: list[str]) -> str:
    return " + ".join(f"CASE WHEN {s} THEN {1 << i} ELSE 0 END" for i, s in enumerate(reversed(signs)))


@register(f"WITH {V} SELECT id, (" + _bits([f"list_inner_product(v, {_list(p.a)}) >= 0" for p in PLANES]) + ")::BIGINT AS bits FROM v")
def lsh_hyperplane_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", lsh.Repeat(tuple(PLANES)).hash(F.col("vec")).alias("bits"))


@register(f"WITH {V} SELECT id, (" + _bits([f"v[{p.dim + 1}] >= {p.at!r}::DOUBLE" for p in THRESHOLDS]) + ")::BIGINT AS bits FROM v")
def lsh_threshold_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", lsh.Repeat(tuple(THRESHOLDS)).hash(F.col("vec")).alias("bits"))


@register(f"WITH {V} SELECT id, ({_MIX})::BIGINT AS mixed, (({_MIX}) % 1017881)::BIGINT AS folded, 0::BIGINT AS trivial FROM v")
def lsh_repeat_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec")
    return vectors(spark, sf_dir).select("id", MIXED.hash(v).alias("mixed"), lsh.Tail(MIXED, 1017881).hash(v).alias("folded"), lsh.Trivial().hash(v).alias("trivial"))


_LOW = [f"((({h}) % 2 + 2) % 2)" for h in _HASHES]
_FRAC = [f"least({_value(f)} - floor({_value(f)}), 1 - ({_value(f)} - floor({_value(f)})))" for f in STABLE]


@register(f"WITH {V} SELECT id, ({_LOW[0]})::BIGINT AS low_bit, xor(xor({_LOW[0]}, {_LOW[1]}), xor({_LOW[2]}, {_LOW[3]}))::BIGINT AS folded, round(least({', '.join(_FRAC)}), 6) AS delta FROM v")
def lsh_lsb_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, bits = F.col("vec"), tuple(lsh.LowBit(f) for f in STABLE)
    return vectors(spark, sf_dir).select("id", bits[0].hash(v).alias("low_bit"), lsh.Xor(bits).hash(v).alias("folded"), F.round(lsh.Xor(bits).delta(v), 6).alias("delta"))


@register(f"WITH {V}, c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_list(c)})" for i, c in enumerate(QUANTISER.centroids)) + ") t(i, w)) SELECT id, arg_min(i, list_distance(v, w))::BIGINT AS cell FROM v, c GROUP BY id")
def lsh_quantiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", QUANTISER.hash(F.col("vec")).alias("cell"))


# ---- indexes

_T = 40


def _index_sql(p: lsh_index.LshParams) -> str:
    rows = ", ".join(f"({t}, {m}, {_list(p.a[t, m])}, {float(p.b[t, m])!r}::DOUBLE, {int(p.mix[t, m])})" for t in range(p.tables) for m in range(p.projections))
    return f"""{V}, a(t, m, a, b, x) AS (VALUES {rows}), p AS (SELECT id, t, m, x, (list_inner_product(v, a) + b) / {p.w!r}::DOUBLE AS y FROM v, a),
h AS (SELECT id, t, m, x, y, floor(y)::BIGINT AS h, CASE WHEN y - floor(y) <= 0.5 THEN -1 ELSE 1 END AS near,
  row_number() OVER (PARTITION BY id, t ORDER BY least(y - floor(y), 1 - (y - floor(y))), m) - 1 AS rank FROM p),
idx AS (SELECT id, t AS tbl, (sum(((h & 4294967295) * x) & 4294967295)::BIGINT & 4294967295) AS bucket FROM h GROUP BY id, t)"""


def _probes_sql(p: lsh_index.LshParams, probes: int) -> str:
    moves = ", ".join(f"({d}, {rank}, {-1 if away else 1})" for d, chosen in enumerate(lsh_index.probe_template(p.projections, probes)) for rank, away in chosen)
    return f"""{_index_sql(p)}, moves(depth, rank, s) AS (VALUES {moves}), depths AS (SELECT unnest(range({probes})) AS depth),
pr AS (SELECT h.id AS query_id, t AS tbl, depths.depth, (sum((((h + coalesce(s, 0) * near) & 4294967295) * x) & 4294967295)::BIGINT & 4294967295) AS bucket
  FROM h CROSS JOIN depths LEFT JOIN moves ON moves.depth = depths.depth AND moves.rank = h.rank WHERE h.id % 20 = 0 GROUP BY h.id, t, depths.depth),
cand AS (SELECT query_id, id AS target_id, min(depth) AS depth FROM pr JOIN idx USING (tbl, bucket) GROUP BY query_id, id)"""


_INDEX, _PROBES = _index_sql(P), _probes_sql(I, _T)


@register(f"WITH {_index_sql(I)} SELECT tbl::INTEGER AS tbl, bucket, id FROM idx")
def lsh_index_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_index.build_index(vectors(spark, sf_dir), I)


@register(f"WITH {_PROBES} SELECT query_id, target_id, depth::INTEGER AS depth FROM cand WHERE depth = 0")
def lsh_bucket_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat index: home buckets alone."""
    x = vectors(spark, sf_dir)
    return lsh_index.candidates(lsh_index.build_probes(asked(x), I, 1), lsh_index.build_index(x, I))


_TOP = f"""{_PROBES}, d AS (SELECT query_id, target_id, list_distance(x.v, y.v) AS dist FROM cand JOIN v x ON x.id = query_id JOIN v y ON y.id = target_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, target_id)::INTEGER AS rank FROM d), top AS (SELECT * FROM r WHERE rank <= 10)"""


@register(f"WITH {_TOP} SELECT query_id, target_id, round(dist, 6) AS dist, rank FROM top")
def lsh_multiprobe_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return rounded(lsh_index.search(asked(x), x, I, 10, _T), "dist")


@register(f"""WITH {_TOP}, t AS (SELECT x.id AS query_id, y.id AS target_id, row_number() OVER (PARTITION BY x.id ORDER BY list_distance(x.v, y.v), y.id) AS rank FROM v x, v y WHERE x.id % 20 = 0)
SELECT t.query_id, round(count(top.target_id) / 10, 6) AS recall, round((count(top.target_id) + 1) / 11, 6) AS recall_smoothed FROM t LEFT JOIN top ON top.query_id = t.query_id AND top.target_id = t.target_id WHERE t.rank <= 10 GROUP BY t.query_id""")
def lsh_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    got = evaluation.compare_search(search.knn(asked(x), x, 10), lsh_index.search(asked(x), x, I, 10, _T), 10)
    return rounded(got.withColumn("recall_smoothed", measures.smoothed_recall(F.col("recall") * 10, F.lit(10))), "recall", "recall_smoothed")


@register(f"WITH {_PROBES} SELECT query_id, count(*) AS scanned, round(count(*) / (SELECT count(*) FROM embeddings), 6) AS cost FROM cand GROUP BY query_id")
def lsh_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    found = lsh_index.candidates(lsh_index.build_probes(asked(x), I, _T), lsh_index.build_index(x, I))
    return rounded(lsh_index.cost(found, x.count()), "cost")


_BITS = f"{_INDEX}, b AS (SELECT id, t AS tbl, string_agg((((h % 2) + 2) % 2)::VARCHAR, '' ORDER BY m) AS bits FROM h GROUP BY id, t)"


@register(f"WITH {_BITS}, e AS (SELECT tbl, bits, unnest(range(5)) AS depth FROM b) SELECT tbl::INTEGER AS tbl, depth::INTEGER AS depth, left(bits, depth) AS prefix, count(*) AS n FROM e GROUP BY ALL")
def forest_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_index.prefix_counts(lsh_index.prefixes(vectors(spark, sf_dir), P))


@register(f"""WITH {_BITS}, e AS (SELECT id, tbl, bits, unnest(range(5)) AS depth FROM b), c AS (SELECT tbl, depth, left(bits, depth) AS prefix, count(*) AS n FROM e GROUP BY ALL),
s AS (SELECT e.id AS query_id, e.depth, sum(n) AS n FROM e JOIN c ON c.tbl = e.tbl AND c.depth = e.depth AND c.prefix = left(e.bits, e.depth) WHERE e.id % 20 = 0 GROUP BY ALL),
g AS (SELECT query_id, coalesce(max(depth) FILTER (n >= 200), 0) AS depth FROM s GROUP BY query_id)
SELECT DISTINCT query_id, y.id AS target_id FROM g JOIN b x ON x.id = query_id JOIN b y ON y.tbl = x.tbl AND left(y.bits, depth) = left(x.bits, depth)""")
def forest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return lsh_index.forest_candidates(lsh_index.prefixes(asked(x), P), lsh_index.prefixes(x, P), 200)


_SKETCH = f"""{_INDEX}, b AS (SELECT id, list((((h % 2) + 2) % 2) ORDER BY t, m) AS bits, list(least(y - h, 1 - (y - h)) ORDER BY t, m) AS deltas FROM h GROUP BY id),
c AS (SELECT q.id AS query_id, x.id AS target_id, {{}} AS gap FROM b q JOIN b x ON q.id % 20 = 0 AND x.id <> q.id),
few AS (SELECT query_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gap, target_id) AS rank FROM c) WHERE rank <= 50),
d AS (SELECT query_id, target_id, list_distance(x.v, y.v) AS dist FROM few JOIN v x ON x.id = query_id JOIN v y ON y.id = target_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, target_id)::INTEGER AS rank FROM d)
SELECT query_id, target_id, round(dist, 6) AS dist, rank FROM r WHERE rank <= 5"""


@register("WITH " + _SKETCH.format("list_sum(list_transform(range(1, 17), lambda i: (q.bits[i] <> x.bits[i])::INTEGER))"))
def sketch_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return rounded(sketches.sketch_search(asked(x), x, sketches.sketch(asked(x), P), sketches.sketch(x, P), 5, 10), "dist")


@register("WITH " + _SKETCH.format("list_sum(list_transform(range(1, 17), lambda i: (q.bits[i] <> x.bits[i])::INTEGER * q.deltas[i]))"))
def sketch_asym_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return rounded(sketches.sketch_search(asked(x), x, sketches.sketch(asked(x), P), sketches.sketch(x, P), 5, 10, weighted=True), "dist")


_SLOTS = [f"(CASE WHEN list_inner_product(v, {_list(p.a)}) >= 0 THEN 1 ELSE 0 END + {2 * (i // 2)})" for i, p in enumerate(PLANES)]


@register(f"WITH {V}, e AS (SELECT label, unnest([{', '.join(_SLOTS)}])::BIGINT AS slot FROM v) SELECT label, slot, count(*)::DOUBLE AS value FROM e GROUP BY ALL")
def histogram_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four blocks of two hashes each, over the vectors of a label."""
    return sketches.histogram(vectors(spark, sf_dir), [PLANES[i : i + 2] for i in range(0, 8, 2)], key="label", weight=None)


# ---- evaluation and clustering

_TWO = f"""{V}, {Q}, t AS (SELECT query_id, id AS target_id, row_number() OVER (PARTITION BY query_id ORDER BY {DISTANCE['l2']}, id) AS rt FROM q, v),
f AS (SELECT query_id, id AS target_id, row_number() OVER (PARTITION BY query_id ORDER BY {DISTANCE['l1']}, id) AS rf FROM q, v)"""
_CURVE = f"""{_TWO}, c AS (SELECT ratio, greatest(rt, ceil(rf / ratio)) AS k0 FROM t JOIN f USING (query_id, target_id), (VALUES (1), (2), (5)) r(ratio) WHERE rt <= 100 AND rf <= 100),
g AS (SELECT ratio, k FROM (VALUES (1), (2), (5)) r(ratio), range(1, 101) k(k) WHERE k * ratio <= 100),
curve AS (SELECT g.ratio, g.k, count(c.k0) / (g.k * (SELECT count(*) FROM q)) AS recall FROM g LEFT JOIN c ON c.ratio = g.ratio AND c.k0 <= g.k GROUP BY g.ratio, g.k)"""


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return evaluation.recall_curve(search.knn(asked(x), x, 100), search.knn(asked(x), x, 100, "l1"), (1, 2, 5), 100)


@register(f"WITH {_CURVE} SELECT ratio::INTEGER AS ratio, k::INTEGER AS k, round(recall, 6) AS recall FROM curve")
def recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_curve(spark, sf_dir), "recall")


@register(f"WITH {_CURVE} SELECT ratio::INTEGER AS ratio, round(max(recall) FILTER (k = 1), 6) AS k1, round(max(recall) FILTER (k = 10), 6) AS k10, round(max(recall) FILTER (k = 20), 6) AS k20 FROM curve GROUP BY ratio")
def recall_summary_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.recall_summary(_curve(spark, sf_dir), (1, 10, 20)), "k1", "k10", "k20")


@register(f"WITH {_TWO} SELECT t.query_id, round(count(f.target_id) / 10, 6) AS recall FROM t LEFT JOIN f ON f.query_id = t.query_id AND f.target_id = t.target_id AND rf <= 10 WHERE rt <= 10 GROUP BY t.query_id")
def compare_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return rounded(evaluation.compare_search(search.knn(asked(x), x, 10), search.knn(asked(x), x, 10, "l1"), 10), "recall")


@register(f"""WITH {_TWO}, r AS (SELECT t.query_id, count(f.target_id) / 10 AS recall FROM t LEFT JOIN f ON f.query_id = t.query_id AND f.target_id = t.target_id AND rf <= 10 WHERE rt <= 10 GROUP BY t.query_id)
SELECT round(avg(recall), 6) AS mean, round(min(recall), 6) AS low, count(*) FILTER (recall = 1) AS whole, count(*) FILTER (recall >= 0.99) AS from_99, count(*) FILTER (recall > 0.9) AS above_90 FROM r""")
def recall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return rounded(evaluation.recall_report(evaluation.compare_search(search.knn(asked(x), x, 10), search.knn(asked(x), x, 10, "l1"), 10)), "mean", "low")


@register(f"""WITH {_TWO}, a AS (SELECT query_id, list(target_id) AS x FROM t WHERE rt <= 10 GROUP BY query_id), b AS (SELECT query_id, list(target_id) AS y FROM f WHERE rf <= 20 GROUP BY query_id),
s AS (SELECT query_id, len(list_intersect(x, y)) / len(y) AS p, len(list_intersect(x, y)) / len(x) AS r FROM a JOIN b USING (query_id))
SELECT query_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s""")
def list_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    truth, found = (clustering.neighbour_lists(search.knn(asked(x), x, k, m)) for k, m in ((10, "l2"), (20, "l1")))
    return rounded(evaluation.list_scores(truth, found), "precision", "recall", "f1")


_NN = f"""{V}, d AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM v a, v b),
nn AS (SELECT a AS id, list(b ORDER BY rank) AS nbrs FROM d WHERE rank <= 10 GROUP BY a),
sh AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.nbrs, y.nbrs)) AS shared FROM nn x JOIN nn y ON x.id < y.id AND list_contains(x.nbrs, y.id) AND list_contains(y.nbrs, x.id))"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return materialise(clustering.neighbour_lists(search.knn(x, x, 10)), "neighbours")


@register(f"WITH {_NN} SELECT a, b, shared::INTEGER AS shared FROM sh")
def nn_shared_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.shared_neighbours(_lists(spark, sf_dir))


_JP = _NN.replace("v AS (", "RECURSIVE v AS (", 1) + """, e AS (SELECT a, b FROM sh WHERE shared >= 4 UNION ALL SELECT b, a FROM sh WHERE shared >= 4),
reach AS (SELECT id AS a, id AS b FROM v UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b), jp AS (SELECT a AS id, min(b) AS cluster_id FROM reach GROUP BY a)"""


@register(f"WITH {_JP} SELECT id, cluster_id FROM jp")
def jarvis_patrick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.jarvis_patrick(_lists(spark, sf_dir), 4)


@register(f"WITH {_JP} SELECT cluster_id, count(*) AS n FROM jp GROUP BY cluster_id HAVING count(*) >= 2")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_sizes(clustering.jarvis_patrick(_lists(spark, sf_dir), 4))


@register(f"""WITH {_JP}, x AS (SELECT jp.id, cluster_id, label FROM jp JOIN v ON v.id = jp.id), c AS (SELECT cluster_id, label, count(*) AS n FROM x GROUP BY ALL),
p AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM x GROUP BY cluster_id)) AS sx, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM x GROUP BY label)) AS sy,
  (SELECT count(*) * (count(*) - 1) / 2 FROM x) AS e)
SELECT round(a / (sx + sy - a), 6) AS jaccard, round((e + 2 * a - sx - sy) / e, 6) AS rand, round((a - sx * sy / e) / ((sx + sy) / 2 - sx * sy / e), 6) AS adjusted_rand FROM p""")
def clustering_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = clustering.jarvis_patrick(_lists(spark, sf_dir), 4)
    labels = vectors(spark, sf_dir).select("id", F.col("label").alias("cluster_id"))
    return rounded(clustering.agreement(got, labels), "jaccard", "rand", "adjusted_rand")


# ---- molecules: an order's lines as a chain of atoms, written as SDF and read back

_Z = "CASE l_partkey % 4 WHEN 0 THEN 6 WHEN 1 THEN 7 WHEN 2 THEN 8 ELSE 16 END"
_CHAIN = f"""a AS (SELECT l_orderkey AS mol_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS aid, {_Z} AS z, l_suppkey % 2 + 1 AS ord, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
m AS (SELECT *, (CASE WHEN aid > 1 THEN 1 ELSE 0 END + CASE WHEN aid < n THEN 1 ELSE 0 END) AS deg, coalesce(lag(ord) OVER (PARTITION BY mol_id ORDER BY aid) - 1, 0) + CASE WHEN aid < n THEN ord - 1 ELSE 0 END AS pi FROM a WHERE n > 1),
k AS (SELECT *, ((z << 6) & 8128) | ((deg << 3) & 56) | (pi & 7) AS code FROM m)"""


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbol = F.element_at(F.array(*[F.lit(x) for x in ("C", "N", "O", "S")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", symbol.alias("s"), (F.col("l_suppkey") % 2 + 1).alias("o")).alias("x"))
    rows = lines.groupBy(F.col("l_orderkey").alias("mol_id")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    n = F.size("x")
    atoms = F.transform("x", lambda x: F.format_string("    0.0000    0.0000    0.0000 %-3s 0  0", x.s))
    bonds = F.transform(F.slice("x", F.lit(1), n - 1), lambda x, i: F.format_string("%3d%3d%3d", i + 1, i + 2, x.o))
    head = F.array(F.concat(F.lit("order "), F.col("mol_id").cast("string")), F.lit("  affinis"), F.lit(""), F.format_string("%3d%3d", n, n - 1))
    tags = F.array(F.lit("M  END"), F.lit("> <ORDER>"), F.col("mol_id").cast("string"), F.lit(""), F.lit("> <LINES>"), n.cast("string"), F.lit(""))
    return rows.select("mol_id", F.array_join(F.concat(head, atoms, bonds, tags), "\n").alias("sdf"))


@register(f"WITH {_CHAIN} SELECT mol_id, 'order ' || mol_id AS name, count(*)::INTEGER AS n_atoms, (count(*) - 1)::INTEGER AS n_bonds, (CASE WHEN n > 1 THEN sum(z) ELSE 0 END)::BIGINT AS protons, coalesce(sum(CASE WHEN aid < n THEN ord END), 0)::BIGINT AS orders, n > 1 AS valid FROM a GROUP BY mol_id, n")
def sdf_parse_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = chemistry.parse_sdf(molecules(spark, sf_dir))
    total = lambda c, f: F.aggregate(c, F.lit(0), lambda s, x: s + f(x)).cast("long")
    return p.select("mol_id", "name", "n_atoms", "n_bonds", total("atoms", lambda x: x.z).alias("protons"), total("bonds", lambda x: x.ord).alias("orders"), "valid")


@register("SELECT l_orderkey AS mol_id, l_orderkey::VARCHAR AS order_tag, count(*)::VARCHAR AS lines_tag FROM lineitem GROUP BY l_orderkey")
def sdf_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = molecules(spark, sf_dir).withColumn("t", chemistry.sdf_tags(F.col("sdf")))
    return t.select("mol_id", F.try_element_at("t", F.lit("ORDER")).alias("order_tag"), F.try_element_at("t", F.lit("LINES")).alias("lines_tag"))


@register(f"WITH {_CHAIN} SELECT x.mol_id, x.aid::INTEGER AS a, y.aid::INTEGER AS b, (y.aid - x.aid)::INTEGER AS distance, ((least(x.code, y.code) << 20) & 4294967295) | (((y.aid - x.aid) & 63) << 13) | greatest(x.code, y.code) AS code FROM k x JOIN k y ON x.mol_id = y.mol_id AND x.aid < y.aid")
def atom_pair_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chemistry.atom_pairs(chemistry.parse_sdf(molecules(spark, sf_dir)).where("valid"))


@register(f"WITH {_CHAIN}, c AS (SELECT x.mol_id, (((least(x.code, y.code) << 20) & 4294967295) | (((y.aid - x.aid) & 63) << 13) | greatest(x.code, y.code)) AS code FROM k x JOIN k y ON x.mol_id = y.mol_id AND x.aid < y.aid) SELECT mol_id, string_agg(code::VARCHAR, ',' ORDER BY code) AS text, count(*)::INTEGER AS n FROM c GROUP BY mol_id")
def descriptor_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = chemistry.descriptors(chemistry.parse_sdf(molecules(spark, sf_dir)).where("valid"))
    text = chemistry.descriptor_to_string(F.col("desc"))
    return d.select("mol_id", text.alias("text"), F.size(chemistry.descriptor_from_string(text)).alias("n"))


# ---- no SQL form: learned, iterative or streaming; tests hold them against properties


@register(f"WITH {V}, {REFS} SELECT x.ref AS a, y.ref AS b, round(list_distance(x.w, y.w), 4) AS dist FROM r x JOIN r y ON x.ref < y.ref")
def mds_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the scaled references: with as many dimensions as references, those that they were made from."""
    refs = references(vectors(spark, sf_dir))
    d = search.distances(refs, refs).select(F.col("query_id").alias("left_id"), F.col("target_id").alias("right_id"), "dist")
    ids, square = embedding.reference_matrix(d)
    at = spark.createDataFrame([(i, x) for i, x in zip(ids, embedding.classical_scaling(square, N_REFS).tolist(), strict=True)], "id long, vec array<double>")
    return search.distances(at, at).where("query_id < target_id").select(F.col("query_id").alias("a"), F.col("target_id").alias("b"), F.round("dist", 4).alias("dist"))


def _embedding(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, DataFrame]:
    x = vectors(spark, sf_dir)
    refs = references(x)
    d = search.distances(refs, refs).select(F.col("query_id").alias("left_id"), F.col("target_id").alias("right_id"), (F.col("dist") / 4).alias("dist"))
    ids, square = embedding.reference_matrix(d)
    every = search.distances(refs, x).select(F.col("target_id").alias("query_id"), F.col("query_id").alias("target_id"), (F.col("dist") / 4).alias("dist"))
    return embedding.classical_scaling(square, 16), embedding.distances_to_references(every, ids)


@register()
def embed_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, dists = _embedding(spark, sf_dir)
    return embedding.embed(dists, at)


#: Wide enough that 40 probes can reach a recall of 0.9.
WIDE = lsh_index.LshParams.random(DIM, 4, 4, 1.2, seed=7)


@register()
def lsh_adaptive_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return rounded(lsh_index.adaptive(asked(x), x, WIDE, 10, 40, 0.9), "dist")


#: Queries that the a-posteriori model learns from.
N_TRAIN = 200


@register()
def apost_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on a bounded sample of vectors and their true neighbours, asked with the query set."""
    x = vectors(spark, sf_dir)
    train = materialise(sets.select_rows(x, sets.sample(x.select("id"), N_TRAIN, seed=1)), "train")
    near = search.knn(train, x, 20, exclude_self=True).select("query_id", F.col("target_id").alias("id")).join(x.select("id", "vec"), "id")
    got = near.groupBy("query_id").agg(F.collect_list(F.col("vec").cast("array<double>")).alias("n")).join(train.select(F.col("id").alias("query_id"), F.col("vec").cast("array<double>").alias("q")), "query_id").orderBy("query_id").collect()
    model = lsh_index.APosteriori(I, np.array([r["q"] for r in got]), [np.array(r["n"]) for r in got])
    return lsh_index.candidates(lsh_index.a_posteriori_probes(asked(x), model, _T), lsh_index.build_index(x, I))


@register()
def tune_mplsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    model = tuning.fit_data(x, search.pair_distances(sets.random_pairs(x, 2000, seed=1), x, measures.l2), k=10, folds=3, n_queries=25)
    got = tuning.tune_index(model, x.count(), 10, 10, 8, 0.5, steps=20, most=6)
    w, m, recall, cost = got if got else (None, None, None, None)
    return spark.createDataFrame([(w, m, recall, cost)], "width double, projections int, recall double, cost double")


#: Fitted once to vectors drawn at random, so that both forms have the same parameters.
SPECTRAL = lsh.fit_spectral(np.random.Generator(np.random.PCG64(17)).standard_normal((500, DIM)) / 8, 12)


def _wave(omega: tuple[float, ...]) -> str:
    centred = f"list_transform(range(1, {DIM + 1}), lambda i: v[i] - {_list(SPECTRAL.mean)}[i])"
    return " * ".join(f"sin(list_inner_product({centred}, {_list(c)}) * {float(o)!r}::DOUBLE + pi() / 2)" for c, o in zip(SPECTRAL.components, omega, strict=True) if o)


@register(f"WITH {V} SELECT id, (" + " + ".join(f"CASE WHEN {_wave(o)} > 0 THEN {1 << i} ELSE 0 END" for i, o in enumerate(SPECTRAL.omegas)) + ")::BIGINT AS bits FROM v")
def spectral_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", SPECTRAL.hash(F.col("vec")).alias("bits"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a stream of files."""
    rows = spark.readStream.schema(table(spark, sf_dir, "embeddings").schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/embeddings.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        stream = rows.parquet(path.toString())
    else:  # a stream's source must be a folder
        stream = rows.option("pathGlobFilter", "embeddings.parquet").parquet(sf_dir)
    return stream.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@register(_SQL["lsh_index_table"])
def stream_add_availablenow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index that a stream of additions leaves."""
    to = fresh(spark, "stream")
    serving.add_to_index(_stream(spark, sf_dir), I, f"{to}/index", f"{to}/items", f"{to}/state").awaitTermination()
    return spark.read.parquet(f"{to}/index").select("tbl", "bucket", "id")


@register(_SQL["lsh_multiprobe_topk"])
def stream_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of queries against a static index."""
    to, x = fresh(spark, "stream"), vectors(spark, sf_dir)
    q = asked(_stream(spark, sf_dir))
    serving.answer(q, x, lsh_index.build_index(x, I), I, 10, _T, f"{to}/answers", f"{to}/state").awaitTermination()
    return rounded(spark.read.parquet(f"{to}/answers").select("query_id", "target_id", "dist", "rank"), "dist")


from . import file_queries  # noqa: E402, F401  (it registers its queries here)
