"""Queries that write a file format from the driver's tables and read it back, with SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lsh, measures
from ..operators import lsh_index, search
from ..sources import readers, writers
from .catalogue import _CHAIN, DIM, DISTANCE, THRESHOLDS, Q, V, _ranked, asked, molecules, register, rounded, table, vectors
from .lineage import fresh


def _written(lines: DataFrame, name: str, compression: str = "none") -> str:
    """The folder of a text file of these lines."""
    path = fresh(lines.sparkSession, name)
    lines.write.option("compression", compression).text(path)
    return path


@register(f"WITH {_CHAIN} SELECT mol_id, 'order ' || mol_id AS name, count(*)::INTEGER AS n_atoms FROM a WHERE mol_id % 4 < 3 GROUP BY mol_id")
def sdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain files with LF and CR LF and a compressed one; a fourth has no marks, so that its one record is open and dropped."""
    from ..functions import chemistry

    rows, found = molecules(spark, sf_dir), None
    text = F.concat("sdf", F.lit("\n$$$$"))
    crlf = F.concat(F.replace(text, F.lit("\n"), F.lit("\r\n")), F.lit("\r"))
    for kind, (value, compression) in enumerate(((text, "none"), (crlf, "none"), (text, "gzip"), (F.col("sdf"), "none"))):
        path = _written(rows.where(F.col("mol_id") % 4 == kind).select(value.alias("value")), "sdf", compression)
        got = readers.sdf_records(spark, path)
        found = got if found is None else found.unionByName(got)
    mol_id = F.try_element_at(chemistry.sdf_tags(F.col("sdf")), F.lit("ORDER")).cast("long")
    return chemistry.parse_sdf(found).select(mol_id.alias("mol_id"), "name", "n_atoms")


@register("SELECT c_custkey + 1 AS compound_id FROM customer UNION ALL SELECT s_suppkey + 1 FROM supplier")
def id_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "ids")
    writers.write_id_list(table(spark, sf_dir, "customer").select(F.col("c_custkey") + 1), path)
    writers.write_id_list(table(spark, sf_dir, "supplier").select(F.col("s_suppkey") + 1), path, append=True)
    return readers.id_list(spark, path)


@register(f"WITH {V} SELECT count(*) AS n, round(sum(list_sum(list_transform(v, lambda x: x::FLOAT::DOUBLE))), 3) AS total, max(len(v))::INTEGER AS size FROM v")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "records")
    writers.write_record_file(vectors(spark, sf_dir), path)
    total = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return readers.record_file(spark, path).agg(F.count("*").alias("n"), F.round(F.sum(total), 3).alias("total"), F.max(F.size("vec")).alias("size"))


def _numbers(vec: str = "vec") -> Column:
    return F.array_join(F.transform(F.col(vec).cast("array<double>"), lambda x: x.cast("string")), " ")


@register(f"WITH {V} SELECT id, round(v[1], 6) AS first, round(list_sum(v), 6) AS total FROM v")
def coordinate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    path = _written(x.select(F.concat(_numbers(), F.lit(" : "), F.col("id").cast("string")).alias("value")), "coordinates")
    total = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v)
    return readers.coordinate_records(spark, path).select("id", F.round(F.col("vec")[0], 6).alias("first"), F.round(total, 6).alias("total"))


@register(f"WITH {V} SELECT count(*) AS n, round(sum(v[1]), 6) AS first, round(sum(v[{DIM}]), 6) AS last FROM v")
def vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = readers.text_vectors(spark, _written(vectors(spark, sf_dir).select(_numbers().alias("value")), "vectors"))
    return got.agg(F.count("*").alias("n"), F.round(F.sum(F.col("vec")[0]), 6).alias("first"), F.round(F.sum(F.col("vec")[DIM - 1]), 6).alias("last"))


@register(_ranked())
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    lines = writers.result_text(search.knn(asked(x), x, 10)).select(F.concat_ws("\t", F.col("query_id").cast("string"), "line").alias("value"))
    rows = spark.read.text(_written(lines, "results")).select(F.split("value", "\t").alias("p"))
    return rounded(readers.result_lines(rows.select(F.col("p")[0].cast("long").alias("query_id"), F.col("p")[1].alias("line"))), "dist")


@register(_ranked(k=5))
def benchmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbours of each query are stored, five asked for."""
    x = vectors(spark, sf_dir)
    lines = writers.result_text(search.knn(asked(x), x, 10))
    line = F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("10"), F.replace("line", F.lit(":"), F.lit(" ")))
    return rounded(readers.benchmark_lines(spark, _written(lines.select(line.alias("value")), "benchmark"), 5), "dist")


@register("SELECT l_orderkey::VARCHAR AS set_id, round(l_quantity, 4) AS weight, round(l_extendedprice, 4) AS first, round(l_discount, 4) AS second FROM lineitem")
def weighted_set_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws(" ", *[F.col(c).cast("string") for c in ("l_quantity", "l_extendedprice", "l_discount")]).alias("line"))
    sets = lines.groupBy("l_orderkey").agg(F.collect_list("line").alias("l"))
    text = F.concat_ws("\n", F.concat_ws(" ", F.col("l_orderkey").cast("string"), F.size("l").cast("string")), F.array_join("l", "\n"))
    got = readers.weighted_sets(spark, _written(sets.select(text.alias("value")), "sets"))
    return rounded4(got.select("set_id", "weight", F.col("vec")[0].alias("first"), F.col("vec")[1].alias("second")), "weight", "first", "second")


def rounded4(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


@register("SELECT 'part ' || p_partkey AS name, length(p_name)::INTEGER AS size FROM part")
def mol2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that carry a part's name as a comment, renamed after they are read."""
    block = F.concat(F.lit("@<TRIPOS>MOLECULE\nold\n"), "p_name", F.lit("\n"), F.col("p_partkey").cast("string"), F.lit("\n@<TRIPOS>ATOM"))
    got = readers.mol2_records(spark, _written(table(spark, sf_dir, "part").select(block.alias("value")), "mol2"))
    lines = F.split("mol2", "\n")
    named = readers.rename_mol2(got.withColumn("new", F.concat(F.lit("part "), lines[3])), "new").withColumn("lines", F.split("mol2", "\n"))
    return named.select(F.col("lines")[1].alias("name"), F.length(F.col("lines")[2]).alias("size"))


@register("SELECT l_orderkey AS id, count(*) AS residues, max(l_linenumber)::INTEGER AS last FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey")
def pdb_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each order would be many; one order is a chain of residues numbered by its lines, parted by another record."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    atom = F.format_string("ATOM  %5d  CA  ALA A%4d     0.000   0.000   0.000 %d", F.col("l_linenumber"), F.col("l_linenumber"), F.col("l_orderkey"))
    chains = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", atom.alias("a")))).alias("a"))
    start = F.format_string("ATOM      0  CA  ALA A%4d     0.000   0.000   0.000 start", F.lit(0))
    text = F.concat_ws("\n", start, F.array_join(F.transform("a", lambda x: x.a), "\n"))
    got = readers.pdb_residues(spark, _written(chains.select(text.alias("value")), "pdb")).where("residue_id <> '0'")
    order = F.regexp_extract("text", r"(\d+)$", 1).cast("long")
    return got.groupBy(order.alias("id")).agg(F.count("*").alias("residues"), F.max(F.col("residue_id").cast("int")).alias("last"))


@register(f"WITH {V}, {Q} SELECT query_id AS left_id, count(*)::INTEGER AS n, round(sum(list_distance(w, v))) AS total FROM q, v GROUP BY query_id")
def matrix_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six significant digits are written, so that sums are told as whole numbers."""
    x = vectors(spark, sf_dir)
    numbers = F.split("line", " ").cast("array<double>")
    return writers.row_text(search.distance_rows(asked(x), x)).select("left_id", F.size(numbers).alias("n"), F.round(F.aggregate(numbers, F.lit(0.0), lambda s, v: s + v)).alias("total"))


@register(f"WITH {_CHAIN} SELECT mol_id, 'order ' || mol_id AS name, (count(*) * (count(*) - 1) // 2)::INTEGER AS n FROM m GROUP BY mol_id")
def descriptor_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records described and stored, the store opened again; those that can't be described are left out."""
    path = fresh(spark, "store")
    writers.build_descriptor_store(molecules(spark, sf_dir).withColumnRenamed("mol_id", "compound_id"), path)
    return writers.open_store(spark, path).select(F.col("compound_id").alias("mol_id"), "name", F.size("desc").alias("n"))


_FLAT = " + ".join(f"CASE WHEN v[{p.dim + 1}] >= {p.at!r}::DOUBLE THEN {1 << i} ELSE 0 END" for i, p in enumerate(reversed(THRESHOLDS)))


@register(f"""WITH {V}, h AS (SELECT *, ({_FLAT})::BIGINT AS bucket FROM v), d AS (SELECT x.id AS query_id, y.id AS target_id, {DISTANCE['l1'].replace('w[i]', 'x.v[i]').replace('- v[i]', '- y.v[i]').replace('len(v)', 'len(y.v)')} AS dist
FROM h x JOIN h y USING (bucket) WHERE x.id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, target_id)::INTEGER AS rank FROM d) SELECT query_id, target_id, round(dist, 6) AS dist, rank FROM r WHERE rank <= 10""")
def flat_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat index over thresholds of components, with the distance they are made for."""
    x = vectors(spark, sf_dir)
    families = [lsh.Repeat(tuple(THRESHOLDS))]
    found = lsh_index.flat_candidates(lsh_index.flat_index(asked(x), families), lsh_index.flat_index(x, families))
    return rounded(search.refine(found, asked(x), x, measures.l1, 10), "dist")


_LABELLED = _ranked(source="q JOIN v l ON l.id = query_id JOIN v ON v.label = l.label", where="list_distance(w, v.v) <= 1.25").replace("list_distance(w, v) AS", "list_distance(w, v.v) AS").replace("query_id, id AS", "query_id, v.id AS")


@register(_LABELLED)
def refine_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the query's label, refined up to a distance."""
    x = vectors(spark, sf_dir)
    found = asked(x).select(F.col("id").alias("query_id"), "label").join(x.select(F.col("id").alias("target_id"), "label"), "label")
    return rounded(search.refine(found, asked(x), x, measures.l2, 10, cutoff=1.25), "dist")


@register("SELECT vec_id AS compound_id, vec_id::VARCHAR AS name, 4::BIGINT AS tables FROM embeddings")
def add_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the vectors as compounds of a database, embedded and indexed; the other half added to it, by the same references."""
    from . import api

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("compound_id"), F.col("embedding").alias("vector"))
    config = api.Config("vector", n_references=20, dim=8, tables=4, projections=6)
    db = api.build_embedding(api.init_db(rows.where("compound_id % 2 = 0"), "vector", config))
    db = api.add(db, rows.where("compound_id % 2 = 1"), "vector")
    met = db.index.groupBy("id").agg(F.count_distinct("tbl").alias("tables")).join(db.vectors.select("id"), "id")
    return db.compounds.join(met.withColumnRenamed("id", "compound_id"), "compound_id").select("compound_id", "name", "tables")
