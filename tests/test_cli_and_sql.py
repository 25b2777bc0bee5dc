import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis import cli
from affinis.functions import measures
from affinis.operators import lsh_index
from affinis.plans.sql import register_functions
from affinis.sources.writers import save_index_table
from tests.test_chemistry import sdf


def test_sql_functions(spark):
    assert len(register_functions(spark)) == 9
    a, b = [1.0, 2.0, 2.0], [0.0, 4.0, 1.0]
    df = spark.createDataFrame([(a, b, [1, 1, 2], [1, 2, 2], 392, 520, 69)], "a array<double>, b array<double>, s array<long>, t array<long>, p long, q long, d int")
    df.createOrReplaceTempView("rows_of_sql_test")
    got = spark.sql(
        "SELECT l1_distance(a, b), l2_distance(a, b), chebyshev_distance(a, b), dot_product(a, b), cosine_distance(a, b), multiset_tanimoto(s, t), set_jaccard(s, t), hamming_distance(s, t), atom_pair_code(p, q, d) FROM rows_of_sql_test"
    ).first()
    want = df.select(
        measures.l1("a", "b"), measures.l2("a", "b"), measures.chebyshev("a", "b"), measures.dot("a", "b"), measures.cosine_distance("a", "b"), measures.multiset_tanimoto("s", "t"), measures.set_jaccard("s", "t"), measures.hamming("s", "t")
    ).first()
    assert list(got)[:8] == [pytest.approx(x) for x in want] and got[8] == (392 << 20) | ((69 & 63) << 13) | 520
    assert spark.sql("SELECT multiset_tanimoto(array(), array())").first()[0] is None


def test_bucketed_index(spark, tmp_path):
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(1).standard_normal((50, 3)))], "id long, vec array<double>")
    p = lsh_index.LshParams.random(3, 2, 2, 1.0)
    table = save_index_table(lsh_index.build_index(x, p), "affinis_index_test", 4)
    try:
        assert table.count() == 100
        plan = lsh_index.build_probes(x, p, 2).hint("merge").join(table, ["tbl", "bucket"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.sql("DROP TABLE affinis_index_test")


def test_command_line(spark, tmp_path):
    mols = [sdf(f"m{i}", "CC" + "NOSC"[i % 4] + "C" * (i // 4 + 1), [(j, j + 1, 1) for j in range(1, 3 + i // 4 + 1)]) for i in range(24)]
    (tmp_path / "all.sdf").write_text("".join(f"{m}$$$$\n" for m in mols[:20]))
    (tmp_path / "new.sdf").write_text("".join(f"{m}$$$$\n" for m in mols[20:]))
    (tmp_path / "ids").write_text("3\n5\n")
    call = lambda *a: cli.run(cli.parser().parse_args([a[0], str(tmp_path / "db"), *a[1:]]), spark)
    call("init", "-i", str(tmp_path / "all.sdf"), *[x for s in ("n_references=8", "dim=4", "width=1.0", "projections=2", "tables=6") for x in ("-s", s)])
    call("build")
    got = call("query", "-i", str(tmp_path / "ids"), "--ids", "-k", "3").where("rank = 1").collect()
    assert {(r["query"], r["distance"]) for r in got} == {("m2", 0.0), ("m4", 0.0)}
    call("add", "-i", str(tmp_path / "new.sdf"))
    assert call("query", "-i", str(tmp_path / "new.sdf"), "-k", "2").where("rank = 1").agg(F.max("distance")).first()[0] == 0.0
    assert call("embed", "-i", str(tmp_path / "new.sdf")).count() == 4
    assert call("cluster", "-k", "3", "--shared", "2").count() == 24
    call("clean")
    assert not (tmp_path / "db" / "index").exists() and (tmp_path / "db" / "compounds").exists()
    call("build")
    assert call("query", "-i", str(tmp_path / "ids"), "--ids").count() > 0
