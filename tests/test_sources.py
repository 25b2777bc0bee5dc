import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.sources import readers, writers
from tests.test_chemistry import sdf

A, B = sdf("a", "CCO", [(1, 2, 1), (2, 3, 1)], "M  END\n> <T>\nx\n\n"), sdf("b", "C", [])


def test_sdf_files(spark, tmp_path):
    whole, cut = f"{A}$$$$\n{B}$$$$\n", f"{A}$$$$\n{B}"
    for name, text, n in (("whole", whole, 2), ("cut", cut, 1), ("bare", whole.rstrip("\n"), 2)):
        (tmp_path / f"{name}.sdf").write_text(text)
        assert readers.sdf_records(spark, str(tmp_path / f"{name}.sdf")).count() == n, name
        with gzip.open(tmp_path / f"{name}.gz", "wt") as f:
            f.write(text)
        assert readers.sdf_records(spark, str(tmp_path / f"{name}.gz")).count() == n, name
    assert {r["sdf"] for r in readers.sdf_records(spark, str(tmp_path / "whole.sdf")).collect()} == {A, B}
    assert readers.sdf_records(spark, str(tmp_path / "whole.sdf"), True).where("sdf LIKE '%<T>%'").count() == 0
    stored, bad = writers.build_descriptor_store(readers.sdf_records(spark, str(tmp_path / "whole.sdf")).withColumn("compound_id", F.when(F.col("sdf").startswith("a"), 1).otherwise(2)), str(tmp_path / "store"))
    assert stored == 1 and [r["compound_id"] for r in bad.collect()] == [2]
    with pytest.raises(NotImplementedError):
        readers.smiles("x")


def test_mol2_and_pdb(spark, tmp_path):
    (tmp_path / "m.mol2").write_text("@<TRIPOS>MOLECULE\nfirst\n 1\n@<TRIPOS>MOLECULE\nsecond\n 2\n")
    got = readers.mol2_records(spark, str(tmp_path / "m.mol2"))
    assert sorted(r["name"] for r in got.collect()) == ["first", "second"]
    renamed = readers.rename_mol2(got.withColumn("new", F.upper("name")), "new").collect()
    assert all(r["mol2"].split("\n")[1] == r["new"] for r in renamed)
    atom = lambda res, i, chain="A": f"ATOM  {i:5d}  CA  {res} {chain}{i // 2 + 1:4d}      1.0"
    (tmp_path / "p.pdb").write_text("\n".join(["HEADER", atom("ALA", 0), atom("ALA", 1), "REMARK", atom("GLY", 2), atom("GLY", 3)]))
    rows = readers.pdb_residues(spark, str(tmp_path / "p.pdb")).orderBy("n").collect()
    assert [(r["chain"], r["residue"], r["residue_id"], r["text"].count("\n")) for r in rows] == [("A", "ALA", "1", 1), ("A", "GLY", "2", 1)]


def test_text_forms(spark, tmp_path):
    (tmp_path / "ids").write_text("3 1\n2\n")
    assert sorted(r[0] for r in readers.id_list(spark, str(tmp_path / "ids")).collect()) == [1, 2, 3]
    (tmp_path / "zero").write_text("0\n")
    with pytest.raises(Exception, match="begin at 1"):
        readers.id_list(spark, str(tmp_path / "zero")).collect()
    writers.write_id_list(spark.range(1, 4), str(tmp_path / "out"))
    writers.write_id_list(spark.range(9, 10), str(tmp_path / "out"), append=True)
    assert readers.id_list(spark, str(tmp_path / "out")).count() == 4
    (tmp_path / "vec").write_text("1 2.5\n3 4\n")
    assert [r[0] for r in readers.text_vectors(spark, str(tmp_path / "vec")).orderBy(F.col("vec")[0]).collect()] == [[1.0, 2.5], [3.0, 4.0]]
    (tmp_path / "ragged").write_text("1 2\n3\n")
    with pytest.raises(ValueError):
        readers.text_vectors(spark, str(tmp_path / "ragged"))
    (tmp_path / "sr").write_text("1 2 : 7\n")
    assert tuple(readers.coordinate_records(spark, str(tmp_path / "sr")).first()) == (7, [1.0, 2.0])
    assert readers.query_line("/K 5 1 2", 9) == ([1.0, 2.0], 5) and readers.query_line("1 2", 9)[1] == 9
    hits = spark.createDataFrame([(1, 1, 4, 0.5), (1, 2, 6, 0.75)], "query_id long, rank int, target_id long, dist double")
    lines = writers.result_text(hits)
    assert lines.first()["line"] == "4:0.5 6:0.75"
    assert sorted(map(tuple, readers.result_lines(lines).collect())) == sorted(map(tuple, hits.collect()))
    (tmp_path / "bench").write_text("5 2 8 0.1 9 0.2\n")
    assert [tuple(r) for r in readers.benchmark_lines(spark, str(tmp_path / "bench"), 2).orderBy("rank").collect()] == [(5, 1, 8, 0.1), (5, 2, 9, 0.2)]
    with pytest.raises(Exception, match="fewer"):
        readers.benchmark_lines(spark, str(tmp_path / "bench"), 3).collect()
    (tmp_path / "sets").write_text("a 2\n0.5 1 2\n1 3 4\nb 1\n2 5 6\n")
    assert [tuple(r) for r in readers.weighted_sets(spark, str(tmp_path / "sets")).orderBy("set_id", "weight").collect()] == [("a", 0.5, [1, 2]), ("a", 1.0, [3, 4]), ("b", 2.0, [5, 6])]
    d = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.123456789)], "left_id long, right_id long, dist double")
    assert writers.matrix_text(d, "\t").first()["line"] == "0\t0.123457"


def test_binary_forms(spark, tmp_path):
    x = np.arange(6, dtype="<f4").reshape(3, 2)
    (tmp_path / "rec").write_bytes(struct.pack("<III", 4, 3, 2) + x.tobytes())
    got = readers.record_file(spark, str(tmp_path / "rec")).orderBy("id")
    assert [tuple(r) for r in got.collect()] == [(i + 1, x[i].tolist()) for i in range(3)]
    writers.write_record_file(got.coalesce(1), str(tmp_path / "packed"))
    (file,) = tmp_path.glob("packed/part-*")
    assert file.read_bytes() == struct.pack("<III", 4, 3, 2) + x.tobytes() + b"\n"
    assert [tuple(r) for r in readers.record_file(spark, str(tmp_path / "packed")).orderBy("id").collect()] == [tuple(r) for r in got.collect()]
    body = struct.pack("<i3I", 3, 5, 6, 2**32 - 1) + struct.pack("<iI", -1, 9) + struct.pack("<i1I", 1, 7)
    (tmp_path / "db").write_bytes(b"DESCDB".ljust(16, b"\0") + b"\4" + body)
    assert [tuple(r) for r in readers.descriptor_database(spark, str(tmp_path / "db")).collect()] == [(1, [5, 6, 2**32 - 1]), (2, [7])]
    assert writers.fingerprint(got) == writers.fingerprint(got.repartition(3)) != writers.fingerprint(got.where("id > 1"))
    assert writers.index_path("r", "f", 0.8, 0, 4, 10, 1) == "r/f-0.8-0-4-10-1"
    writers.store(got, str(tmp_path / "t"), "w")
    writers.store(got, str(tmp_path / "t"), "a")
    assert writers.open_store(spark, str(tmp_path / "t")).count() == 6
    with pytest.raises(ValueError):
        writers.store(got, str(tmp_path / "t"), "r")


def test_record_marks(spark, tmp_path):
    """Marks begin a line, whatever follows on it; line ends of both kinds; the mark's characters inside a line are text."""
    import gzip

    from affinis.sources import readers

    cases = {
        "lf": "a\n1\n$$$$\nb\n2\n$$$$\n", "crlf": "c\r\n1\r\n$$$$\r\nd\r\n2\r\n$$$$\r\n", "blanks": "e\n1\n$$$$  x\nf\n2\n$$$$$",
        "open": "g\n1\n$$$$\nlost\n2\n", "inside": "h\ncosts $$$$ 5\n$$$$\ni\n$$$$$$$$\nj\n$$$$", "none": "lost\n",
    }
    for packed in (False, True):
        where = tmp_path / f"sdf{packed}"
        where.mkdir()
        for name, text in cases.items():
            data = text.encode()
            (where / (name + ".sdf" + ".gz" * packed)).write_bytes(gzip.compress(data) if packed else data)
        got = sorted(r["sdf"] for r in readers.sdf_records(spark, str(where)).collect())
        assert got == ["a\n1\n", "b\n2\n", "c\n1\n", "d\n2\n", "e\n1\n", "f\n2\n", "g\n1\n", "h\ncosts $$$$ 5\n", "i\n", "j\n"]


def test_a_pdb_file_is_read_by_lines_and_not_whole(spark, tmp_path):
    atom = lambda i, n: f"ATOM  {i:5d}  CA  ALA A{n:4d}     0.000"
    lines = [atom(i, i // 3 % 9000) for i in range(4000)]
    (tmp_path / "p.pdb").write_text("\r\n".join(["HEADER", *lines]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = readers.pdb_residues(spark, str(tmp_path / "p.pdb"))
        assert spark.read.text(str(tmp_path / "p.pdb")).rdd.getNumPartitions() > 3
        rows = got.orderBy("n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert "wholetext" not in got._jdf.queryExecution().toString() and "Generate" not in got._jdf.queryExecution().toString()
    assert [r["n"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == 1334
    assert "\n".join(r["text"] for r in rows) == "\n".join(lines)
