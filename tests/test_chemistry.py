"""Molecules written by hand, with descriptors worked out by hand."""

import pytest
from pyspark.sql import functions as F

from affinis.functions import chemistry, measures


def sdf(name, atoms, bonds, tail="M  END\n"):
    lines = [name, "", "", f"{len(atoms):3d}{len(bonds):3d}"]
    lines += [f"    0.0000    0.0000    0.0000 {a:<3s} 0" for a in atoms]
    lines += [f"{a:3d}{b:3d}{o:3d}" for a, b, o in bonds]
    return "\n".join(lines) + "\n" + tail


MOLECULES = {
    "ethanol": ("CCO", [(1, 2, 1), (2, 3, 1)], [411050384, 411058696, 419439112]),
    "acetic acid": ("CCOO", [(1, 2, 1), (2, 3, 2), (2, 4, 1)], [411050393, 411058696, 411058697, 428876296, 428876297, 545276425]),
    "propanol": ("CCCO", [(1, 2, 1), (2, 3, 1), (3, 4, 1)], [411050384, 411058576, 411066888, 419438992, 419439112, 419447304]),
    "kekule": ("C" * 6, [(i + 1, (i + 1) % 6 + 1, i % 2 + 1) for i in range(6)], [420487569] * 6 + [420495761] * 6 + [420503953] * 3),
    "aromatic": ("C" * 6, [(i + 1, (i + 1) % 6 + 1, 4) for i in range(6)], [419438992] * 6 + [419447184] * 6 + [419455376] * 3),
    "ethanol with hydrogen": ("CCOH", [(1, 2, 1), (2, 3, 1), (3, 4, 1)], [411050384, 411058696, 419439112]),
}


def described(spark, rows):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "mol_id long, sdf string")
    parsed = chemistry.parse_sdf(df)
    return parsed, {r["mol_id"]: r["desc"] for r in chemistry.descriptors(parsed.where("valid")).collect()}


def test_descriptors_by_hand(spark):
    _, got = described(spark, [sdf(n, a, b) for n, (a, b, _) in MOLECULES.items()])
    assert got == {i: m[2] for i, m in enumerate(MOLECULES.values())}


def test_long_chain_wraps_and_parts_do_not_meet(spark):
    n = 70
    chain = sdf("chain", "C" * n, [(i, i + 1, 1) for i in range(1, n)])
    apart = sdf("apart", "CCOO", [(1, 2, 1), (3, 4, 1)])
    methane = sdf("methane", "CHHHH", [(1, i, 1) for i in range(2, 6)])
    parsed, got = described(spark, [chain, apart, methane])
    assert len(got[0]) == n * (n - 1) // 2
    ends = 392  # a carbon with one heavy neighbour
    assert (ends << 20) | ((69 & 63) << 13) | ends in got[0]
    assert len(got[1]) == 2
    assert 2 not in got and parsed.where("mol_id = 2").first()["valid"]


def test_heavy_elements_lose_the_top_bit(spark):
    _, got = described(spark, [sdf("gd", ["Gd", "Gd"], [(1, 2, 1)])])
    code = (64 << 6) | (1 << 3)
    assert got[0] == [((code << 20) & 0xFFFFFFFF) | (1 << 13) | code]


def test_rejected_records(spark):
    bad = [
        sdf("no bond", "C", []),
        sdf("r", ["R", "C"], [(1, 2, 1)]),
        sdf("unknown", ["Xx", "C"], [(1, 2, 1)]),
        sdf("order 0", "CC", [(1, 2, 0)]),
        sdf("missing atom", "CC", [(1, 3, 1)]),
        "short\n\n\n  2  1\n",
        "",
        None,
    ]
    parsed, got = described(spark, bad)
    assert not any(r["valid"] for r in parsed.collect()) and not got


def test_last_bond_counts(spark):
    parsed, _ = described(spark, [sdf("twice", "CC", [(1, 2, 1), (2, 1, 2)])])
    assert [tuple(b) for b in parsed.first()["bonds"]] == [(1, 2, 2)]


def test_tags_and_annotations(spark):
    text = sdf("t", "CC", [(1, 2, 1)], "M  END\n> <A>\n1\n\n> <B> \n two \n\n> <A>\n3\n\n")
    row = spark.createDataFrame([(text,)], "sdf string").select(chemistry.sdf_tags(F.col("sdf")).alias("t"), chemistry.drop_annotations(F.col("sdf")).alias("d")).first()
    assert row["t"] == {"A": "3", "B": "two"} and ">" not in row["d"]


def test_strings_fingerprints_and_elements(spark):
    d = [5, 1030, 1030]
    df = spark.createDataFrame([(d,)], "d array<long>")
    r = df.select(
        chemistry.descriptor_to_string(F.col("d")).alias("s"),
        chemistry.descriptor_from_string(chemistry.descriptor_to_string(F.col("d"))).alias("back"),
        chemistry.fold_fingerprint(F.col("d"), 1024).alias("fp"),
        chemistry.descriptor_element(F.col("d"), 1).alias("e"),
        chemistry.descriptor_element(F.col("d"), 9).alias("none"),
    ).first()
    assert r["s"] == "5,1030,1030" and r["back"] == d and r["e"] == 1030 and r["none"] is None
    assert r["fp"][0] == (1 << 5) | (1 << 6) and sum(r["fp"][1:]) == 0


@pytest.mark.parametrize(
    ("a", "b", "want"), [([1, 1, 2], [1, 2, 2], 0.5), ([1], [1], 1.0), ([1], [2], 0.0), ([], [], None), (MOLECULES["ethanol"][2], MOLECULES["acetic acid"][2], 0.125), (MOLECULES["ethanol"][2], MOLECULES["propanol"][2], 2 / 7)]
)
def test_tanimoto(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    got = df.select(measures.multiset_tanimoto("a", "b")).first()[0]
    assert got == (want if want is None else pytest.approx(want))
