"""Molecules from SDF records, and their atom-pair descriptors, as Column expressions and DataFrame steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Element symbols in order of atomic number, R at 0.
ELEMENTS = (
    "R H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd "
    "Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th "
    "Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg"
).split()
MAX_LINE = 100_000
UINT32 = 0xFFFFFFFF
MAX_DISTANCE = 127


def compound_name(sdf: Column) -> Column:
    return F.substring_index(sdf, "\n", 1)


def sdf_tags(sdf: Column) -> Column:
    """Map of the tags of a record; of repeated tags the last value stays."""
    pattern = r">\s+<([^>]+)>([^>$]+)"
    keys = F.transform(F.regexp_extract_all(sdf, F.lit(pattern), F.lit(1)), lambda x: F.trim(x))
    values = F.transform(F.regexp_extract_all(sdf, F.lit(pattern), F.lit(2)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    # from the last to the first, keys that were met are skipped
    entries = F.reverse(F.arrays_zip(keys.alias("key"), values.alias("value")))
    first = F.aggregate(
        entries,
        F.array().cast("array<struct<key:string,value:string>>"),
        lambda s, e: F.when(F.exists(s, lambda x: x.key == e["key"]), s).otherwise(F.array_append(s, F.struct(e["key"].alias("key"), e["value"].alias("value")))),
    )
    return F.map_from_entries(first)


def drop_annotations(sdf: Column) -> Column:
    """The record up to the first line that begins with ``>``, and its end mark."""
    return F.regexp_replace(sdf, r"(?s)\n>.*?(?=\n\$\$\$\$|$)", "")


def _number(line: Column, start: int) -> Column:
    """The leading integer of three columns, 0 if there is none."""
    return F.coalesce(F.regexp_extract(F.substring(line, start, 3), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))


def _atomic_number(symbol: Column) -> Column:
    """-1 if unknown."""
    return F.coalesce(F.array_position(F.array(*[F.lit(e) for e in ELEMENTS]), symbol).cast("int"), F.lit(0)) - 1


def parse_sdf(records: DataFrame, record: str = "sdf") -> DataFrame:
    """records with name, n_atoms, n_bonds, atoms array<struct<aid, z>>, bonds array<struct<a, b, ord>> and valid added.

    Not valid: a null record, no atom or no bond, fewer lines than counted, a line of more than MAX_LINE characters, an
    unknown or R element, a bond line with a zero or an atom that isn't there. Of bonds between the same two atoms the
    last counts.
    """
    lines = F.split(F.col(record), "\n", -1)
    df = records.withColumn("__lines", lines)
    fourth = F.coalesce(F.try_element_at("__lines", F.lit(4)), F.lit(""))
    df = df.withColumns({"n_atoms": _number(fourth, 1), "n_bonds": _number(fourth, 4)})
    whole = (F.col("n_atoms") > 0) & (F.col("n_bonds") > 0) & (F.size("__lines") > F.col("n_atoms") + F.col("n_bonds") + 4)
    none = F.array().cast("array<string>")
    df = df.withColumns(
        {
            "__whole": F.coalesce(whole & ~F.exists("__lines", lambda x: F.length(x) > MAX_LINE), F.lit(False)),
            "__a": F.when(whole, F.slice("__lines", F.lit(5), F.greatest(F.lit(0), F.col("n_atoms")))).otherwise(none),
            "__b": F.when(whole, F.slice("__lines", F.col("n_atoms") + 5, F.greatest(F.lit(0), F.col("n_bonds")))).otherwise(none),
        }
    )
    atoms = F.transform("__a", lambda x, i: F.struct((i + 1).alias("aid"), _atomic_number(F.replace(F.substring(x, 32, 3), F.lit(" "), F.lit(""))).alias("z")))
    read = F.transform("__b", lambda x: F.struct(_number(x, 1).alias("a"), _number(x, 4).alias("b"), _number(x, 7).alias("ord")))
    ordered = F.transform(read, lambda x: F.struct(F.least(x.a, x.b).alias("a"), F.greatest(x.a, x.b).alias("b"), x.ord.alias("ord")))
    df = df.withColumns({"name": compound_name(F.col(record)), "atoms": atoms, "__bonds": ordered})
    last = F.filter(
        "__bonds", lambda x, i: ~F.exists(F.slice("__bonds", i + 2, F.size("__bonds")), lambda y: (y.a == x.a) & (y.b == x.b))
    )
    n = F.col("n_atoms")
    good = (
        F.col("__whole")
        & ~F.exists("atoms", lambda x: x.z <= 0)
        & ~F.exists("__bonds", lambda x: (x.ord == 0) | (x.a < 1) | (x.b < 1) | (x.a > n) | (x.b > n))
    )
    return df.withColumns({"bonds": last, "valid": good}).drop("__lines", "__whole", "__a", "__b", "__bonds")


def heavy_degree(atom: Column, atoms: Column, bonds: Column) -> Column:
    """Neighbours other than hydrogen."""
    return F.size(F.filter(bonds, lambda b: _meets(b, atom, atoms)))


def pi_electrons(atom: Column, atoms: Column, bonds: Column) -> Column:
    """Sum of order - 1 over bonds to neighbours other than hydrogen; orders from 4 on (aromatic) add nothing."""
    extra = F.transform(F.filter(bonds, lambda b: _meets(b, atom, atoms) & (b.ord < 4)), lambda b: b.ord - 1)
    return F.aggregate(extra, F.lit(0), lambda s, x: s + x)


def _meets(bond: Column, atom: Column, atoms: Column) -> Column:
    other = F.when(bond.a == atom.aid, bond.b).when(bond.b == atom.aid, bond.a)
    return F.coalesce(F.element_at(atoms, F.coalesce(other, F.lit(1))).z != 1, F.lit(False)) & other.isNotNull()


def atom_code(z: Column, degree: Column, pi: Column) -> Column:
    """13 bits: atomic number, degree up to 7, pi electrons up to 7."""
    low = F.shiftleft(F.least(degree, F.lit(7)), 3).bitwiseAND(0x38).bitwiseOR(F.least(pi, F.lit(7)).bitwiseAND(0x7))
    return F.shiftleft(z, 6).bitwiseAND(0x1FC0).bitwiseOR(low)


def pair_code(code_a: Column, code_b: Column, distance: Column) -> Column:
    """32 bits: the smaller code (its top bit is lost), distance modulo 64, the larger code."""
    small, large = F.least(code_a, code_b).cast("long"), F.greatest(code_a, code_b).cast("long")
    return F.shiftleft(small, 20).bitwiseAND(UINT32).bitwiseOR(F.shiftleft(distance.bitwiseAND(0x3F).cast("long"), 13)).bitwiseOR(large)


def _pairs_of(z: list[int], bonds: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """a, b, distance, code of one molecule; atoms are numbered from 1."""
    n = len(z)
    near: list[list[int]] = [[] for _ in range(n + 1)]
    degree, pi = [0] * (n + 1), [0] * (n + 1)
    for a, b, order in bonds:
        for x, y in {(a, b), (b, a)}:
            near[x].append(y)
            if z[y - 1] != 1:
                degree[x] += 1
                pi[x] += order - 1 if order < 4 else 0
    code = [0] + [((e << 6) & 0x1FC0) | (min(d, 7) << 3) | (min(p, 7) & 7) for e, d, p in zip(z, degree[1:], pi[1:], strict=True)]
    for a in range(1, n + 1):
        if z[a - 1] == 1:
            continue
        seen, newest, distance = {a}, [a], 0
        while newest and distance < MAX_DISTANCE:
            distance += 1
            newest = list(dict.fromkeys(y for x in newest for y in near[x] if y not in seen))
            seen.update(newest)
            for b in newest:
                if b > a and z[b - 1] != 1:
                    small, large = sorted((code[a], code[b]))
                    yield a, b, distance, ((small << 20) & UINT32) | ((distance & 0x3F) << 13) | large


def atom_pairs(molecules: DataFrame, key: str = "mol_id") -> DataFrame:
    """One row per pair of heavy atoms within reach: key, a, b, distance, code.

    molecules: key, atoms, bonds (as parse_sdf gives them; valid ones). Distances are shortest paths over all atoms,
    breadth first, one molecule after the other; those of more than MAX_DISTANCE are left out. Codes are those of
    pair_code and atom_code.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows, out = [], []
            z, a, b, order = (c.to_pylist() for c in batch.columns[1:])
            for i in range(batch.num_rows):
                made = list(_pairs_of(z[i], list(zip(a[i], b[i], order[i], strict=True))))
                rows += [i] * len(made)
                out += made
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["key", "a", "b", "distance", "code"])

    of = lambda column, name: F.transform(column, lambda x: x[name])
    flat = molecules.select(F.col(key).alias("key"), of("atoms", "z"), of("bonds", "a"), of("bonds", "b"), of("bonds", "ord"))
    flat = flat.toDF("key", "z", "ba", "bb", "bo")
    kind = flat.schema["key"].dataType.simpleString()
    return flat.mapInArrow(batches, f"key {kind}, a int, b int, distance int, code long").withColumnRenamed("key", key)


def descriptors(molecules: DataFrame, key: str = "mol_id") -> DataFrame:
    """key, desc: the sorted multiset of pair codes. A molecule without a pair has no row."""
    return atom_pairs(molecules, key).groupBy(key).agg(F.array_sort(F.collect_list("code")).alias("desc"))


def descriptor_to_string(desc: Column) -> Column:
    return F.array_join(F.transform(desc, lambda x: x.cast("string")), ",")


def descriptor_from_string(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(F.split(text, r"\s*,\s*").cast("array<bigint>"))


def descriptor_element(desc: Column, i: int) -> Column:
    """The i-th code from 0, null beyond the end."""
    return F.try_element_at(desc, F.lit(i + 1))


def fold_fingerprint(desc: Column, bits: int = 1024) -> Column:
    """Bits code mod ``bits`` set, as an array of 32-bit words held in longs."""
    words = -(-bits // 32)
    at = F.array_distinct(F.transform(desc, lambda x: F.pmod(x, F.lit(bits))))
    word = lambda w: F.aggregate(
        F.filter(at, lambda x: F.floor(x / 32) == w), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.expr("1L") * F.pow(F.lit(2.0), F.pmod(x, F.lit(32))).cast("long"))
    )
    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word)
