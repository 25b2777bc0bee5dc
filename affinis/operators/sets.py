"""Subsets, set operations, samples and splits by explicit ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import positions


def subset(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the listed ids in the list's order (pos); an id listed twice gives two rows. ids: key and pos."""
    return ids.select(key, "pos").join(rows, key)


def select_rows(rows: DataFrame, ids: DataFrame, key: str = "id", all_found: bool = False) -> DataFrame:
    """Rows whose id is listed, each once; all_found: a listed id without a row is an error."""
    if all_found:
        missing = ids.select(key).join(rows, key, "left_anti").take(1)
        if missing:
            raise ValueError(f"no row with {key} {missing[0][0]}")
    return rows.join(ids.select(key), key, "left_semi")


def difference(rows: DataFrame, without: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(without.select(key), key, "left_anti")


def assert_subset(part: DataFrame, whole: DataFrame, key: str = "id") -> None:
    missing = difference(part, whole, key).take(1)
    if missing:
        raise ValueError(f"{key} {missing[0][0]} is not in the whole")


def merge(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def multiplicative_hash(key: Column, seed: int = 0) -> Column:
    """32-bit order of integer keys that any SQL engine can repeat."""
    return F.pmod((key + seed) * F.lit(2654435761), F.lit(4294967296))


def sample(rows: DataFrame, n: int, key: str = "id", seed: int = 0) -> DataFrame:
    """n rows without replacement, the first in the order of a hash of the key; fails if there are fewer."""
    got = rows.orderBy(multiplicative_hash(F.col(key).cast("long"), seed), key).limit(n)
    have = rows.limit(n).count()
    if have < n:
        raise ValueError(f"{n} of {have} rows")
    return got


def lookup(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """rows with the columns of named that has their key, null if none has."""
    return rows.join(named, key, "left")


def references_and_queries(rows: DataFrame, n_refs: int, n_queries: int, key: str = "id", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Disjoint samples."""
    refs = sample(rows.select(key), n_refs, key, seed)
    return refs, sample(difference(rows.select(key), refs, key), n_queries, key, seed + 1)


def random_pairs(rows: DataFrame, n: int, key: str = "id", seed: int = 0) -> DataFrame:
    """a, b: n pairs with replacement, both ends uniform, drawn as positions and joined to ids."""
    numbered = positions(rows.select(F.col(key).alias("id")), "id", "p")
    total = rows.count()
    spark = rows.sparkSession
    drawn = spark.range(n).select(F.floor(F.rand(seed) * total).alias("pa"), F.floor(F.rand(seed + 1) * total).alias("pb"))
    a, b = numbered.select(F.col("id").alias("a"), F.col("p").alias("pa")), numbered.select(F.col("id").alias("b"), F.col("p").alias("pb"))
    return drawn.join(a, "pa").join(b, "pb").select("a", "b")


def split_even(rows: DataFrame, n: int, order: str = "id") -> DataFrame:
    """part (from 1): n parts in order; the first ones have a row more if the rows don't divide."""
    size, more = divmod(rows.count(), n)
    pos, large = F.col("__pos"), more * (size + 1)
    part = F.when(pos < large, F.floor(pos / (size + 1))).otherwise(more + F.floor((pos - large) / max(size, 1))) + 1
    return positions(rows, order, "__pos").withColumn("part", part.cast("int")).drop("__pos")


def split_slices(rows: DataFrame, per_slice: int, order: str = "id") -> DataFrame:
    """slice (from 0) of per_slice rows each, the last with the rest."""
    return positions(rows, order, "__pos").withColumn("slice", F.expr(f"__pos DIV {per_slice}")).drop("__pos")


def unfinished(queries: DataFrame, finished: DataFrame, start: int, end: int, key: str = "query_id") -> DataFrame:
    """Queries of a range of ids (both ends included) that have no result yet."""
    return queries.where(F.col(key).between(start, end)).join(finished.select(key).distinct(), key, "left_anti")
