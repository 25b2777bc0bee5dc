"""Writers: text and binary forms of ids, results, matrices and descriptors, and the compound store."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chemistry import descriptors, parse_sdf
from ..operators.search import matrix


def write_id_list(ids: DataFrame, path: str, append: bool = False) -> None:
    ids.select(F.col(ids.columns[0]).cast("string")).write.mode("append" if append else "overwrite").text(path)


def result_text(results: DataFrame, n: int | None = None) -> DataFrame:
    """query_id, line ``id:dist id:dist ...`` by ascending distance, of n hits at most."""
    rows = results if n is None else results.where(F.col("rank") <= n)
    hits = F.transform(F.array_sort(F.collect_list(F.struct("rank", "target_id", "dist"))), lambda x: F.concat_ws(":", x.target_id.cast("string"), x.dist.cast("string")))
    return rows.groupBy("query_id").agg(F.array_join(hits, " ").alias("line"))


def dense_rows(distances: DataFrame) -> DataFrame:
    """left_id, dists: the distances of a row in order of right_id."""
    return distances.groupBy("left_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("right_id", "dist"))), lambda x: x.dist).alias("dists"))


def matrix_text(distances: DataFrame, separator: str = " ") -> DataFrame:
    """left_id, line: rows of a distance matrix with six significant digits."""
    return row_text(dense_rows(distances), separator)


def row_text(rows: DataFrame, separator: str = " ") -> DataFrame:
    """left_id, line: dists of each row (as dense_rows() or search.distance_rows() give them) with six significant digits."""

    def digits(x: Column) -> Column:
        scale = F.pow(F.lit(10.0), 5 - F.floor(F.log10(F.abs(x))))
        return F.regexp_replace(F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale).cast("string"), r"\.0$", "")

    return rows.select("left_id", F.array_join(F.transform("dists", digits), separator).alias("line"))


def to_float_vectors(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    return vectors.withColumn(vec, F.col(vec).cast("array<float>"))


#: Bytes of a record file, about.
RECORD_FILE_BYTES = 64 << 20


def write_record_file(vectors: DataFrame, path: str, vec: str = "vec", order: str = "id") -> None:
    """Record files, one for each range of ``order``: a header (element size 4, rows, dimension) and float32 rows.

    A file is about RECORD_FILE_BYTES, whatever the number of rows; a line feed, which no reader counts, ends it, as
    Spark's text writer commits it (the cast to string doesn't check the bytes). Vectors must have one dimension.
    """
    n, size = vectors.agg(F.count(vec), F.max(F.size(vec))).first()

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [matrix(b.column(0)).astype("<f4") for b in it if b.num_rows]
        if rows:
            x = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array([struct.pack("<III", 4, *x.shape) + x.tobytes()], pa.binary())], names=["content"])

    files = max(1, -(-(n * (size or 0) * 4) // RECORD_FILE_BYTES))
    ranged = vectors.where(F.col(vec).isNotNull()).select(order, vec).repartitionByRange(files, order).sortWithinPartitions(order)
    made = ranged.select(F.col(vec).cast("array<float>")).mapInArrow(packed, "content binary")
    made.select(F.col("content").cast("string").alias("value")).write.mode("overwrite").text(path)


def build_descriptor_store(records: DataFrame, path: str, sdf: str = "sdf", key: str = "compound_id") -> tuple[int, DataFrame]:
    """Parse, describe and write key, name, desc; returns how many were stored, as read again, and the records left out.

    A record that cannot be parsed, or that has no pair of heavy atoms, is left out and does not stop the others.
    """
    spark = records.sparkSession
    parsed = parse_sdf(records, sdf)
    good = parsed.where("valid")
    stored = good.select(key, "name").join(descriptors(good, key), key)
    stored.write.mode("overwrite").parquet(path)
    again = spark.read.parquet(path)
    return again.count(), records.join(again.select(key), key, "left_anti")


def open_store(spark: SparkSession, path: str, mode: str = "r") -> DataFrame | None:
    """r: the table; w: nothing, the next write replaces; a: the table, the next write appends."""
    if mode not in ("r", "i", "m", "w", "a"):
        raise ValueError(f"mode {mode!r}")
    return None if mode == "w" else spark.read.parquet(path)


def store(rows: DataFrame, path: str, mode: str) -> None:
    if mode not in ("w", "a"):
        raise ValueError("the store is open for reading")
    rows.write.mode("overwrite" if mode == "w" else "append").parquet(path)


def index_path(root: str, fingerprint: str, width: float, hash_size: int, projections: int, tables: int, seed: int) -> str:
    """Where an index belongs: by the vectors it is of and all that its tables depend on."""
    return f"{root}/{fingerprint}-{width}-{hash_size}-{projections}-{tables}-{seed}"


def fingerprint(vectors: DataFrame, key: str = "id", vec: str = "vec") -> str:
    """A digest of all rows that does not depend on their order."""
    row = vectors.agg(F.count("*"), F.bit_xor(F.xxhash64(F.col(key), F.col(vec).cast("array<double>")))).first()
    return f"{row[0]:x}-{(row[1] or 0) & 0xFFFFFFFFFFFFFFFF:016x}"


def save_index_table(index: DataFrame, name: str, buckets: int = 64) -> DataFrame:
    """Keep an index (tbl, bucket, id) as a table bucketed by its join key, so that a lookup shuffles the probes alone."""
    index.write.mode("overwrite").bucketBy(buckets, "tbl", "bucket").sortBy("tbl", "bucket").saveAsTable(name)
    return index.sparkSession.table(name)
