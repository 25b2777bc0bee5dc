"""Readers: text formats of molecules, id lists, vectors and results, and binary record files, as DataFrames."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END = "$$$$"


def sdf_records(spark: SparkSession, path: str, skip_annotations: bool = False) -> DataFrame:
    """sdf: one row per record that ends with a line that begins with $$$$; a trailing record without one is dropped.

    Lines may end with CR LF; they come out ending with LF. Plain files are split at the marks by the text source, in
    parallel within a file; which pieces are a file's first and last, and whether the last had its mark, is told by
    their places and lengths. A file with the mark's characters elsewhere has its pieces put together again, in one
    task. Compressed files cannot be split and are read whole.
    """
    from ..functions.chemistry import drop_annotations

    packed = r"\.(gz|bz2|zst)$"
    pieces = spark.read.option("lineSep", END).text(path).select(
        F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("value"), F.octet_length("value").alias("bytes"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"),
    ).where(~F.col("file").rlike(packed))
    inside = ~F.col("value").endswith("\n")  # if a mark follows, it is not at the beginning of a line
    files = pieces.groupBy("file").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), (F.sum(F.col("bytes") + len(END)) > F.max("size")).alias("open"), F.count_if(inside).alias("bad"),
        F.max_by(inside, "at").alias("bad_last"), (F.min_by("value", "at") == "").alias("empty_first"),
    )
    odd = F.col("bad") > (F.col("open") & F.col("bad_last")).cast("int") + F.col("empty_first").cast("int")
    placed = pieces.join(files.select("file", "first", "last", "open", odd.alias("odd")), "file").withColumn("unended", F.col("open") & (F.col("at") == F.col("last")))
    rest_of_mark = lambda text, first: F.when(first, text).otherwise(F.regexp_replace(text, r"^[^\n]*\n?", ""))
    plain = placed.where("NOT odd AND NOT unended").select(rest_of_mark(F.col("value"), F.col("at") == F.col("first")).alias("sdf"))
    again = placed.where("odd").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"), F.max("open").alias("open"))
    again = again.select(F.concat(F.array_join(F.transform("p", lambda x: x.value), END), F.when(F.col("open"), "").otherwise(END)).alias("value"))
    whole = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_path").rlike(packed)).select(F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("value"))
    parts = F.split("value", r"(?m)^\$\$\$\$[^\n]*(?:\n|\z)", -1)
    whole = whole.unionByName(again).select(F.explode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("sdf"))
    out = plain.unionByName(whole).where(F.length(F.trim("sdf")) > 0)
    return out.withColumn("sdf", drop_annotations(F.col("sdf"))) if skip_annotations else out


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """file, value: files as wholes, lines ending with LF."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("value"))


def smiles(*_: object) -> DataFrame:
    raise NotImplementedError("SMILES needs a toolkit that is not installed; register a transform for it")


def mol2_records(spark: SparkSession, path: str) -> DataFrame:
    """mol2, name: one row per molecule block; a file must begin with a block."""
    mark = "@<TRIPOS>MOLECULE"
    whole = _whole(spark, path)
    checked = whole.where(F.assert_true(F.ltrim("value").startswith(mark), F.lit("the first line is not @<TRIPOS>MOLECULE")).isNull())
    block = F.explode(F.filter(F.split("value", r"(?=@<TRIPOS>MOLECULE)"), lambda x: x.startswith(mark))).alias("mol2")
    return checked.select(block).withColumn("name", F.trim(F.try_element_at(F.split("mol2", "\n"), F.lit(2))))


def rename_mol2(records: DataFrame, name: str) -> DataFrame:
    """The molecule's name, the second line, replaced by that of a column."""
    lines = F.split("mol2", "\n")
    return records.withColumn("mol2", F.array_join(F.concat(F.slice(lines, 1, 1), F.array(F.col(name)), F.slice(lines, F.lit(3), F.greatest(F.lit(0), F.size(lines) - 2))), "\n"))


def pdb_residues(spark: SparkSession, path: str) -> DataFrame:
    """file, n, chain, residue, residue_id, text: runs of ATOM and HETATM lines with one residue id, in file order.

    Files are read line by line, in parallel within a file; a line's place is its block and its number there, by which the
    lines of a file are sorted on disk where they are many.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", r"\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), place.alias("line"))
    atoms = lines.where(F.col("value").rlike("^(ATOM|HETATM)")).withColumn("residue_id", F.substring("value", 23, 5))
    atoms = atoms.where(F.trim(F.substring("value", 23, 4)).rlike(r"^-?\d+$"))
    w = Window.partitionBy("file").orderBy("line")
    new = F.coalesce((F.col("residue_id") != F.lag("residue_id").over(w)).cast("int"), F.lit(1))
    runs = atoms.withColumn("new", new).withColumn("n", F.sum("new").over(w))
    return runs.groupBy("file", "n").agg(
        F.trim(F.min_by(F.substring("value", 22, 1), "line")).alias("chain"),
        F.trim(F.min_by(F.substring("value", 18, 3), "line")).alias("residue"),
        F.trim(F.min("residue_id")).alias("residue_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x.value), "\n").alias("text"),
    )


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """compound_id: positive integers, parted by white space. Zero is an error."""
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    ids = spark.read.text(path).select(F.explode(words.cast("array<long>")).alias("compound_id"))
    return ids.where(F.assert_true(F.col("compound_id") > 0, F.lit("ids begin at 1")).isNull())


def text_vectors(spark: SparkSession, path: str) -> DataFrame:
    """vec array<double>: one row per line of numbers; all lines must have as many."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"[\s,]+").cast("array<double>").alias("vec"))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().limit(2).collect()
    if len(sizes) > 1:
        raise ValueError("lines have different numbers of columns")
    return rows


def coordinate_records(spark: SparkSession, path: str) -> DataFrame:
    """id, vec: lines of the form ``numbers : id``."""
    parts = F.split("value", r"\s*:\s*")
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim(parts[1]).cast("long").alias("id"), F.split(F.trim(parts[0]), r"\s+").cast("array<double>").alias("vec"))


def query_line(text: str, k: int) -> tuple[list[float], int]:
    """A vector from one line, which may begin with ``/K n`` to ask for n neighbours."""
    words = text.split()
    if words[:1] == ["/K"]:
        k, words = int(words[1]), words[2:]
    return [float(x) for x in words], k


def result_lines(lines: DataFrame, query: str = "query_id", line: str = "line") -> DataFrame:
    """query_id, rank, target_id, dist from lines of ``id:dist id:dist ...``."""
    hit = F.filter(F.split(F.trim(F.col(line)), r"\s+"), lambda x: x != "")
    rows = lines.select(F.col(query).alias("query_id"), F.posexplode(hit).alias("rank", "hit"))
    pair = F.split("hit", ":")
    return rows.select("query_id", (F.col("rank") + 1).alias("rank"), pair[0].cast("long").alias("target_id"), pair[1].cast("double").alias("dist"))


def benchmark_lines(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """query_id, rank, target_id, dist from lines of ``query k id dist id dist ...``; fails if a line has fewer than k."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(words.alias("w"))
    rows = rows.select(F.col("w")[0].cast("long").alias("query_id"), F.col("w")[1].cast("int").alias("k"), F.slice("w", F.lit(3), F.size("w")).alias("rest"))
    if k is not None:
        rows = rows.where(F.assert_true(F.col("k") >= k, F.lit("fewer neighbours are stored than asked for")).isNull())
    n = F.col("k") if k is None else F.lit(k)
    rows = rows.select("query_id", "rest", F.explode(F.sequence(F.lit(1), n)).alias("rank"))
    return rows.select(
        "query_id", "rank", F.element_at("rest", 2 * F.col("rank") - 1).cast("long").alias("target_id"), F.element_at("rest", 2 * F.col("rank")).cast("double").alias("dist")
    )


def weighted_sets(spark: SparkSession, path: str) -> DataFrame:
    """set_id, weight, vec: blocks of a line ``id n`` and n lines ``weight numbers``; one file is read by one task."""

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for text in b.column(0).to_pylist():
                ids, weights, vecs = [], [], []
                lines = iter([x for x in text.split("\n") if x.strip()])
                for head in lines:
                    name, n = head.split()
                    for _ in range(int(n)):
                        w, *v = map(float, next(lines).split())
                        ids.append(name)
                        weights.append(w)
                        vecs.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(weights, pa.float64()), pa.array(vecs, pa.list_(pa.float64()))], names=["set_id", "weight", "vec"])

    return spark.read.text(path, wholetext=True).mapInArrow(parse, "set_id string, weight double, vec array<double>")


def record_file(spark: SparkSession, path: str, rows_per_batch: int = 8192) -> DataFrame:
    """id (from 1 in each file), vec array<float>: files of a header (element size 4, rows, dimension) and float32 rows."""

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for content in b.column(0):
                data = memoryview(content.as_buffer())
                size, n, d = struct.unpack_from("<III", data)
                if size != 4:
                    raise ValueError(f"elements of {size} bytes")
                x = np.frombuffer(data, "<f4", n * d, 12)
                for lo in range(0, n, rows_per_batch):
                    hi = min(lo + rows_per_batch, n)
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo) * d + 1, d), pa.int32()), pa.array(x[lo * d : hi * d]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo + 1, hi + 1)), vec], names=["id", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "id long, vec array<float>")


def descriptor_database(spark: SparkSession, path: str) -> DataFrame:
    """compound_id (from 1), desc: the binary descriptor store, deleted entries (negative sizes) skipped."""

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for content in b.column(0):
                data = memoryview(content.as_buffer())
                if bytes(data[:6]) != b"DESCDB" or data[16] != 4:
                    raise ValueError("not a descriptor store with 4-byte integers")
                at, ids, desc, n = 17, [], [], 0
                while at + 4 <= len(data):
                    (size,) = struct.unpack_from("<i", data, at)
                    at += 4
                    if size >= 0:
                        n += 1
                        ids.append(n)
                        desc.append(np.frombuffer(data, "<u4", size, at).astype(np.int64))
                    at += 4 * abs(size)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(desc, pa.list_(pa.int64()))], names=["compound_id", "desc"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "compound_id long, desc array<long>")
