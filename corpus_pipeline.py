"""From raw documents to shards in training order: quality, near-duplicates, benchmark passages, source mix, shards.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of
documents; the last writes the shards and returns what they hold. docs is a plain scan of a written table, which gives
the same rows in the same places each time. Of rows that repeat an id and a text one stays, as of other duplicates; a
null id is an id like any other. A null or empty text is scored by the quality model's bias, is a duplicate of equal
texts only, is not contaminated, has a phase in the mixture, and adds nothing to the shards. A stage given no rows
returns none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import decontaminate, mixing, near_dup, quality, training_order
from affinis.llm._common import discard, read, settled


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels outside the held-out fifth."""
    labels = read(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = quality.fit(docs.select("doc_id", "text"), labels)
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row stays: that of the smallest doc_id, a null one last, and of rows that share it the first.

    Rows are told apart by their place in docs, a plain scan, so repeated and null ids are decided like any others.
    """
    rows = docs.withColumn("__row", F.monotonically_increasing_id())

    def gone() -> DataFrame:
        classes = near_dup.classes(rows, key="__row").select("__row", "class_id")
        ids = rows.select("__row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row").alias("at"))
        members = classes.join(ids.hint("merge"), "__row")
        stays = members.groupBy("class_id").agg(F.min("at").alias("first")).select(F.col("first.__row").alias("__row"))
        return classes.select("__row").join(stays.hint("merge"), "__row", "left_anti")

    return rows.join(settled(gone, "gone"), "__row", "left_anti").select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    found = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.where("NOT contaminated").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, and are told their phase of the mixture, by which the shards are ordered.

    No weights are asked for, so what a large source has beyond its default one comes in later phases. Where these begin
    goes with the column source, as metadata, since a stage returns the columns of documents.
    """
    return mixing.in_phases(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in training order, phase after phase of the mixture; docs is a written table, so its scan is the same twice."""
    return training_order.training_order(docs.select("doc_id", "text", mixing.phase(docs).alias("phase")), fixed=True, phase="phase")


STAGES = [
    ("quality", quality_filter),
    ("near-dup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("mixing", source_mix),
    ("training-order", shards),
]

#: The quality model and the signatures are not to be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
