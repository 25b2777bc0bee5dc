"""Structured Streaming: coordinates, lookups and refinement as stateless streams, and incremental additions.

Nothing here keeps state: each micro-batch is a batch query against static tables, so late data and watermarks do not
arise, and a restarted query goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.measures import l2
from ..operators.embedding import MAX_REFERENCES, embed
from ..operators.lsh_index import LshParams, build_index, build_probes, search
from ..plans.lineage import bounded


def coordinates(stream: DataFrame, references: np.ndarray, key: str = "id", column: str = "dists") -> DataFrame:
    """Stream of id, dists -> stream of id, vec."""
    return embed(stream, references, key, column)


def bucket_hits(queries: DataFrame, index: DataFrame, params: LshParams, probes: int, key: str = "id", vec: str = "vec") -> DataFrame:
    """Stream of queries joined to a static index: (query_id, tbl, depth, bucket, id); an item may come more than once."""
    return build_probes(queries, params, probes, key, vec).join(index, ["tbl", "bucket"])


def compare_to_references(stream: DataFrame, references: DataFrame, distance: Callable[[Column, Column], Column] = l2, key: str = "id", value: str = "vec") -> DataFrame:
    """Stream of id, value -> id, ref_id, dist against a bounded set of references (checked), broadcast."""
    refs = bounded(references.select(F.col(key).alias("ref_id"), F.col(value).alias("__r")), MAX_REFERENCES, "references")
    return stream.crossJoin(refs).select(F.col(key), "ref_id", distance(F.col(value), F.col("__r")).alias("dist"))


def answer(
    queries: DataFrame, items: DataFrame, index: DataFrame, params: LshParams, k: int, probes: int, target: str, checkpoint: str,
    distance: Callable[[Column, Column], Column] = l2, key: str = "id", vec: str = "vec", available_now: bool = True,
) -> StreamingQuery:
    """Answer a stream of queries (id, vec): candidates from the index, the k best by the exact distance, appended to the table at target.

    A batch that is run again after a failure writes its own folder anew, so no answer is doubled.
    """

    def batch(rows: DataFrame, n: int) -> None:
        search(rows, items, params, k, probes, index, key, vec, distance).write.mode("overwrite").parquet(f"{target}/batch={n}")

    writer = queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def add_to_index(stream: DataFrame, params: LshParams, index_path: str, items_path: str, checkpoint: str, key: str = "id", vec: str = "vec", available_now: bool = True) -> StreamingQuery:
    """Append new items (id, vec) and their buckets; what is there stays as it is."""

    def batch(rows: DataFrame, n: int) -> None:
        rows.select(F.col(key).alias("id"), F.col(vec).alias("vec")).write.mode("overwrite").parquet(f"{items_path}/batch={n}")
        build_index(rows, params, key, vec).write.mode("overwrite").parquet(f"{index_path}/batch={n}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
