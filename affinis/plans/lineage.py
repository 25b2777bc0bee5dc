"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that this driver has written and not yet deleted, with their sessions.
_tables: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a folder of our own if everything runs in one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file:///tmp/affinis-tables/{sc.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted when the driver ends, or before by discard()."""
    if not _tables:
        atexit.register(_at_end)
    path = f"{shared_dir(spark)}/affinis-{name}-{uuid.uuid4().hex}"
    _tables[path] = spark
    return path


def _delete(path: str) -> None:
    spark = _tables.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _at_end() -> None:
    for path in list(_tables):
        _delete(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote, once what reads them has been written itself."""
    for t in tables:
        _delete(getattr(t, "_table", ""))


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives, as a table; the tables that it wrote on the way are deleted."""
    before = set(_tables)
    out = materialise(make(), name)
    for path in set(_tables) - before - {out._table}:
        _delete(path)
    return out


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """df marked for broadcast, after a check that it has no more rows than that; more are an error, never cut off."""
    few = materialise(df.limit(most + 1), "bounded")
    if few.count() > most:
        raise ValueError(f"more than {most} {what}")
    return F.broadcast(few)
