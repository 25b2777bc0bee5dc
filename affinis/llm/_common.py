"""What the operators of this subpackage share: reading tables, cutting lineage, bounded samples, memory of workers."""

from __future__ import annotations

import ctypes
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import bounded, discard, fresh, materialise, settled

__all__ = ["bounded", "bounded_share", "discard", "fresh", "give_back", "materialise", "parts_of", "read", "settled", "small_batches", "told", "with_added"]

#: Rows, and bytes, of texts that go to a worker at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Parts that the rows of one key are dealt in; one bit of a long for each.
PARTS = 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: bound the Arrow batches of this session, where they have no lower bound yet."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(re.sub(r"\D.*", "", spark.conf.get(name).lstrip("-")) or 0)
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def give_back() -> None:
    """At the end of a task: the worker goes on to others, so it returns the memory that it no longer needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def with_added(df: DataFrame, ddl: str, names: list[str] | None = None) -> T.StructType:
    """The schema of df (or of these columns of it) and further columns."""
    return T.StructType([df.schema[c] for c in names or df.columns] + T.StructType.fromDDL(ddl).fields)


def _part(by: str) -> Column:
    return F.pmod(F.xxhash64(by, F.lit(41)), F.lit(PARTS)).cast("int")


def parts_of(by: str) -> Column:
    """An aggregate for told(): the parts that a group has rows in, as bits of a long."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _part(by))).alias("parts")


def told(rows: DataFrame, facts: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """rows with the facts of their keys, by a sort-merge join that one key with a large share of the rows does not slow.

    facts has one row for each key, with parts_of(by) over the rows. A key's rows are dealt in parts by a hash of
    ``by``, and its facts go to the parts that have rows: never more copies than there are rows.
    """
    here = lambda p: F.call_function("shiftright", F.col("parts"), p).bitwiseAND(1) == 1
    each = facts.withColumn("__part", F.explode(F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), here))).drop("parts")
    return rows.withColumn("__part", _part(by)).join(each.hint("merge"), [*keys, "__part"], how).drop("__part")


def bounded_share(df: DataFrame, key: str, strata: str | None, bound: int, salt: int = 7) -> DataFrame:
    """Rows of df whose hashed key falls under a threshold chosen so that each stratum keeps about ``bound`` rows.

    The choice depends on the key alone, so it is the same after a retry and in any partitioning; no group is gathered
    to be ranked. At most 1024 strata are accepted.
    """
    unit = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    if strata is None:
        n = df.count()
        return df.where(unit < F.lit(min(1.0, bound / max(n, 1))))
    counts = df.groupBy(strata).count().limit(1025).collect()
    if len(counts) > 1024:
        raise ValueError(f"more than 1024 values of {strata}")
    keep = F.lit(False)
    for row in counts:
        keep = keep | (F.col(strata).eqNullSafe(F.lit(row[0])) & (unit < F.lit(min(1.0, bound / row[1]))))
    return df.where(keep)
