"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import materialise


def positions(rows: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """rows with a position from 0 in order of a column: ranges are sorted apart, and their counts (one for each partition) added up."""
    tie = F.xxhash64(*[c for c in rows.columns])  # rows of one key may be many
    ranged = rows.withColumn("__tie", tie).repartitionByRange(order, "__tie").sortWithinPartitions(order, "__tie").drop("__tie")
    local = materialise(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("__at", 33).cast("int")
    counts = sorted(local.groupBy(part.alias("p")).count().collect())
    base, total = [], 0
    for p, n in counts:
        base.append((p, total))
        total += n
    bases = rows.sparkSession.createDataFrame(base, "__p int, __base long")  # a row for each partition
    out = local.join(F.broadcast(bases), part == F.col("__p"))
    return out.withColumn(name, F.col("__base") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__p", "__base")
