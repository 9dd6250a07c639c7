"""Numbers for rows in an order, without one task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def numbered(df: DataFrame, order: Sequence, name: str, start: int = 0) -> DataFrame:
    """df with ``name``: the place of each row in a total order, from start.  Ranges of the order are written and numbered apart and moved
    behind the rows of the ranges before; a row per range is what passes through one task."""
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "order-ranges")
    size = 1 << 33  # what that function leaves to each partition
    part = F.shiftright("_at", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # As many rows as there are partitions.
    offsets = F.broadcast(counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))
    joined = ranged.withColumn("_part", part).join(offsets, "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_at") % size + start).drop("_at", "_part", "_before")
