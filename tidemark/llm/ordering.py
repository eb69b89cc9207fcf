"""Places in a total order, without one task for the whole order or for a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

_BITS = 33  # monotonically_increasing_id: partition above, row below


def places(rows: DataFrame, by: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with its place (from 0) in the order of ``by``; rows equal in ``by`` take any of their places.

    Rows are range-partitioned and written sorted; the partitions' counts, one
    row each, give each partition its first place.
    """
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    written = settle(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _BITS).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = written.groupBy(part).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    out = written.withColumn("_part", part).join(F.broadcast(firsts), "_part")
    return out.withColumn(name, F.col("_first") + F.col("_at").bitwiseAND((1 << _BITS) - 1)).drop("_at", "_part", "_first")
