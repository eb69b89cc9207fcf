"""Consistency of signals, positions and executions that belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import epoch_us, ladder


def reconcile_score(
    signals: DataFrame,
    positions: DataFrame,
    executions: DataFrame,
    max_bps: float = 50.0,
    max_seconds: float = 60.0,
    max_qty_share: float = 0.1,
) -> DataFrame:
    """Score every position 0..100: penalties for missing links, symbol, side, price, timing and size."""
    s = signals.select("key", *[F.col(c).alias(f"s_{c}") for c in ("symbol", "side", "price", "ts")])
    e = executions.select("key", F.col("qty").alias("e_qty"))
    d = positions.join(s, "key", "left").join(e, "key", "left")
    bps = F.abs(F.col("price") - F.col("s_price")) / F.col("s_price") * 1e4
    seconds = F.abs(epoch_us("ts") - epoch_us("s_ts")) / 1e6
    size = F.abs(F.col("e_qty") - F.col("qty")) / F.when(F.col("qty") != 0, F.col("qty"))

    def penalty(cond, points):
        return F.when(cond, points).otherwise(F.lit(0.0))

    lost = (
        penalty(F.col("s_symbol").isNull(), F.lit(50.0))
        + penalty(F.col("e_qty").isNull(), F.lit(30.0))
        + penalty(F.col("s_symbol") != F.col("symbol"), F.lit(20.0))
        + penalty(F.col("s_side") != F.col("side"), F.lit(30.0))
        + penalty(bps > max_bps, F.least(F.lit(20.0), (bps - max_bps) / 10))
        + penalty(seconds > max_seconds, F.least(F.lit(15.0), (seconds - max_seconds) / 60))
        + penalty(size > max_qty_share, F.lit(10.0))
    )
    score = F.greatest(F.lit(0.0), 100.0 - lost)
    level = ladder("score", [(95, "excellent"), (85, "good"), (70, "fair")], "poor")
    return d.select("key", "symbol", score.alias("score")).withColumn("level", level)
