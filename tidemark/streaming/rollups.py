"""Windowed aggregates that run the same on streams and tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bars import latest_version


def tumbling_bars(ticks: DataFrame, interval: str = "15 minutes", delay: str = "10 minutes", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """OHLCV per symbol and interval; on a stream a bar is final once the watermark passes its end."""
    at = F.struct(*order)
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", interval).alias("w"))
        .agg(
            F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", at).alias("close"), F.sum("qty").cast("double").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def pnl_rollup(trades: DataFrame, interval: str = "1 hour", delay: str = "1 hour", by: Sequence[str] = ("symbol",)) -> DataFrame:
    return (
        trades.withWatermark("ts", delay)
        .groupBy(F.window("ts", interval).alias("w"), *by)
        .agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("trades"))
        .select(F.col("w.start").alias("bucket"), *by, "pnl", "trades")
    )


def sliding_stats(metrics: DataFrame, size: str = "5 minutes", step: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Count, mean and extremes of each metric over overlapping windows."""
    return (
        metrics.withWatermark("ts", delay)
        .groupBy(F.window("ts", size, step).alias("w"), "name")
        .agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
        .select(F.col("w.start").alias("start_ts"), "name", "n", "mean", "low", "high")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Activity sessions: events of a key with no pause of ``gap`` or more."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(key, F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
        .select(key, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "events", "total")
    )


def latest_state(ticks: DataFrame, cols: Sequence[str], key: str = "symbol", order: Sequence[str] = ("ts", "event_id"), keep: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Last row per key and span of ``keep`` (update mode); ``newest`` gives the last of all.

    State is one row per key and span and goes when the watermark has passed the span, so a key that is idle holds none.
    """
    at = F.struct(*order)
    last = F.max_by(F.struct(*order, *[c for c in cols if c not in order]), at).alias("_r")
    return ticks.withWatermark("ts", delay).groupBy(F.window("ts", keep), key).agg(last).select(key, "_r.*")


def newest(updates: DataFrame, key: str = "symbol", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Last row of each key among the updates of all batches."""
    return latest_version(updates, [key], list(order)).drop("batch_id")


def keep_updates(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for update mode: each batch's changed rows in a folder of their own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/b{batch_id}")

    return write


def merged(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key from the batches of ``keep_updates``."""
    return latest_version(updates, keys, ["batch_id"]).drop("batch_id")
