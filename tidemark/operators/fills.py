"""Filling null values along a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import div, epoch_s
from tidemark.operators.frames import CHUNK, DAY, prefix


def fill_series(df: DataFrame, x: str, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Add ``filled`` (last value), ``back_filled`` (next value, looks ahead) and ``interpolated`` (by time)."""
    seen = F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("v"), F.col(ts).alias("t")))
    d = prefix(df, {"_b": ("last", seen)}, keys, [ts]).drop(CHUNK)
    d = d.withColumn("_neg", -epoch_s(ts))
    seen = F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("v"), F.col(ts).alias("t")))
    d = prefix(d, {"_a": ("last", seen)}, keys, ["_neg"], F.floor(F.col("_neg") / F.lit(30 * DAY))).drop(CHUNK)
    share = div(epoch_s(ts) - epoch_s("_b.t"), epoch_s("_a.t") - epoch_s("_b.t"))
    between = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * share
    return d.withColumns(
        {"filled": F.col("_b.v"), "back_filled": F.col("_a.v"), "interpolated": F.coalesce(F.col(x), between)}
    ).drop("_a", "_b", "_neg")


def null_policy(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """Forward fill per key, then the column's median over the key; columns stay null if all values are."""
    from tidemark.operators.order_stats import exact_quantiles, join_stats

    d = prefix(df, {f"_f_{c}": ("last", F.col(c)) for c in cols}, keys, order).drop(CHUNK)
    for c in cols:
        med = exact_quantiles(df, F.col(c), {f"_m_{c}": 0.5}, keys)
        d = join_stats(d, med, keys)
    return d.withColumns({c: F.coalesce(f"_f_{c}", f"_m_{c}") for c in cols}).drop(
        *[f"_f_{c}" for c in cols], *[f"_m_{c}" for c in cols]
    )
