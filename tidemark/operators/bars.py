"""Bars: building, resampling, normalising, gap grids, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import div, epoch_s, finite, floor_ts
from tidemark.operators.frames import prefix

PRICE_COLS = ("open", "high", "low", "close")

# fixed values: accepted names for the standard bar columns
ALIASES = {
    "open_time": "timestamp",
    "timestamp": "timestamp",
    "datetime": "timestamp",
    "date": "timestamp",
    "time": "timestamp",
    "o": "open",
    "h": "high",
    "l": "low",
    "c": "close",
    "v": "volume",
    "vol": "volume",
}


def ticks_to_bars(
    ticks: DataFrame,
    seconds: int,
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts", "event_id"),
    price: str = "price",
    qty: str = "qty",
) -> DataFrame:
    """OHLCV bars of ``seconds`` from ticks; left-closed, labelled by their start, no empty bars."""
    at = F.struct(*order)
    return (
        ticks.withColumn("_bar", floor_ts(order[0], seconds))
        .groupBy(*keys, F.col("_bar").alias("ts"))
        .agg(
            F.min_by(price, at).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, at).alias("close"),
            F.sum(qty).cast("double").alias("volume"),
            F.count(F.lit(1)).alias("trades"),
        )
    )


def resample(bars: DataFrame, seconds: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars of a longer interval: first open, highest high, lowest low, last close, summed volume."""
    return (
        bars.withColumn("_bar", floor_ts("ts", seconds))
        .groupBy(*keys, F.col("_bar").alias("ts"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
    )


def latest_version(df: DataFrame, keys: Sequence[str], version: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key: the newest (or with ``keep='first'`` the oldest) version.

    A ``max_by`` over the whole row is combined before the shuffle, so many
    versions of one key do not meet in one task as a window would have them.
    """
    pick = F.max_by if keep == "last" else F.min_by
    rest = [c for c in df.columns if c not in keys]
    row = pick(F.struct(*rest), F.struct(*version)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def normalize(
    df: DataFrame, keys: Sequence[str] = ("symbol",), required: Sequence[str] = (*PRICE_COLS, "volume")
) -> DataFrame:
    """Standard names and types, NaN and infinities to null, incomplete rows out, one row per key and ts."""
    renames = {c: ALIASES[c.lower()] for c in df.columns if c.lower() in ALIASES and ALIASES[c.lower()] != c}
    df = df.withColumnsRenamed(renames)
    if "timestamp" in df.columns:
        df = df.withColumnRenamed("timestamp", "ts")
    missing = [c for c in ("ts", *required) if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    df = df.withColumns({c: finite(F.col(c).try_cast("double")) for c in required}).dropna(subset=["ts", *required])
    return latest_version(df, [*keys, "ts"], [c for c in df.columns if c not in (*keys, "ts")], keep="first")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("symbol", "ts"), version: str = "load_ts") -> DataFrame:
    """Stored rows with new ones added; of two rows with the same key the later load wins."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in (*keys, version)]
    return latest_version(both, keys, [version, *rest])


def expected_grid(
    bars: DataFrame, seconds: int, keys: Sequence[str] = ("symbol",), spans: DataFrame | None = None
) -> DataFrame:
    """Every bar start between the first and last bar of each key.

    The grid of a key is made in two steps (days, then bars of a day), so one
    key's grid is spread over tasks before it grows.
    """
    spans = bars.groupBy(*keys).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b")) if spans is None else spans
    first, last = F.floor(epoch_s("_a") / seconds), F.floor(epoch_s("_b") / seconds)
    per_slice = max(1, 86_400 // seconds)
    slices = spans.select(
        *keys,
        "_a",
        first.alias("_i"),
        last.alias("_j"),
        F.explode(F.sequence(F.floor(first / per_slice), F.floor(last / per_slice))).alias("_slice"),
    ).repartition(*[F.col(k) for k in keys], F.col("_slice"))
    lo = F.greatest(F.col("_i"), F.col("_slice") * per_slice)
    hi = F.least(F.col("_j"), F.col("_slice") * per_slice + (per_slice - 1))
    step = F.explode(F.sequence(lo, hi)).alias("_k")
    rows = slices.select(*keys, "_a", "_i", step)
    at = F.col("_a") + F.make_dt_interval(secs=((F.col("_k") - F.col("_i")) * seconds).cast("decimal(18,6)"))
    return rows.select(*keys, at.alias("ts"))


def missing_bars(bars: DataFrame, seconds: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bar starts between a key's first and last bar that have no bar."""
    return expected_grid(bars, seconds, keys).join(bars.select(*keys, "ts"), [*keys, "ts"], "left_anti")


def repair_gaps(bars: DataFrame, seconds: int, keys: Sequence[str] = ("symbol",), method: str = "ffill") -> DataFrame:
    """Full grid of bars: gaps filled, high and low widened to hold open and close, filled rows marked.

    ``ffill`` repeats the last bar's prices with volume 0. ``linear`` draws a line between
    the bars on both sides, which looks ahead.
    """
    grid = expected_grid(bars, seconds, keys)
    cols = [*PRICE_COLS, "volume"]
    d = grid.join(bars.select(*keys, "ts", *cols), [*keys, "ts"], "left").withColumn("repaired", F.col("close").isNull())
    had = ~F.col("repaired")
    seen = F.when(had, F.struct("ts", *PRICE_COLS))
    d = prefix(d, {"_before": ("last", seen)}, keys, ["ts"])
    if method == "linear":
        d = d.drop("_chunk").withColumns({"_neg": -epoch_s("ts")})
        back = F.when(had, F.struct("ts", *PRICE_COLS))
        d = prefix(d, {"_after": ("last", back)}, keys, ["_neg"], F.floor(F.col("_neg") / F.lit(30 * 86_400)))
        span = epoch_s("_after.ts") - epoch_s("_before.ts")
        share = div(epoch_s("ts") - epoch_s("_before.ts"), span)
        fill = {
            c: F.coalesce(F.col(c), F.col(f"_before.{c}") + (F.col(f"_after.{c}") - F.col(f"_before.{c}")) * share)
            for c in PRICE_COLS
        }
    else:
        fill = {c: F.coalesce(F.col(c), F.col(f"_before.{c}")) for c in PRICE_COLS}
    d = d.withColumns({**fill, "volume": F.coalesce("volume", F.lit(0.0))})
    high = F.greatest(*PRICE_COLS)
    low = F.least(*PRICE_COLS)
    return d.withColumns({"high": high, "low": low}).select(*keys, "ts", *cols, "repaired")


def coverage(bars: DataFrame, keys: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """Rows, first and last time of each series."""
    return bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def missing_series(coverage_table: DataFrame, symbols: DataFrame, timeframes: DataFrame) -> DataFrame:
    """Expected (symbol, timeframe) pairs without data; both lists are small reference tables."""
    wanted = symbols.select("symbol").distinct().join(timeframes.select("timeframe").distinct(), how="cross")
    return wanted.join(coverage_table, ["symbol", "timeframe"], "left_anti")
