"""Execution analysis on fills grouped into executions (parent orders)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.candles import bps, execution_flags
from tidemark.functions.core import div, epoch_us, ladder, time_chunk
from tidemark.operators.frames import CHUNK, prefix, stored_chunk
from tidemark.operators.reports import grouping_counts
from tidemark.operators.temporal_joins import interval_join


def execution_metrics(fills: DataFrame, by: Sequence[str], order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """One row per execution: quantities, prices, duration, slippage, impact, participation, maker share, venues.

    ``fills`` needs price, quantity, target_quantity, market_volume, fees, is_maker, venue, side, algo.
    """
    at = F.struct(*order)
    d = fills.groupBy(*by).agg(
        F.max("side").alias("side"),
        F.max("algo").alias("algo"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count(F.lit(1)).alias("slices"),
        F.sum("quantity").alias("executed"),
        F.max("target_quantity").alias("target"),
        F.max("market_volume").alias("market_volume"),
        F.sum(F.col("price") * F.col("quantity")).alias("notional"),
        F.sum("fees").alias("fees"),
        F.min_by("price", at).alias("arrival_price"),
        F.avg(F.col("is_maker").cast("double")).alias("maker_ratio"),
        F.count_distinct("venue").alias("venues"),
    )
    d = d.withColumns(
        {
            "fill_rate": F.coalesce(div("executed", "target"), F.lit(0.0)),
            "avg_price": F.coalesce(div("notional", "executed"), F.col("arrival_price")),
            "duration_seconds": (epoch_us("end_ts") - epoch_us("start_ts")) / 1e6,
            "participation": F.coalesce(div("executed", "market_volume"), F.lit(0.0)),
        }
    )
    d = d.withColumn("slippage_bps", bps("avg_price", "arrival_price"))
    d = d.withColumn("impact_bps", F.greatest(F.lit(0.0), F.abs("slippage_bps") - 5))
    d = d.withColumn("flags", execution_flags())
    return d.withColumn("quality_score", quality_score())


def quality_score() -> Column:
    """0..100: fill rate 30, slippage 25, impact 20, participation 10, maker share 10, absence of flags 5."""
    zero = F.lit(0.0)
    p = F.col("participation")
    points = (
        F.col("fill_rate") * 30
        + F.greatest(zero, 25 - F.least(F.lit(25.0), F.abs("slippage_bps") / 2))
        + F.greatest(zero, 20 - F.least(F.lit(20.0), F.col("impact_bps")))
        + F.when(p < 0.05, p * 200).when(p < 0.3, 10.0).otherwise(F.greatest(zero, 10 - (p - 0.3) * 25))
        + F.col("maker_ratio") * 10
        + F.greatest(zero, 5.0 - F.size("flags"))
    )
    return F.greatest(zero, F.least(F.lit(100.0), points))


def ladder_scores(executions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cost, speed, impact and consistency ladders (100 / 80 / 60, then falling) and their weighted mean per group."""
    d = executions.groupBy(*by).agg(
        F.avg(F.abs("slippage_bps")).alias("slippage"),
        F.avg("duration_seconds").alias("seconds"),
        F.avg("impact_bps").alias("impact"),
        F.avg((F.col("executed") > 0).cast("double")).alias("filled"),
        F.stddev_pop("slippage_bps").alias("spread"),
    )
    low = F.lit(20.0)
    s, t, i, v = F.col("slippage"), F.col("seconds"), F.col("impact"), F.col("spread")
    d = d.withColumns(
        {
            "cost_score": F.when(s <= 2, 100.0).when(s <= 5, 80.0).when(s <= 10, 60.0).otherwise(F.greatest(low, 60 - (s - 10) * 2)),
            "speed_score": F.when(t <= 60, 100.0).when(t <= 600, 80.0).when(t <= 1800, 60.0).otherwise(F.greatest(low, 60 - (t - 1800) / 10)),
            "impact_score": F.when(i <= 5, 100.0).when(i <= 15, 80.0).otherwise(F.greatest(low, 80 - (i - 15) * 2)),
            "consistency_score": F.when(v <= 2, 100.0).when(v <= 5, 80.0).otherwise(F.greatest(low, 80 - (v - 5) * 5)),
        }
    )
    total = (
        F.col("cost_score") * 0.3 + F.col("speed_score") * 0.2 + F.col("filled") * 20 + F.col("impact_score") * 0.2 + F.col("consistency_score") * 0.1
    )
    return d.withColumn("overall", total)


def next_tick(ticks: DataFrame, keys: Sequence[str] = ("symbol",), chunk_seconds: int = 3600) -> DataFrame:
    """Add the time of the key's next tick."""
    # backwards in time; stored slices run the other way then
    cut = -F.col(CHUNK) if CHUNK in ticks.columns else -time_chunk("ts", chunk_seconds)
    d = ticks.withColumn("_neg", -epoch_us("ts"))
    return prefix(d, {"next_ts": ("last", F.col("ts"))}, keys, ["_neg"], cut, upto=-1).drop("_neg", CHUNK)


def twap(executions: DataFrame, ticks: DataFrame, by: Sequence[str], start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """Time-weighted price inside each execution's interval, the last price held to its end; the plain mean if no time passes.

    A tick's duration runs to the symbol's next tick and is cut at the interval's end, so no window per execution is needed.
    """
    t = next_tick(ticks.select("symbol", "ts", "price", *stored_chunk(ticks))).select("symbol", "ts", "price", "next_ts")
    d = interval_join(executions.select(*by, start, end), t, start, end)
    held = (F.least(epoch_us(F.coalesce("next_ts", F.col(end))), epoch_us(end)) - epoch_us("ts")).cast("double")
    out = d.withColumn("_w", held).groupBy(*by).agg(
        F.sum(F.col("price") * F.col("_w")).alias("_pw"), F.sum("_w").alias("_w"), F.avg("price").alias("_mean")
    )
    return out.select(*by, F.coalesce(div("_pw", "_w"), F.col("_mean")).alias("twap"))


def vwap(executions: DataFrame, prices: DataFrame, by: Sequence[str], twap_table: DataFrame, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """Volume-weighted price inside each execution's interval, TWAP where there is no volume."""
    d = interval_join(executions.select(*by, start, end), prices.select("symbol", "ts", "price", "volume"), start, end)
    out = d.groupBy(*by).agg(
        F.sum(F.when(F.col("volume").isNotNull(), F.col("price") * F.col("volume"))).alias("_pv"), F.sum("volume").alias("_v")
    )
    joined = twap_table.join(out, list(by), "left")
    return joined.select(*by, F.coalesce(div("_pv", "_v"), F.col("twap")).alias("vwap"))


def cost_breakdown(executions: DataFrame) -> DataFrame:
    """Commission, spread, impact and timing cost in basis points and money (fixed rules)."""
    d = executions.withColumns(
        {
            "commission_bps": F.coalesce(div("fees", "notional"), F.lit(0.0)) * 10_000,
            "spread_bps": F.greatest(F.lit(5.0), F.abs("slippage_bps") * 0.3),
            "timing_bps": F.least(F.lit(10.0), F.col("duration_seconds") / 360),
        }
    )
    d = d.withColumn("total_bps", F.col("commission_bps") + F.col("spread_bps") + F.col("impact_bps") + F.col("timing_bps"))
    return d.withColumn("total_cost", F.col("total_bps") / 10_000 * F.col("notional"))


def tca_report(executions: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Averages by algorithm, hour and so on in one pass, weighted figures by notional."""
    return grouping_counts(
        executions,
        sets,
        [
            F.count(F.lit(1)).alias("executions"),
            F.avg("fill_rate").alias("fill_rate"),
            F.avg("slippage_bps").alias("slippage_bps"),
            div(F.sum(F.col("slippage_bps") * F.col("notional")), F.sum("notional")).alias("weighted_slippage_bps"),
            F.avg("quality_score").alias("quality_score"),
            F.sum("notional").alias("notional"),
            F.sum(F.size("flags")).alias("flags"),
        ],
    )


def volume_curve(bars: DataFrame, slot_minutes: int = 60, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Share of a key's volume per time-of-day slot, with its running share."""
    slot = F.floor((F.hour("ts") * 60 + F.minute("ts")) / slot_minutes)
    d = bars.groupBy(*keys, slot.alias("slot")).agg(F.sum("volume").alias("volume"))
    w = Window.partitionBy(*keys)  # at most one row per slot and key
    share = div(F.col("volume"), F.sum("volume").over(w))
    d = d.withColumn("share", share)
    return d.withColumn("cum_share", F.sum("share").over(w.orderBy("slot")))


def violations(executions: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per limit broken: type, severity, value, limit (fixed limits)."""

    def row(kind, severity, value, limit):
        return F.struct(F.lit(kind).alias("type"), severity.alias("severity"), value.cast("double").alias("value"), F.lit(limit).alias("limit"))

    s, t, f = F.abs("slippage_bps"), F.col("duration_seconds"), F.col("fill_rate")
    found = F.array_compact(
        F.array(
            F.when(s > 50, row("high_slippage", F.when(s > 100, "high").otherwise("medium"), s, 50.0)),
            F.when(t > 300, row("execution_timeout", F.lit("medium"), t, 300.0)),
            F.when(f < 0.9, row("low_fill_rate", F.when(f > 0.7, "medium").otherwise("high"), f, 0.9)),
        )
    )
    return executions.select(*keep, F.inline(found))


def shortfall(executions: DataFrame, benchmark: str) -> DataFrame:
    """Executed price against arrival and a benchmark, in basis points by side, and in money against arrival."""
    d = executions.withColumns(
        {"vs_arrival_bps": bps("avg_price", "arrival_price"), "vs_benchmark_bps": bps("avg_price", benchmark)}
    )
    return d.withColumn("shortfall", F.col("vs_arrival_bps") / 10_000 * F.col("arrival_price") * F.col("executed"))


def grade(score: str) -> Column:
    return ladder(score, [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F")


def cross_venue_spreads(quotes: DataFrame, fee_bps: float = 10.0, min_profit_bps: float = 5.0, limit: int = 10, bucket: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Buy at one venue's ask, sell at another's higher bid in the same bucket; best by profit after both fees.

    Venues of one bucket meet by the equi-key and are few.
    """
    a = quotes.select(*bucket, F.col("venue").alias("buy_venue"), F.col("ask").alias("buy_price"), F.col("ask_qty").alias("_qa"))
    b = quotes.select(*bucket, F.col("venue").alias("sell_venue"), F.col("bid").alias("sell_price"), F.col("bid_qty").alias("_qb"))
    d = a.join(b, list(bucket)).where((F.col("buy_venue") != F.col("sell_venue")) & (F.col("sell_price") > F.col("buy_price")))
    profit = (F.col("sell_price") - F.col("buy_price")) / F.col("buy_price") * 10_000 - 2 * fee_bps
    d = d.withColumns({"profit_bps": profit, "qty": F.least("_qa", "_qb")}).drop("_qa", "_qb")
    return d.where(F.col("profit_bps") >= min_profit_bps).orderBy(F.col("profit_bps").desc(), *bucket, "buy_venue", "sell_venue").limit(limit)
