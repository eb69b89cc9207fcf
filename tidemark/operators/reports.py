"""Reporting aggregates over fills, trades, alerts, logs and metrics.

All are hash aggregates that combine before the shuffle; running columns are
computed on the rolled-up rows, never on the raw ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import (
    all_of,
    col,
    div,
    epoch_s,
    floor_ts,
    period_start,
    sample_kurtosis,
    sample_skewness,
)
from tidemark.operators.order_stats import exact_order_statistic, exact_quantiles, join_stats
from tidemark.sources.scan import as_ts

SEVERITIES = ("INFO", "WARNING", "ERROR", "CRITICAL")  # fixed values, rising order


def pnl_timeseries(trades: DataFrame, unit: str = "day", by: Sequence[str] = ("symbol",)) -> DataFrame:
    return (
        trades.withColumn("bucket", period_start("ts", unit))
        .groupBy("bucket", *by)
        .agg(F.sum("pnl").alias("pnl"), F.sum("commission").alias("commission"), F.count(F.lit(1)).alias("trades"))
    )


def profit_factor(pnl: str | Column = "pnl", kind: str = "sums") -> Column:
    """Aggregate: ``sums`` = wins / |losses|, ``extremes`` = best / |worst|, ``net`` = net / -net losses."""
    x = col(pnl)
    wins, losses = F.sum(F.when(x > 0, x)), F.abs(F.sum(F.when(x < 0, x)))
    if kind == "extremes":
        return div(F.max(x), F.abs(F.min(x)))
    if kind == "net":
        return div(F.sum(x), losses)
    return div(wins, losses)


def pnl_summary(trades: DataFrame, as_of: str, days: Sequence[int] = (1, 7, 30), by: Sequence[str] = ()) -> DataFrame:
    """Totals, win rate in percent, best and worst trade, both profit factors, profit of the last N days."""
    at = as_ts(as_of)
    recent = [
        F.coalesce(
            F.sum(F.when((F.col("ts") > at - F.expr(f"interval {d} days")) & (F.col("ts") <= at), F.col("pnl"))),
            F.lit(0.0),
        ).alias(f"pnl_{d}d")
        for d in days
    ]
    n = F.count(F.lit(1))
    return trades.groupBy(*by).agg(
        F.sum("pnl").alias("total_pnl"),
        F.sum("commission").alias("commission"),
        n.alias("trades"),
        (F.count_if(F.col("pnl") > 0) * 100.0 / n).alias("win_rate"),
        F.max("pnl").alias("best"),
        F.min("pnl").alias("worst"),
        profit_factor("pnl").alias("profit_factor"),
        profit_factor("pnl", "extremes").alias("profit_factor_extremes"),
        *recent,
    )


def pnl_by(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return trades.groupBy(*by).agg(
        n.alias("trades"),
        F.count_if(F.col("pnl") > 0).alias("wins"),
        (F.count_if(F.col("pnl") > 0) * 100.0 / n).alias("win_rate"),
        F.sum("pnl").alias("pnl"),
        F.avg("pnl").alias("avg_pnl"),
    )


def volume_analysis(fills: DataFrame, unit: str = "month", by: Sequence[str] = ("symbol",)) -> DataFrame:
    return (
        fills.withColumn("bucket", period_start("ts", unit))
        .groupBy("bucket", *by)
        .agg(
            F.sum("quantity").alias("quantity"),
            F.sum("notional").alias("notional"),
            F.count(F.lit(1)).alias("fills"),
            F.avg("price").alias("avg_price"),
            F.min("price").alias("min_price"),
            F.max("price").alias("max_price"),
            F.sum("commission").alias("commission"),
        )
    )


def trade_stats(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, extremes and sample standard deviation of trade profit."""
    x = F.col("pnl")
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(x > 0).alias("wins"),
        F.count_if(x < 0).alias("losses"),
        F.avg(x).alias("avg_pnl"),
        F.avg(F.when(x > 0, x)).alias("avg_win"),
        F.avg(F.when(x < 0, x)).alias("avg_loss"),
        F.max(x).alias("best"),
        F.min(x).alias("worst"),
        F.stddev_samp(x).alias("std_pnl"),
        F.sum("commission").alias("commission"),
        F.avg("holding_days").alias("avg_holding"),
    )


def returns_by_period(trades: DataFrame, unit: str) -> DataFrame:
    """Profit per day, week or month with the mean and deviation of its trades."""
    return (
        trades.withColumn("period", period_start("ts", unit))
        .groupBy("period")
        .agg(
            F.sum("pnl").alias("pnl"),
            F.count(F.lit(1)).alias("trades"),
            F.avg("ret_pct").alias("avg_return"),
            F.stddev_samp("ret_pct").alias("std_return"),
        )
    )


def alert_stats(alerts: DataFrame, unit: str = "day") -> DataFrame:
    """Alerts per bucket with one column per severity, and how many are still open."""
    counted = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]
    return (
        alerts.withColumn("bucket", period_start("ts", unit))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("alerts"), F.count_if(~F.col("resolved")).alias("active"), *counted)
    )


def alert_sources(alerts: DataFrame) -> DataFrame:
    """Alerts per (source, severity) and per source, with rate per hour of the source's time span."""
    hours = F.greatest((F.max(epoch_s("ts")) - F.min(epoch_s("ts"))) / 3600.0, F.lit(1.0))
    return alerts.groupingSets(
        [[F.col("source"), F.col("severity")], [F.col("source")]], F.col("source"), F.col("severity")
    ).agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count_if("resolved").alias("resolved"),
        (F.count(F.lit(1)) / hours).alias("per_hour"),
    )


def position_snapshots(positions: DataFrame, limit: int = 100) -> DataFrame:
    """Newest snapshots: market value and unrealised profit per (ts, symbol)."""
    return (
        positions.groupBy("ts", "symbol")
        .agg(
            F.sum("market_value").alias("market_value"),
            F.sum("unrealized").alias("unrealized"),
            F.count(F.lit(1)).alias("positions"),
        )
        .orderBy(F.col("ts").desc(), "symbol")
        .limit(limit)
    )


def pnl_curve_rollup(trades: DataFrame, unit: str = "day", by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Profit per bucket and its running total; the window sees one row per bucket and key."""
    d = trades.withColumn("bucket", period_start("ts", unit)).groupBy("bucket", *by).agg(F.sum("pnl").alias("pnl"))
    w = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("cum_pnl", F.sum("pnl").over(w))


def mergeable_rollup(df: DataFrame, x: str, unit: str, by: Sequence[str]) -> DataFrame:
    """Partials that can be added up again: count, sum, min, max per bucket."""
    return (
        df.withColumn("bucket", period_start("ts", unit))
        .groupBy("bucket", *by)
        .agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"))
    )


def merge_rollup(partials: DataFrame, unit: str, by: Sequence[str]) -> DataFrame:
    """Roll partials of ``mergeable_rollup`` up to a longer bucket."""
    return (
        partials.withColumn("bucket", period_start("bucket", unit))
        .groupBy("bucket", *by)
        .agg(
            F.sum("n").alias("n"),
            (F.sum("total") / F.sum("n")).alias("mean"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
        )
    )


def last_in_bucket(
    df: DataFrame, cols: Sequence[str], unit: str, by: Sequence[str], order: Sequence[str] = ("ts",)
) -> DataFrame:
    """Last value of each column in each bucket."""
    at = F.struct(*order)
    return (
        df.withColumn("bucket", period_start("ts", unit))
        .groupBy("bucket", *by)
        .agg(*[F.max_by(c, at).alias(c) for c in cols])
    )


def multi_grain_rollup(df: DataFrame, x: str, grains: dict[str, int], by: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row per grain and bucket; the short grain is aggregated once and the longer ones are built from it."""
    names = sorted(grains, key=grains.get)
    finest = names[0]
    base = (
        df.withColumn("bucket", floor_ts("ts", grains[finest]))
        .groupBy(*by, "bucket")
        .agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.min(x).alias("low"), F.max(x).alias("high"))
    )
    spans = F.array(
        *[F.struct(F.lit(g).alias("grain"), floor_ts("bucket", grains[g]).alias("start")) for g in names]
    )
    return (
        base.withColumn("_g", F.explode(spans))
        .groupBy(*by, F.col("_g.grain").alias("grain"), F.col("_g.start").alias("bucket"))
        .agg(
            F.sum("n").alias("n"),
            F.sum("total").alias("total"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
        )
    )


def grouping_counts(df: DataFrame, sets: Sequence[Sequence[str]], aggs: Sequence[Column]) -> DataFrame:
    """Several groupings in one pass; columns outside a row's grouping are null, ``grouping`` names it."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    label = F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in names])
    d = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    return d.agg(label.alias("grouping"), *aggs)


def metric_summary(metrics: DataFrame, start: str, end: str, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Per metric in a time range: count, extremes, mean, latest, exact percentiles, nearest-rank p95."""
    d = metrics.where((F.col("ts") >= as_ts(start)) & (F.col("ts") <= as_ts(end)))
    basics = d.groupBy("name").agg(
        F.count("value").alias("n"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.avg("value").alias("mean"),
        F.max_by("value", F.struct(*order)).alias("latest"),
    )
    q = exact_quantiles(d, F.col("value"), {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, ["name"])
    index = F.least(F.floor(F.col("_total") * F.lit(0.95)), F.col("_total") - 1)
    nearest = exact_order_statistic(d, F.col("value"), index, ["name"], "p95_nearest")
    return join_stats(join_stats(basics, q, ["name"]), nearest, ["name"])


def counter_rate(metrics: DataFrame, by: Sequence[str] = ("name",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """(last - first) / elapsed seconds of a counter."""
    at = F.struct(*order)
    d = metrics.groupBy(*by).agg(
        (F.max_by("value", at) - F.min_by("value", at)).alias("delta"),
        (F.max(epoch_s("ts")) - F.min(epoch_s("ts"))).alias("seconds"),
    )
    return d.withColumn("rate", div("delta", "seconds"))


def hourly_profile(bars: DataFrame) -> DataFrame:
    """Mean volume, range and move by hour of day, scaled by the symbol's best hour and scored.

    ``bars`` needs a return column ``ret``. At most 24 rows per symbol reach the window.
    """
    d = (
        bars.withColumn("hour", F.hour("ts"))
        .groupBy("symbol", "hour")
        .agg(
            F.avg("volume").alias("volume"),
            F.avg(F.col("high") / F.col("low") - 1).alias("range"),
            F.avg(F.abs("ret")).alias("move"),
        )
    )
    w = Window.partitionBy("symbol")
    score = (div("volume", F.max("volume").over(w)) + div("range", F.max("range").over(w))) / 2
    d = d.withColumn("score", score)
    rank = F.row_number().over(w.orderBy(F.col("score").desc(), "hour"))
    return d.withColumn("best", rank <= 6)


def time_pattern_scores(trades: DataFrame, sets: Sequence[Sequence[str]], min_trades: int = 3) -> DataFrame:
    """Score of every session, weekday and hour with enough trades (population deviation, 0 counts as 1)."""
    win = F.count_if(F.col("pnl_pct") > 0) * 100.0 / F.count(F.lit(1))
    d = grouping_counts(
        trades,
        sets,
        [
            F.count(F.lit(1)).alias("trades"),
            win.alias("win_rate"),
            F.avg("pnl_pct").alias("avg_profit"),
            F.avg("holding_minutes").alias("avg_holding"),
            F.stddev_pop("pnl_pct").alias("_std"),
        ],
    ).where(F.col("trades") >= min_trades)
    vol = F.when(F.col("_std") > 0, F.col("_std")).otherwise(1.0)
    zero = F.lit(0.0)
    score = (
        F.col("win_rate") * 0.4
        + F.greatest(zero, F.col("avg_profit") * 10) * 0.3
        + F.greatest(zero, (90 - F.col("avg_holding")) / 90 * 100) * 0.2
        + F.greatest(zero, (2 - vol) / 2 * 100) * 0.1
    )
    d = d.withColumns({"score": score, "confidence": F.least(F.lit(1.0), F.col("trades") / 20.0)}).drop("_std")
    rank = F.row_number().over(Window.partitionBy("grouping").orderBy(F.col("score").desc(), *sum(map(list, sets), [])))
    return d.withColumn("rank", rank)


def vol_stats(df: DataFrame, bars_per_day: int, x: str = "ret", by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Volatility scaled to day, week and month, mean, bias-corrected skewness and kurtosis."""
    s = F.stddev_samp(x)
    return df.groupBy(*by).agg(
        (s * bars_per_day**0.5).alias("daily_vol"),
        (s * (bars_per_day * 7) ** 0.5).alias("weekly_vol"),
        (s * (bars_per_day * 30) ** 0.5).alias("monthly_vol"),
        F.avg(x).alias("mean_return"),
        sample_skewness(x).alias("skewness"),
        sample_kurtosis(x).alias("kurtosis"),
    )


def liquidity_tiers(bars: DataFrame, unit_volume: float = 1_000_000.0, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Tier by mean volume times its steadiness (1 - deviation / mean), capped at 1."""
    d = bars.groupBy(*by).agg(F.avg("volume").alias("avg_volume"), F.stddev_samp("volume").alias("_s"))
    steady = F.when(F.col("avg_volume") > 0, 1 - div("_s", "avg_volume")).otherwise(0.0)
    d = d.withColumn("consistency", steady).drop("_s")
    d = d.withColumn("score", F.least(F.lit(1.0), F.col("avg_volume") / unit_volume * F.col("consistency")))
    tier = F.when(F.col("score") > 0.8, "high").when(F.col("score") > 0.5, "medium").otherwise("low")
    return d.withColumn("tier", tier)


def symbol_pivot(df: DataFrame, symbols: Sequence[str], x: str = "close", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Time by symbol matrix of the last value; the column list is given, not collected."""
    at = F.struct(*order)
    return df.groupBy("ts").agg(*[F.max_by(F.when(F.col("symbol") == s, F.col(x)), F.when(F.col("symbol") == s, at)).alias(s) for s in symbols])


def monthly_return_pivot(daily: DataFrame, ret: str = "ret", ts: str = "ts") -> DataFrame:
    """Compounded return per year and month, months as columns m1..m12; returns at or below -1 are left out."""
    r = F.col(ret)
    grown = F.sum(F.when(r > -1, F.log1p(r)))
    m = daily.groupBy(F.year(ts).alias("year"), F.month(ts).alias("_m")).agg((F.exp(grown) - 1).alias("_r"))
    return m.groupBy("year").agg(*[F.max(F.when(F.col("_m") == k, F.col("_r"))).alias(f"m{k}") for k in range(1, 13)])


def execution_venues(fills: DataFrame) -> DataFrame:
    """Distinct venues, maker share and volume-weighted price (notional summed in cents) of each order."""
    return fills.groupBy("order_id").agg(
        F.count_distinct("venue").alias("venues"),
        F.avg(F.col("is_maker").cast("double")).alias("maker_ratio"),
        (F.sum(F.round(F.col("notional") * 100)) / F.sum("quantity") / 100).alias("vwap"),
    )


def loss_patterns(trades: DataFrame, top: int = 3) -> DataFrame:
    """Hours with most losing trades per symbol, their loss, and mean holding of losers against winners."""
    lost = F.col("pnl") < 0
    d = trades.groupBy("symbol", F.hour("ts").alias("hour")).agg(
        F.count_if(lost).alias("losses"),
        F.sum(F.when(lost, F.col("pnl"))).alias("loss"),
        (F.avg(F.when(lost, F.col("holding_minutes"))) - F.avg(F.when(~lost, F.col("holding_minutes")))).alias(
            "holding_gap"
        ),
    )
    w = Window.partitionBy("symbol").orderBy(F.col("losses").desc(), "hour")  # 24 rows per symbol
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def yearly_evolution(trades: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Win rate per year with its slope over years, one row per year and key."""
    y = trades.groupBy(*by, F.year("ts").alias("year")).agg(
        F.count(F.lit(1)).alias("trades"), (F.count_if(F.col("pnl") > 0) * 1.0 / F.count(F.lit(1))).alias("win_rate")
    )
    w = Window.partitionBy(*by)
    return y.withColumn("slope", F.regr_slope("win_rate", "year").over(w))


def union_counts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row count and newest time of several tables, stacked."""
    parts = [
        df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.max(ts).alias("last_ts"))
        for name, (df, ts) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def portfolio_exposure(positions: DataFrame) -> DataFrame:
    """Exposure share of each symbol beside gross, long, short and net totals (one row per symbol in)."""
    mv = F.col("market_value")
    total = positions.agg(
        F.sum(F.abs(mv)).alias("gross"),
        F.coalesce(F.sum(F.when(mv > 0, mv)), F.lit(0.0)).alias("long"),
        F.coalesce(F.sum(F.when(mv < 0, -mv)), F.lit(0.0)).alias("short"),
        F.max(F.abs(mv)).alias("_top"),
    )
    d = join_stats(positions.select("symbol", "market_value"), total, [])
    return d.withColumns(
        {
            "net": F.col("long") - F.col("short"),
            "share_pct": div(F.abs("market_value") * 100, "gross"),
            "largest_pct": div(F.col("_top") * 100, "gross"),
        }
    ).drop("_top")


def log_metrics(logs: DataFrame, value_cols: Sequence[str] = ("value",)) -> DataFrame:
    """(name, ts, value) rows from log records: one per numeric field, named level.component.field."""
    fields = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in value_cols])
    d = logs.withColumn("_x", F.explode(fields))
    name = F.lower(F.concat_ws(".", "level", "component", "_x.f"))
    return d.select(name.alias("name"), "ts", F.col("_x.v").alias("value"))


def dynamic_filter(
    df: DataFrame,
    equals: dict[str, object | None],
    start: str | None = None,
    end: str | None = None,
    order: Sequence[str] = ("ts",),
    page: int = 1,
    page_size: int = 100,
    upper: Sequence[str] = ("symbol", "side"),
) -> DataFrame:
    """Optional equality and time filters (None = not set), newest first, one page. Values are literals, never text.

    Values of the columns in ``upper``, which hold upper-case codes, may be given in any case.
    """
    preds = [F.col(k) == F.lit(v.upper() if k in upper and isinstance(v, str) else v) for k, v in equals.items() if v is not None]
    if start is not None:
        preds.append(F.col("ts") >= as_ts(start))
    if end is not None:
        preds.append(F.col("ts") <= as_ts(end))
    d = df.where(all_of(preds)).orderBy(*[F.col(c).desc() for c in order])
    return d.offset((page - 1) * page_size).limit(page_size)


def log_search(
    logs: DataFrame,
    as_of: str,
    since_minutes: int,
    level: str | None = None,
    component: str | None = None,
    contains: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """Newest matching log lines of the last N minutes."""
    at = as_ts(as_of)
    preds = [F.col("ts") > at - F.expr(f"interval {since_minutes} minutes"), F.col("ts") <= at]
    if level:
        preds.append(F.col("level") == level.upper())
    if component:
        preds.append(F.col("component") == component)
    if contains:
        preds.append(F.contains(F.lower("message"), F.lit(contains.lower())))
    return logs.where(all_of(preds)).orderBy(F.col("ts").desc(), F.col("log_id").desc()).limit(limit)


def extremes(df: DataFrame, x: str, n: int, tie: Sequence[str]) -> DataFrame:
    """Top and bottom n rows by ``x``; each side is a bounded top-n that combines before it is gathered."""
    best = df.orderBy(F.col(x).desc(), *tie).limit(n).withColumn("side", F.lit("best"))
    worst = df.orderBy(F.col(x).asc(), *tie).limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First n rows of each key; ``row_number() <= n`` is cut to n rows per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
