"""Market-data views of the test tables: ticks, bars, fills, trades, signals, alerts.

Each function is lazy and reads only the columns it needs. Timestamps keep the
type the source has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.core import floor_ts
from tidemark.operators.frames import CHUNK, balanced_chunks, prefix
from tidemark.session import materialize, prepare

HOUR = 3600
GRID = 1_048_576.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ticks_from_events(events: DataFrame) -> DataFrame:
    """Price walk over the events of a type: 100 * exp(sum of (value - 50) / 10000).

    The sum is kept in whole cents, so it does not depend on the order of addition.
    Prices are rounded to a binary grid (1 / 2**20), which makes sums of prices exact too.
    """
    cents = F.round((F.col("value") - 50) * 100).cast("bigint")
    base = events.select(
        F.col("event_type").alias("symbol"),
        "ts",
        "event_id",
        "user_id",
        cents.alias("_cents"),
        F.get_json_object("props", "$.k").cast("int").alias("qty"),
    )
    base = balanced_chunks(base, ["symbol"], ["ts", "event_id"])
    walk = prefix(base, {"_sum": ("sum", F.col("_cents"))}, ["symbol"], ["ts", "event_id"])
    price = F.round(F.exp(F.col("_sum") / 1e6) * (100 * GRID)) / GRID
    return walk.select("symbol", "ts", "event_id", "user_id", price.alias("price"), "qty", CHUNK)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with their slice number, so that running values over them need no new cuts."""
    return materialize(spark, f"ticks:{sf_dir}", lambda: ticks_from_events(table(spark, sf_dir, "events")))


def bars(spark: SparkSession, sf_dir: str, seconds: int = HOUR) -> DataFrame:
    from tidemark.operators.bars import ticks_to_bars

    return materialize(spark, f"bars{seconds}:{sf_dir}", lambda: ticks_to_bars(ticks(spark, sf_dir), seconds))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills from order lines: venue is the supplier, side follows the line status."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.concat(F.lit("P"), F.pmod("l_partkey", F.lit(50)).cast("string")).alias("symbol"),
        F.col("l_suppkey").alias("venue"),
        F.when(F.col("l_linestatus") == "F", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_extendedprice").alias("notional"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("commission"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        (F.col("l_returnflag") == "N").alias("is_maker"),
        F.col("l_shipdate").alias("ts"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades: entry at the order date, exit at the ship date; lines shipped earlier are left out."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    d = li.join(o, li.l_orderkey == o.o_orderkey).where(F.col("l_shipdate") >= F.col("o_orderdate"))
    return d.select(
        F.col("l_orderkey").alias("order_id"),
        F.concat(F.lit("S"), F.pmod("l_suppkey", F.lit(20)).cast("string")).alias("symbol"),
        F.col("o_orderpriority").alias("strategy"),
        F.col("o_custkey").alias("account"),
        F.col("l_returnflag").alias("exit_reason"),
        F.when(F.col("l_linestatus") == "F", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("notional"),
        F.col("o_orderdate").alias("entry_ts"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("pnl"),
        F.round((F.col("l_discount") - F.col("l_tax")) * 100).alias("ret_pct"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("commission"),
        F.date_diff("l_shipdate", "o_orderdate").alias("holding_days"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts from error events; severity by fixed value steps."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    v = F.col("value")
    severity = F.when(v >= 100, "CRITICAL").when(v >= 50, "ERROR").when(v >= 20, "WARNING").otherwise("INFO")
    return e.select(
        F.col("event_id").alias("alert_id"),
        "ts",
        severity.alias("severity"),
        F.concat(F.lit("svc"), F.pmod("user_id", F.lit(5)).cast("string")).alias("source"),
        (F.pmod("event_id", F.lit(2)) == 0).alias("resolved"),
        F.col("value"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines from events: level is the event type, component a group of users."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("log_id"),
        "ts",
        F.upper("event_type").alias("level"),
        F.concat(F.lit("c"), F.pmod("user_id", F.lit(5)).cast("string")).alias("component"),
        F.col("user_id").alias("category"),
        F.col("props").alias("message"),
        "value",
    )


def chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signals, positions and executions that share a key, some links missing by rule."""
    t = ticks(spark, sf_dir)
    key = F.floor(F.col("event_id") / 3)
    base = t.withColumn("key", key)
    kind = F.pmod("event_id", F.lit(3))
    side = F.when(F.pmod("user_id", F.lit(2)) == 0, "BUY").otherwise("SELL")
    cols = ["key", "symbol", side.alias("side"), "price", "qty", "ts"]
    signals = base.where((kind == 0) & (F.pmod("key", F.lit(11)) != 0)).select(*cols)
    positions = base.where((kind == 1) & (F.pmod("key", F.lit(7)) != 0)).select(*cols)
    executions = base.where((kind == 2) & (F.pmod("key", F.lit(5)) != 0)).select(*cols)
    return signals, positions, executions


__all__ = ["CHUNK", "alerts", "bars", "chain", "fills", "floor_ts", "logs", "table", "ticks", "trades"]


def round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday closed trades from events: exit at the event, profit = value - 50."""

    def make():
        return balanced_chunks(trips_from_events(table(spark, sf_dir, "events")), ["symbol"], ["ts", "trade_id"])

    return materialize(spark, f"trips:{sf_dir}", make)


def trips_from_events(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_id").alias("trade_id"),
        F.col("event_type").alias("symbol"),
        F.concat(F.lit("s"), F.pmod("user_id", F.lit(3)).cast("string")).alias("strategy"),
        F.col("user_id").alias("account"),
        "ts",
        F.get_json_object("props", "$.k").cast("int").alias("holding_minutes"),
        (F.round((F.col("value") - 50) * GRID) / GRID).alias("pnl"),
        (F.round((F.col("value") - 50) / 25 * GRID) / GRID).alias("pnl_pct"),
        (F.pmod("event_id", F.lit(100)) / 100.0).alias("confidence"),
    )
