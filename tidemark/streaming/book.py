"""Order-book snapshots: levels as arrays, flow over recent snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import div
from tidemark.operators.frames import framed


def book_metrics(depth: int = 10) -> dict[str, Column]:
    """From ``bids`` and ``asks`` (arrays of price and qty, best first): best prices, spread, depth, imbalance."""
    bid, ask = F.try_element_at("bids", F.lit(1))["price"], F.try_element_at("asks", F.lit(1))["price"]

    def total(side):
        return F.aggregate(F.slice(side, 1, depth), F.lit(0.0), lambda a, x: a + x["qty"])

    b, a = total("bids"), total("asks")
    return {
        "best_bid": bid,
        "best_ask": ask,
        "spread": ask - bid,
        "spread_pct": div((ask - bid) * 100, (ask + bid) / 2),
        "bid_depth": b,
        "ask_depth": a,
        "imbalance": div(b - a, b + a),
    }


def book_flow(snapshots: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), chunk: Column | None = None) -> DataFrame:
    """Mid momentum and slope over 10 snapshots, depth change over 5, updates per second, direction."""

    def build(d, fr):
        d = d.withColumns({"_i": F.col("_rn").cast("double"), "_old": fr.lag("mid", 9), "_oldd": fr.lag("depth", 4)})
        seconds = (F.unix_micros(F.col(order[0]).cast("timestamp")) - F.unix_micros(fr.lag(order[0], 9).cast("timestamp"))) / 1e6
        return d.withColumns(
            {
                "momentum": div("mid", "_old") - 1,
                "slope": fr.full(F.regr_slope(F.col("mid"), F.col("_i")), 10),
                "depth_change": div("depth", "_oldd") - 1,
                "update_rate": div(F.lit(9.0), seconds),
            }
        ).drop("_i", "_old", "_oldd")

    d = framed(snapshots, build, before=10, keys=keys, order=order, chunk=chunk)
    direction = F.when(F.col("momentum") > 0.001, "up").when(F.col("momentum") < -0.001, "down").when(F.col("momentum").isNotNull(), "flat")
    return d.withColumn("direction", direction)
