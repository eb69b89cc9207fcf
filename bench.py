"""Headline queries, timed: prints one JSON line.

``cold`` has the first run of each query, its inputs built from the source
tables; ``queries`` the median of the repeats, which share built inputs, in
seconds; ``rows_per_sec`` gives input rows per second where that is the measure.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

HEADLINE = [
    "entry_win_rate",
    "base_feature_sets",
    "rolling_mean_std",
    "macd",
    "cross_asset_features",
    "triple_barrier",
    "volume_analysis",
    "daily_pnl_rollup",
    "pnl_summary",
    "tca_report",
    "psi_drift",
    "ks_test",
    "corr_matrix",
    "session_flags",
    "stream_rollup",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidemark.operators.bars import resample, ticks_to_bars
    from tidemark.operators.frames import framed
    from tidemark.operators.temporal_joins import asof_join
    from tidemark.plans import load_all
    from tidemark.plans.registry import QUERIES
    from tidemark.session import forget
    from tidemark.sources.standins import bars, fills, table, ticks, ticks_from_events

    load_all()

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    def rolling15():
        def build(d, fr):
            cols = {}
            for n in (5, 10, 20, 30, 50):
                cols |= {f"m{n}": fr.mean("close", n), f"s{n}": fr.std("close", n), f"h{n}": fr.max("high", n)}
            return d.withColumns(cols)

        return framed(bars(spark, SF_DIR, 900), build, before=50)

    def fills_asof_daily():
        o = table(spark, SF_DIR, "orders").select(
            F.concat(F.lit("P"), F.pmod("o_custkey", F.lit(50)).cast("string")).alias("symbol"),
            F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("price"), F.lit(1).alias("qty"),
        )
        daily = ticks_to_bars(o, 86_400).select("symbol", "ts", F.col("close").alias("day_close"))
        return asof_join(fills(spark, SF_DIR).select("symbol", "ts", "price"), daily, ["day_close"], chunk_seconds=30 * 86_400)

    timed = {
        "ticks_from_events": lambda: ticks_from_events(table(spark, SF_DIR, "events")),
        "ticks_to_bars_1h": lambda: ticks_to_bars(ticks(spark, SF_DIR), 3600),
        "resample_4h": lambda: resample(bars(spark, SF_DIR), 14_400),
        "rolling_15_features": rolling15,
        "fills_asof_daily": fills_asof_daily,
        **{q: (lambda q=q: QUERIES[q](spark, SF_DIR)) for q in HEADLINE},
    }
    only = set(sys.argv[1:])
    out, cold = {}, {}
    for name, make in timed.items():
        if only and name not in only:
            continue
        forget()
        t0 = time.perf_counter()
        drain(make())
        cold[name] = round(time.perf_counter() - t0, 3)
        took = []
        for _ in range(REPEATS):
            t0 = time.perf_counter()
            drain(make())
            took.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(took), 3)
    n_events = table(spark, SF_DIR, "events").count()
    n_fills = table(spark, SF_DIR, "lineitem").count()
    rates = {
        k: round(n / out[k])
        for k, n in {
            "ticks_from_events": n_events, "ticks_to_bars_1h": n_events, "session_flags": n_events, "stream_rollup": n_events,
            "fills_asof_daily": n_fills, "volume_analysis": n_fills, "daily_pnl_rollup": n_fills, "pnl_summary": n_fills,
        }.items()
        if k in out
    }
    print(
        json.dumps(
            {
                "metric": "sum of median seconds over the headline queries",
                "value": round(sum(out.values()), 3),
                "unit": "sec",
                "queries": out,
                "cold": cold,
                "rows_per_sec": rates,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
