import datetime as dt

import numpy as np
import pytest
from helpers import T0, bars_frame, close_to, pdf, walk
from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.operators import labels as L
from tidemark.operators import quality as Q
from tidemark.operators import reports as R
from tidemark.operators import risk as K
from tidemark.operators import rolling as W
from tidemark.operators import validation as V


def test_constant_price_gives_nulls_not_errors(spark):
    b = bars_frame(spark, [100.0] * 60)
    assert pdf(I.rsi(b), "ts")["rsi"].isna().all()
    bb = pdf(I.bollinger(b), "ts").iloc[-1]
    assert bb["bb_width"] == 0 and bb["bb_pct"] != bb["bb_pct"]


def test_four_anomaly_detectors_by_hand(spark):
    closes = [100.0 + i % 2 for i in range(40)]
    closes[10:17] = [104.5] * 7  # six zero changes in a row: frozen at the fifth and sixth
    closes[20:25] = [103.0] * 5  # four only
    closes[30:] = [130.0 + i % 2 for i in range(10)]
    b = bars_frame(spark, closes, gaps=(35, 36, 37)).withColumn("volume", F.when(F.col("ts") == F.lit(T0 + dt.timedelta(hours=28)), 1.0).otherwise(F.col("volume")))
    small = bars_frame(spark, [100.0, 101.0, 106.0, 107.0], "B")  # a jump under 10 %
    got = {(r.symbol, int((r.ts - T0).total_seconds() // 3600), r.detector) for r in Q.anomalies(b.unionByName(small)).collect()}
    assert got == {("A", 30, "spike"), ("A", 28, "volume"), ("A", 38, "gap"), ("A", 15, "frozen"), ("A", 16, "frozen")}


def test_frozen_rows_need_five_unchanged_rows(spark):
    b = bars_frame(spark, [1.0] * 30 + [0.0] * 6 + [2.0] * 5)
    got = [int((r.ts - T0).total_seconds() // 3600) for r in Q.frozen_rows(b).orderBy("ts").collect()]
    assert got == [*range(5, 30), 35]


def test_registered_detectors_find_frozen_prices(spark, monkeypatch):
    from tidemark.plans import load_all, stream_queries
    from tidemark.plans.registry import QUERIES

    load_all()
    monkeypatch.setattr(stream_queries, "b1", lambda *_: bars_frame(spark, [1.0] * 6))
    assert [r.detector for r in QUERIES["anomaly_detectors_full"](spark, "").collect()] == ["frozen"]


def test_rsi_by_hand(spark):
    got = pdf(I.rsi(bars_frame(spark, [10, 11, 10, 12]), 3), "ts")["rsi"]
    close_to(got, [None, None, None, 75.0])


@pytest.mark.parametrize("make", [I.rsi, I.macd, I.atr, I.adx, I.cci, I.ichimoku, I.volume_flow, I.fractal_swings, I.regime_scores])
def test_features_do_not_look_ahead(spark, make):
    b = walk(spark, 220, ("A",))
    cut = T0 + dt.timedelta(hours=180)
    changed = b.withColumns({c: F.when(F.col("ts") > cut, F.col(c) * 2).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    x = pdf(make(b).where(F.col("ts") <= cut), "ts").drop(columns=["ts", "symbol"])
    y = pdf(make(changed).where(F.col("ts") <= cut), "ts").drop(columns=["ts", "symbol"])
    assert x.equals(y)


def test_row_order_of_input_does_not_matter(spark):
    b = walk(spark, 120)
    x = pdf(I.macd(b), "symbol", "ts")["hist"]
    y = pdf(I.macd(b.orderBy(F.rand(3)).repartition(7)), "symbol", "ts")["hist"]
    close_to(x, y, 1e-12)


def test_labels_by_hand(spark):
    b = bars_frame(spark, [100, 101, 99, 103, 100])
    hit = pdf(L.hit_labels(b, 2, 0.01, 0.01), "ts")
    assert hit["hit_target"].tolist() == [1, 1, 1, 0, 0]
    assert hit["hit_stop"].tolist() == [1, 1, 0, 0, 0]
    t = pdf(L.time_to_target(b, {"up": 0.02, "down": -0.005}, 3), "ts")
    assert t["up"].tolist() == [3, 3, 1, 3, 3] and t["down"].tolist() == [2, 1, 3, 1, 3]
    e = pdf(L.optimal_exit(b, 3), "ts")
    assert e["exit_offset"].tolist()[:4] == [3, 2, 1, 1]


def test_barrier_both_sides_in_one_bar_counts_as_stop(spark):
    b = bars_frame(spark, [100, 100, 100])  # high +1, low -1 in every bar
    assert pdf(L.triple_barrier(b, 2, 0.005, 0.005), "ts")["barrier"].tolist() == [-1, -1, 0]
    assert pdf(L.triple_barrier(b, 2, 0.005, 0.005, ordered=False), "ts")["barrier"].tolist() == [0, 0, 0]


def test_exits_prefer_a_later_preferred_boundary(spark):
    b = bars_frame(spark, [100, 101, 102, 103, 104, 105, 106, 107], minutes=10)
    d = pdf(L.signal_exits(b, F.col("close") == 101, 10, 60), "ts")
    # entered 00:10; 00:30 is a plain boundary, 00:20 / 00:40 / 00:50 are none, no bar falls on 15 or 45
    assert d["exit_price"].tolist() == [103.0] and d["priority"].tolist() == [2]
    q = bars_frame(spark, [100, 101, 102, 103, 104], minutes=15)
    e = pdf(L.signal_exits(q, F.col("close") == 101, 15, 60), "ts")
    assert e["exit_price"].tolist() == [103.0] and e["priority"].tolist() == [1]


def test_drawdown_cases(spark):
    up = pdf(W.drawdowns(bars_frame(spark, [1, 2, 3]), "close"), "ts")
    assert up["drawdown"].tolist() == [0, 0, 0]
    down = pdf(W.drawdowns(bars_frame(spark, [3, 2, 1]), "close"), "ts")
    assert down["drawdown"].tolist() == [0, -1, -2]
    neg = pdf(W.drawdowns(bars_frame(spark, [-1, -3, 2]), "close", floor_zero=True), "ts")
    assert neg["drawdown"].tolist() == [-1, -3, 0]
    ep = W.drawdown_episodes(bars_frame(spark, [5, 4, 3, 6, 5]), "close").toPandas().sort_values("start_ts")
    assert ep["depth"].tolist() == [-2, -1] and ep["recovered"].tolist() == [True, False]


def test_quality_rules(spark):
    b = bars_frame(spark, [10, 11, 12]).withColumn("high", F.when(F.col("close") == 11, 5.0).otherwise(F.col("high")))
    b = b.withColumn("volume", F.when(F.col("close") == 12, -1.0).otherwise(F.col("volume")))
    got = {r["close"]: r["broken"] for r in Q.ohlc_violations(b).collect()}
    assert got == {11.0: ["high_ok"], 12.0: ["volume_ok"]}
    g = spark.createDataFrame([("A", T0 + dt.timedelta(minutes=m)) for m in (0, 60, 125, 300)], "symbol string, ts timestamp")
    assert Q.time_gaps(g, 3600, 300).select("missing").collect()[0][0] == 1
    assert Q.time_gaps(g, 3600, 299).count() == 2


def test_psi_edge_cases(spark):
    base = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    same = V.psi(base, base, ["x"]).first()
    assert abs(same["psi"]) < 1e-12 and same["grade"] == "stable"
    const = spark.createDataFrame([(1.0,)] * 10, "x double")
    assert V.psi(const, base, ["x"]).count() == 0  # one edge makes no bins
    far = spark.createDataFrame([(500.0,)] * 10, "x double")
    assert V.psi(base, far, ["x"]).first()["psi"] > 1


def test_multiple_testing_monotone(spark):
    d = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.02, 0.021, 0.5])], "i int, p double")
    got = pdf(V.adjust_p_values(d, "p", tie=["i"]), "p")
    close_to(got["holm"], [0.04, 0.06, 0.06, 0.5], 1e-12)
    close_to(got["bh"], [0.028, 0.028, 0.028, 0.5], 1e-12)


def test_multiple_testing_carries_from_slice_to_slice(spark):
    n = 30_000
    d = spark.range(n).select(F.col("id").alias("i"), F.round(F.pmod(F.col("id") * 7919, F.lit(n)) / (2.0 * n), 4).alias("p"))
    adjusted = V.adjust_p_values(d, "p", tie=["i"], rows=7_000)
    got = adjusted.toPandas().sort_values(["p", "i"])
    place = np.arange(1, n + 1)
    bh = np.minimum(1, got["p"].to_numpy() * n / place)
    close_to(got["bh"], np.minimum.accumulate(bh[::-1])[::-1], 1e-12)
    close_to(got["holm"], np.maximum.accumulate(np.minimum(1, got["p"].to_numpy() * (n - place + 1))), 1e-12)
    # such a frame is run through anew for each row
    assert "unboundedfollowing" not in adjusted._jdf.queryExecution().optimizedPlan().toString().lower()


def test_multiple_testing_families_with_nulls(spark):
    d = spark.createDataFrame([(f, i, p) for f in (None, "a") for i, p in enumerate([0.5, None, 0.01])], "f string, i int, p double")
    got = V.adjust_p_values(d, "p", ["f"], ["i"], rows=1).orderBy("f", "i").collect()
    assert [(r["f"], r["bonferroni"], r["bh_plain"]) for r in got if r["p"] is not None] == [(None, 1.0, 0.75), (None, 0.03, 0.03), ("a", 1.0, 0.75), ("a", 0.03, 0.03)]


def test_var_and_profit_factor(spark):
    d = spark.createDataFrame([(float(x),) for x in range(-10, 90)], "r double")
    v = K.var_es(d, "r").first()
    assert v["var_hist"] == 5.0 and v["es_hist"] == 8.0
    t = spark.createDataFrame([(2.0,), (4.0,), (-3.0,)], "pnl double")
    got = t.agg(R.profit_factor().alias("s"), R.profit_factor(kind="extremes").alias("e"), R.profit_factor(kind="net").alias("n")).first()
    assert (got["s"], got["n"]) == (2.0, 1.0) and abs(got["e"] - 4 / 3) < 1e-12


def test_auc_with_ties(spark):
    d = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "s double, y int")
    assert V.rank_auc(d, F.col("s"), F.col("y") == 1).first()["auc"] == 0.875


def test_purged_folds_leave_the_gap_out(spark):
    d = V.purged_folds(bars_frame(spark, range(20)), 4, 2, 1).where("fold = 1").toPandas().sort_values("ts")
    assert d[d["role"] == "test"]["close"].tolist() == [5, 6, 7, 8, 9]
    assert d[d["role"] == "train"]["close"].tolist() == [0, 1, 2, *range(11, 20)]
