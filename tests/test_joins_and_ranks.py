import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import T0, bars_frame, close_to, pdf
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators.joins import corr_matrix, orphans
from tidemark.operators.order_stats import average_rank, exact_quantiles, ordered_counts
from tidemark.operators.sequences import non_overlapping, space_out
from tidemark.operators.temporal_joins import asof_join, interval_join, nearest_join


def stamps(spark, rows, cols):
    return spark.createDataFrame([(s, T0 + dt.timedelta(seconds=t), *v) for s, t, *v in rows], f"symbol string, ts timestamp, {cols}")


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(3)
    left = stamps(spark, [("A" if rng.random() < 0.8 else "B", int(rng.integers(0, 400_000)), i) for i in range(600)], "i int")
    right = stamps(spark, [("A" if rng.random() < 0.5 else "B", t, t) for t in sorted(set(rng.integers(0, 400_000, 150).tolist()))], "v int")
    return left, right


@pytest.mark.parametrize("chunk", [3600, 86_400, None])
def test_asof_matches_pandas(spark, sides, chunk):
    left, right = sides
    a, b = pdf(left, "ts"), pdf(right, "ts")
    for direction in ("backward", "forward"):
        want = pd.merge_asof(a, b, on="ts", by="symbol", direction=direction).sort_values("i")["v"]
        got = pdf(asof_join(left, right, ["v"], direction=direction, chunk_seconds=chunk), "i")["v"]
        close_to(got, want)


def test_asof_equal_stamp_and_strict(spark):
    left = stamps(spark, [("A", 100, 1)], "i int")
    right = stamps(spark, [("A", 50, 7), ("A", 100, 8)], "v int")
    assert asof_join(left, right, ["v"]).first()["v"] == 8
    assert asof_join(left, right, ["v"], strict=True).first()["v"] == 7
    assert asof_join(left, stamps(spark, [("A", 101, 9)], "v int"), ["v"]).first()["v"] is None


def test_nearest_matches_brute_force(spark, sides):
    left, right = sides
    a, b = pdf(left, "i"), pdf(right, "ts")
    got = pdf(nearest_join(left, right, ["v"], 2000), "i")["v"]
    want = []
    for s, t in zip(a["symbol"], a["ts"]):
        c = b[b["symbol"] == s]
        gap = (c["ts"] - t).abs()
        best = gap[gap < pd.Timedelta(seconds=2000)]
        want.append(np.nan if best.empty else float(c.loc[best.idxmin(), "v"]))
    close_to(got, want)


def test_interval_join_matches_brute_force(spark, sides):
    left, right = sides
    spans = left.select("symbol", F.col("i"), F.col("ts").alias("a"), (F.col("ts") + F.expr("interval 9000 seconds")).alias("b"))
    got = interval_join(spans, right, "a", "b").count()
    s, r = spans.toPandas(), right.toPandas()
    m = s.merge(r, on="symbol")
    assert got == int(((m["ts"] >= m["a"]) & (m["ts"] <= m["b"])).sum())


def test_quantiles_and_ranks_match_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(np.round(rng.normal(), 2))) for _ in range(3000)] + [("cold", float(i)) for i in range(5)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    q = exact_quantiles(df, F.col("x"), {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.999, "e": 1.0}, ["k"]).toPandas().set_index("k")
    for k, g in df.toPandas().dropna().groupby("k"):
        close_to(q.loc[k], np.quantile(g["x"], [0, 0.05, 0.5, 0.999, 1.0]), 1e-12)
    hot = df.where("k = 'hot'")
    c = ordered_counts(hot, F.col("x")).withColumn("r", average_rank()).toPandas().sort_values("value")
    x = hot.toPandas()["x"]
    want = pd.DataFrame({"x": x, "r": x.rank()}).drop_duplicates().sort_values("x")
    close_to(c["r"], want["r"])
    assert c["n"].sum() == 3000


def test_steps_of_a_key_with_one_long_interval(spark):
    """An interval as long as the table is one more entry of each slice, not all of its rows."""
    from tidemark.operators.frames import balanced_chunks
    from tidemark.operators.sequences import slice_steps

    data = [("A", 10 * i, 10 * i + (100_000 if i == 3 else 25)) for i in range(2000)]
    d = balanced_chunks(spark.createDataFrame(data, "symbol string, _s bigint, _e bigint"), ["symbol"], ["_s"], 100)
    steps = slice_steps(d, ["symbol"], ["_s"], "symbol string")
    slices = d.select("_chunk").distinct().count()
    assert slices > 10 and steps.count() <= slices * (1 + 1 + 3)  # nothing, the long one, those that lie over the cut


@pytest.mark.parametrize("rows", [7, 1000])
@pytest.mark.parametrize("longest", [None, 3, 150])
def test_non_overlapping_matches_a_plain_walk(spark, rows, longest):
    rng = np.random.default_rng(9)
    starts = sorted(rng.choice(20_000, 300, replace=False).tolist())
    data = [("A" if i % 4 else "B", T0 + dt.timedelta(minutes=int(t)), T0 + dt.timedelta(minutes=int(t + rng.integers(0, 400)))) for i, t in enumerate(starts)]
    if longest is not None:  # one interval as long as the rest of the table, in the chain that is kept or beside it
        data[longest] = (*data[longest][:2], data[longest][1] + dt.timedelta(minutes=30_000))
    df = spark.createDataFrame(data, "symbol string, ts timestamp, exit_ts timestamp")
    got = sorted((r["symbol"], r["ts"]) for r in non_overlapping(df, rows=rows).collect())
    want, busy = [], {}
    for s, a, b in sorted(data, key=lambda r: (r[0], r[1])):
        if s not in busy or a >= busy[s]:
            want.append((s, a))
            busy[s] = b
    assert got == sorted(want)


def test_space_out_over_all_symbols(spark):
    df = stamps(spark, [("A", 0, 1), ("B", 50, 2), ("A", 100, 3), ("B", 160, 4), ("A", 199, 5), ("B", 200, 6)], "i int")
    assert sorted(r["i"] for r in space_out(df, 100, rows=2).collect()) == [1, 3, 6]


def test_corr_matrix_skips_missing_stamps(spark):
    a = bars_frame(spark, [1, 2, 3, 5], "A")
    b = bars_frame(spark, [2, 1, 4, 4], "B", gaps=(1,))
    r = corr_matrix(a.unionByName(b), "close").first()
    assert r["n"] == 3
    assert abs(r["corr"] - np.corrcoef([1, 3, 5], [2, 4, 4])[0, 1]) < 1e-12


def test_gaps_and_repair(spark):
    b = bars_frame(spark, range(10), gaps=(4, 5, 8))
    assert B.missing_bars(b, 3600).count() == 3
    d = pdf(B.repair_gaps(b, 3600), "ts")
    assert d["close"].tolist() == [0, 1, 2, 3, 3, 3, 6, 7, 7, 9] and d["repaired"].sum() == 3
    line = pdf(B.repair_gaps(b, 3600, method="linear"), "ts")
    close_to(line["close"], range(10))


def test_resample_first_last_ties_by_id(spark):
    t = spark.createDataFrame([("A", T0, 2, 5.0, 1), ("A", T0, 1, 4.0, 2), ("A", T0 + dt.timedelta(minutes=59), 3, 6.0, 3), ("A", T0 + dt.timedelta(hours=1), 4, 7.0, 4)], "symbol string, ts timestamp, event_id int, price double, qty int")
    got = pdf(B.ticks_to_bars(t, 3600), "ts")
    assert got[["open", "high", "low", "close", "volume"]].values.tolist() == [[4.0, 6.0, 4.0, 6.0, 6.0], [7.0, 7.0, 7.0, 7.0, 4.0]]


def test_normalize_renames_cleans_and_dedupes(spark):
    raw = spark.createDataFrame(
        [("A", T0, "1", "3", "1", "2", "5"), ("A", T0, "1", "3", "1", "2", "6"), ("A", T0 + dt.timedelta(hours=1), "x", "3", "1", "2", "5"), ("A", T0 + dt.timedelta(hours=2), "NaN", "3", "1", "2", "5")],
        "symbol string, open_time timestamp, o string, h string, l string, c string, v string",
    )
    got = B.normalize(raw).collect()
    assert len(got) == 1 and got[0]["volume"] == 5.0
    with pytest.raises(ValueError):
        B.normalize(raw.drop("v"))


def test_upsert_prefers_the_later_load(spark):
    old = bars_frame(spark, [1, 2]).withColumn("load_ts", F.lit(1))
    new = bars_frame(spark, [9, 9, 9], gaps=(0,)).withColumn("load_ts", F.lit(2))
    assert pdf(B.upsert(old, new), "ts")["close"].tolist() == [1.0, 9.0, 9.0]


def test_orphans(spark):
    k = lambda *v: spark.createDataFrame([(x,) for x in v], "key int")
    got = {(r["key"], r["problem"]) for r in orphans(k(1, 2), k(2, 3), k(3, 4)).collect()}
    assert got == {(1, "signal_without_position"), (2, "position_without_execution"), (4, "execution_without_parent")}


def test_long_trend_test_equals_all_pairs(spark):
    from tidemark.operators.validation import mann_kendall

    rng = np.random.default_rng(11)
    x = np.round(np.cumsum(rng.normal(0.01, 1, 3000)), 1)
    rows = [("A", i, float(v)) for i, v in enumerate(x)] + [("B", 0, 1.0), ("B", 1, None), ("B", 2, 1.0)]
    got = {r.k: (r.n, r.s, r.z) for r in mann_kendall(spark.createDataFrame(rows, "k string, t int, x double"), "x", "t", ["k"]).collect()}
    s = float(sum(np.sign(x[i + 1 :] - x[i]).sum() for i in range(len(x))))
    n = len(x)
    assert got["A"][:2] == (n, s) and abs(got["A"][2] - (s - np.sign(s)) / np.sqrt(n * (n - 1) * (2 * n + 5) / 18)) < 1e-9
    assert got["B"][:2] == (2, 0.0)
