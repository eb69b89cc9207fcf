"""Keyed stream state: steps cut anywhere, batches run twice, late rows, idle keys; progress by topic."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from helpers import T0, pdf
from pyspark.sql import functions as F

from tidemark.streaming import events as E
from tidemark.streaming import keyed as K
from tidemark.streaming import rollups as R
from tidemark.streaming.run import counted, fresh_path, run_available, run_logged, topic_stats

SCHEMA = "name string, ts timestamp, event_id bigint, value double, volume double"


def rows_of(name, n, seed=1, start=0, step=60):
    rnd = np.random.default_rng(seed)
    price = np.round(100 * np.exp(np.cumsum(rnd.normal(0, 0.05, n))), 2)
    price[40:52] = price[40]
    return [(name, T0 + dt.timedelta(seconds=int(start + step * i + rnd.integers(0, step) + (4000 if i > 70 else 0))), i, float(price[i]), float(rnd.integers(1, 9) if i % 31 else 500)) for i in range(n)]


def table(rows):
    d = pd.DataFrame(rows, columns=["name", "ts", "event_id", "value", "volume"])
    return d.assign(us=d["ts"].astype("datetime64[us]").astype("int64"), tie=d["event_id"], price=d["value"], mid=d["value"], depth=d["volume"])


@pytest.fixture()
def feed(spark, tmp_path):
    def make(batches, schema=SCHEMA):
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return E.file_events(spark, str(tmp_path / "in"), schema, files_per_batch=1)

    return make


@pytest.mark.parametrize("step", [K.trailing_thresholds(n=30), K.trailing_anomalies(n=30), K.trailing_flow(), K.cooldown(100.0, 120.0, 600.0)])
def test_cuts_do_not_matter(step):
    d = table(rows_of("A", 300))
    whole = K.over_table(d, step)
    assert len(whole)
    for cuts in ([1, 2, 3], [35, 36, 200], list(range(1, 300))):
        pd.testing.assert_frame_equal(whole, K.over_table(d, step, cuts), check_dtype=False, rtol=1e-9)


def test_steps_by_hand():
    x = pd.Series([r[3] for r in rows_of("A", 300)])
    d, n = table(rows_of("A", 300)), 30
    before = x.shift(1).rolling(n, min_periods=20)
    pct, sigma = before.quantile(0.95), before.mean() + 3 * before.std()
    got = K.over_table(d, K.trailing_thresholds(n=n))
    assert got["at"].tolist() == np.flatnonzero((x > pct) | (x > sigma)).tolist()
    np.testing.assert_allclose(got["limit_pct"], pct[got["at"]])
    change = (x / x.shift(1) - 1).abs()
    spike = change > np.maximum(change.rolling(n, min_periods=1).quantile(0.99), 0.1)
    gap = pd.Series(d["us"]).diff() / 1e6
    hole = gap > 3 * gap.rolling(n, min_periods=1).median()
    v = d["volume"]
    odd = ((v - v.rolling(20).mean()) / v.rolling(20).std()).abs() > 3
    still = (x.diff() == 0).rolling(5).sum() >= 5
    i = np.arange(len(x))
    want = [np.flatnonzero(c).tolist() for c in (spike & (i >= 19), odd, hole & (i >= 4), still)]
    found = K.over_table(d, K.trailing_anomalies(n=n))
    assert all(want) and [found["at"][found["detector"] == k].tolist() for k in range(4)] == want
    since = last = None
    alerts = []
    for k, (t, y) in enumerate(zip(d["us"], x)):
        since = None if y <= 100 else t if since is None else since
        if since is not None and t - since >= 120e6 and (last is None or t - last >= 600e6):
            alerts.append(k)
            last = t
    assert K.over_table(d, K.cooldown(100.0, 120.0, 600.0))["at"].tolist() == alerts


def started(stream, step, sink, path, keep="10 days"):
    with K.uses_rocks(stream.sparkSession):
        return run_logged(K.in_order(stream, step, slot="5 minutes", keep=keep), "append", sink, path)


def test_batches_late_rows_and_a_batch_run_twice(spark, feed):
    a, b = rows_of("A", 200), rows_of("B", 90, 2)
    every = sorted(a + b, key=lambda r: r[1])
    cuts = [every[:90], every[90:200], every[200:]]
    cuts[1], cuts[2] = cuts[1][4:] + [], cuts[1][:4] + cuts[2]  # four rows come a batch later: behind the watermark or not
    gone = [r for r in cuts[2][:4] if r[1] < max(x[1] for x in cuts[1]) - dt.timedelta(minutes=10)]
    stream, step = feed(cuts), K.trailing_thresholds(n=30)
    path, failed = fresh_path(spark), []

    def sink(batch, batch_id):
        R.keep_updates(f"{path}/u")(batch, batch_id)
        if batch_id == 1 and not failed:  # the batch's rows are written, then it fails and is run again
            failed.append(batch_id)
            raise RuntimeError("executor lost")

    with pytest.raises(Exception, match="executor lost"):
        started(stream, step, sink, path)
    _, log = started(stream, step, sink, path)
    got = spark.read.parquet(f"{path}/u/*")
    late = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in log.batches) + sum(r.late for r in got.where("late is not null").collect())
    assert late == len(gone) > 0
    end = max(r[1] for r in every) - dt.timedelta(minutes=10)
    want = set()
    for name in "AB":
        own = [r for r in every if r[0] == name and r not in gone and r[1].replace(minute=r[1].minute // 5 * 5, second=0) + dt.timedelta(minutes=5) < end]
        want |= {(name, own[k][2]) for k in K.over_table(table(own), step)["at"]}
    assert {(r.name, r.event_id) for r in got.where("late is null").collect()} == want


def test_idle_keys_lose_their_state(spark, feed):
    idle, busy = rows_of("A", 60)[:30], [rows_of("B", 60, k, k * 7200) for k in range(4)]
    stream = feed([idle + busy[0], *busy[1:]])
    path, log = started(stream, K.cooldown(0.0, 0.0, 0.0), None, fresh_path(spark), keep="2 hours")
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in log.batches]
    assert kept[-1] < kept[0]
    got = spark.read.parquet(f"{path}/data").where("late is null")
    assert got.where("name = 'A'").count() == 30


def test_latest_state_expires(spark, feed):
    days = [[("A" if d == 0 else "B", T0 + dt.timedelta(days=d, minutes=m), 100 * d + m, float(m), 1.0) for m in range(5)] for d in range(4)]
    stream = feed(days).withColumnRenamed("name", "symbol")
    path = fresh_path(spark)
    _, log = run_logged(R.latest_state(stream, ["value"]), "update", R.keep_updates(f"{path}/u"), path)
    assert {r.symbol: r.event_id for r in R.newest(spark.read.parquet(f"{path}/u/*")).collect()} == {"A": 4, "B": 304}
    assert log.batches[-1]["stateOperators"][0]["numRowsTotal"] <= 2  # of four: the days before the last batch are gone


def test_lag_and_errors_by_topic(spark):
    def progress(end, newest, rows):
        return json.loads(json.dumps({"sources": [{"endOffset": end, "latestOffset": newest}, {"endOffset": {"logOffset": 3}, "latestOffset": None}], "observedMetrics": {"topics": rows}}))

    batches = [
        progress({"a": {"0": 5, "1": 7}, "b": {"0": 1}}, {"a": {"0": 9, "1": 7}, "b": {"0": 4}}, {"rows_0": 12, "bad_0": 2, "rows_1": 1, "bad_1": 0}),
        progress('{"a": {"0": 9, "1": 8}, "b": {"0": 4}}', {"a": {"0": 9, "1": 30}, "b": {"0": 2}}, {"rows_0": 5, "bad_0": 0, "rows_1": 3, "bad_1": 3}),
        {"sources": [], "observedMetrics": {}},
    ]
    got = {r.topic: (r.processed, r.errors, r.lag) for r in topic_stats(spark, batches, ["a", "b", "c"]).collect()}
    assert got == {"a": (17, 2, 22), "b": (4, 3, 0), "c": (0, 0, None)}


def test_more_than_a_hundred_batches(spark, feed):
    stream = feed([[("A", T0, i, 1.0, 1.0)] for i in range(104)])
    _, log = run_logged(counted(stream, ["A"], "event_id % 2 = 0", "name"))
    assert log.table(spark).agg(F.sum("input_rows")).first()[0] == 104
    assert topic_stats(spark, log.batches, ["A"]).first()[:3] == ("A", 104, 52)


def test_rows_without_a_handler(spark, tmp_path):
    batch = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "topic string, n int")
    seen = {}
    keep = lambda k: lambda b, i: seen.__setitem__(k, sorted(r.n for r in b.collect()))
    E.route({"x": keep("x")}, other=keep("rest"))(batch, 0)
    assert seen == {"x": [1], "rest": [2, 3]}
    with pytest.raises(ValueError, match="no handler"):
        E.route({"x": keep("x")})(batch, 0)


def test_paths(spark, feed):
    path, _ = run_available(feed([rows_of("A", 60)[:3]]))
    assert len(pdf(spark.read.parquet(f"{path}/data"), "event_id")) == 3
