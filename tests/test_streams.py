import datetime as dt
import json
import uuid

import pytest
from helpers import T0, pdf
from pyspark.sql import functions as F

from tidemark.sources import scan as S
from tidemark.sources import serving
from tidemark.streaming import alerts as A
from tidemark.streaming import events as E
from tidemark.streaming import rollups as R
from tidemark.streaming.run import fresh_path, run_available

TICKS = "symbol string, ts timestamp, event_id int, price double, qty int"


@pytest.fixture()
def feed(spark, tmp_path):
    """Files of ticks read one per batch, in the order written."""

    def make(batches, schema):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return E.file_events(spark, str(tmp_path / "in"), schema, files_per_batch=1)

    return make


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_late_row_inside_and_beyond_the_watermark(spark, feed):
    s = feed(
        [
            [("A", at(1), 1, 10.0, 1), ("A", at(20), 2, 11.0, 1)],
            [("A", at(12), 3, 9.0, 1), ("A", at(45), 4, 12.0, 1)],  # 12 is late but inside the 10 minutes
            [("A", at(50), 5, 14.0, 1)],
            [("A", at(2), 6, 1.0, 1), ("A", at(90), 7, 13.0, 1)],  # 2 is beyond
        ],
        TICKS,
    )
    path, _ = run_available(R.tumbling_bars(s))
    got = pdf(spark.read.parquet(f"{path}/data"), "ts")
    assert got["low"].tolist() == [9.0, 11.0, 12.0]  # the row at minute 2 never shows
    assert got["volume"].tolist() == [2.0, 1.0, 2.0]


def test_update_mode_merge_equals_batch(spark, feed):
    rows = [("A" if i % 3 else "B", at(i * 7), i, float(i), 1) for i in range(60)]
    s = feed([rows[:20], rows[20:45], rows[45:]], TICKS).withColumn("pnl", F.col("price"))
    path = fresh_path(spark)
    run_available(R.pnl_rollup(s), "update", R.keep_updates(f"{path}/u"), path)
    got = pdf(R.merged(spark.read.parquet(f"{path}/u/*"), ["bucket", "symbol"]), "bucket", "symbol")
    want = pdf(R.pnl_rollup(spark.createDataFrame(rows, TICKS).withColumn("pnl", F.col("price"))), "bucket", "symbol")
    assert got[["pnl", "trades"]].values.tolist() == want[["pnl", "trades"]].values.tolist()


def test_duplicates_across_batches(spark, feed):
    s = feed([[("A", at(1), 1, 1.0, 1), ("A", at(1), 1, 1.0, 1)], [("A", at(1), 1, 1.0, 1), ("A", at(2), 2, 1.0, 1)]], TICKS)
    path, _ = run_available(E.deduplicate(s))
    assert spark.read.parquet(f"{path}/data").count() == 2


def test_malformed_json_goes_to_quarantine(spark):
    good = {"event_id": 1, "timestamp": "2024-01-01T00:00:00Z", "symbol": "A", "orders": [], "fills": [{"fill_id": "f", "order_id": "o", "quantity": "1.5", "price": "2"}]}
    raw = spark.createDataFrame([(json.dumps(good),), ("{oops",), ('{"symbol": "A"}',)], "value string")
    p = E.parse_events(raw)
    assert p.where("bad").count() == 2
    f = E.report_fills(p).first()
    assert str(f["quantity"]) == "1.50000000"


def test_texts_are_parsed_once(spark):
    good = '{"event_id": 1, "symbol": "A", "orders": [{"order_id": "o"}], "fills": [{"fill_id": "f", "quantity": 1.5}, {"fill_id": "g"}]}'
    raw = spark.createDataFrame([(good,), ("{broken",), (None,), ('{"event_id": 2, "fills": []}',)], "value string")
    p = E.parse_events(raw)
    views = E.report_fills(p), E.report_orders(p), E.good_events(p, "event.event_id", "event.symbol")
    for d in views:
        assert d._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [r["fill_id"] for r in views[0].collect()] == ["f", "g"] and [r["order_id"] for r in views[1].collect()] == ["o"]
    assert sorted(tuple(r) for r in views[2].collect()) == [(1, "A"), (2, None)]


def test_cooldown_state_survives_batches(spark, feed):
    schema = "name string, ts timestamp, value double"
    s = feed(
        [
            [("m", at(0), 9.0), ("m", at(5), 9.0)],
            [("m", at(11), 9.0), ("m", at(20), 9.0)],
            [("m", at(80), 9.0), ("m", at(81), 1.0), ("m", at(82), 9.0)],
        ],
        schema,
    )
    path, _ = run_available(A.cooldown_alerts(s, 5.0, 600, 3600))
    got = sorted(r["ts"] for r in spark.read.parquet(f"{path}/data").collect())
    assert got == [at(11), at(80)]
    rows = [("m", at(m), v) for m, v in [(0, 9.0), (5, 9.0), (11, 9.0), (20, 9.0), (80, 9.0), (81, 1.0), (82, 9.0)]]
    batch = A.spell_alerts(spark.createDataFrame(rows, schema), 5.0, 600, 3600)
    assert sorted(r["ts"] for r in batch.collect()) == [at(11), at(80)]


def test_fan_out_batch_run_twice_leaves_no_doubles(spark):
    root = fresh_path(spark)
    b = spark.createDataFrame([(1,), (2,)], "x int")
    write = E.fan_out({"t": lambda d: d}, root)
    write(b, 0)
    write(b, 0)
    write(b, 1)
    assert spark.read.parquet(f"{root}/t").count() == 4


def test_serving_tables_keep_decimals_and_retention(spark):
    root = fresh_path(spark)
    df = spark.createDataFrame([("f1", "A", "0.12345678", at(0)), ("f2", "A", "2", at(60 * 24 * 500))], "fill_id string, symbol string, price string, timestamp timestamp")
    serving.append(df, "fills", root)
    d = spark.read.parquet(f"{root}/fills")
    assert str(d.where("fill_id = 'f1'").first()["price"]) == "0.12345678"
    assert [r["month"] for r in serving.expired_months(spark, root, "fills", "2025-05-15").collect()] == ["2024-01"]
    name = f"db_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{root}/db'")
    serving.create_tables(spark, f"{root}/tables", name)
    assert spark.sql(f"SHOW TABLES IN {name}").count() == len(serving.TABLES)
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_partition_pruning_and_pushdown(spark, tmp_path):
    df = spark.createDataFrame([("A", at(i), float(i), "x") for i in range(100)], "symbol string, ts timestamp, close double, note string")
    S.write_partitioned(df, str(tmp_path / "bars"), files_per_partition=2)
    d = S.scan(spark.read.parquet(str(tmp_path / "bars")), ["ts", "close"], start="2024-01-01 01:00:00", symbols=["A"])
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan or "symbol" in plan.split("PartitionFilters")[1][:60]
    assert "note" not in plan.split("ReadSchema")[1]
    assert d.count() == 40


def test_snapshot_diff_and_hash(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "q"), (4, "n")], "k int, v string")
    got = {r["k"]: r["status"] for r in S.snapshot_diff(a, b, ["k"]).collect()}
    assert got == {1: "removed", 2: "same", 3: "changed", 4: "added"}
    assert S.content_hash(a).first() == S.content_hash(a.orderBy("v").repartition(3)).first() != S.content_hash(b).first()


@pytest.mark.parametrize("file_rows, files", [(1_000_000, 1), (40, 3)])
def test_event_stream_follows_the_data_and_keeps_rows_without_time(spark, tmp_path, monkeypatch, file_rows, files):
    from tidemark.plans import load_all, stream_queries
    from tidemark.plans.registry import QUERIES

    load_all()
    monkeypatch.setattr(stream_queries, "FILE_ROWS", file_rows)
    rows = [(i, None if i % 30 == 7 else dt.datetime(2025, 6, 1) + dt.timedelta(hours=i), 1, "view", 1.0, None) for i in range(300)]
    spark.createDataFrame(rows, stream_queries.EVENTS).repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    path, n = stream_queries.event_files(spark, str(tmp_path), False)
    assert n == files and len(spark.read.parquet(path).inputFiles()) == 3 * files
    assert QUERIES["topic_lag_stats"](spark, str(tmp_path)).first() == (300, 3)
    seen = []
    run_available(stream_queries.event_stream(spark, str(tmp_path)), "append", lambda d, _: seen.append(d.select("event_id", "ts").collect()), str(tmp_path / "run"))
    assert sorted(r.event_id for batch in seen for r in batch) == list(range(300))
    spans = [(min(x), max(x)) for x in ([r.ts for r in batch if r.ts] for batch in seen)]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and sorted(map(len, seen))[0] > 80
