"""Streaming operators run on the event files with ``availableNow``, each compared with its batch SQL."""

from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.operators.frames import CHUNK, balanced_chunks
from tidemark.operators.plugins import apply_blocks, run_detectors, run_strategies
from tidemark.operators.sequences import non_overlapping, space_out
from tidemark.plans.registry import query
from tidemark.plans.report_queries import rounded
from tidemark.plans.sqltext import pct, std
from tidemark.plans.validation_queries import FEATURES, features
from tidemark.plans.window_queries import b1
from tidemark.session import materialize, prepare
from tidemark.sources.scan import as_ts
from tidemark.sources.standins import bars, logs, round_trips, table, ticks
from tidemark.streaming import alerts as A
from tidemark.streaming import book as B
from tidemark.streaming import events as E
from tidemark.streaming import rollups as R
from tidemark.streaming import keyed as K
from tidemark.streaming.run import counted, fresh_path, run_available, run_logged, topic_stats

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


FILE_ROWS = 100_000  # a file is one task at most
_files: dict[tuple, tuple[str, int]] = {}


def event_files(spark, sf, late: bool) -> tuple[str, int]:
    """The events as thirds in order of time, written once, and the number of files of each.

    Files hold about ``FILE_ROWS`` rows. Rows without a time are in the first third.
    ``late`` adds a last part that delivers old events again.
    """
    slot = (spark.sparkContext.applicationId, sf, late)
    if slot not in _files:
        path = f"{fresh_path(spark)}/events"
        d = table(spark, sf, "events")
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        cuts = d.select(at.cast("double").alias("t")).approxQuantile("t", [1 / 3, 2 / 3], 0.001)
        third = sum((F.coalesce(at >= int(c), F.lit(False)).cast("int") for c in cuts), F.lit(0))
        counts = {r["k"]: r["n"] for r in d.groupBy(third.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
        files = -(-max(counts.values(), default=1) // FILE_ROWS)
        parts = [third == k for k in sorted(counts)] + ([(third == 0) & (F.col("event_id") % 10 == 0)] if late else [])
        for k, part in enumerate(parts, 1):  # one after the other: a file source takes files by age
            d.where(part).repartition(files).write.mode("append").parquet(path)
            for _ in range(k * files - len(spark.read.schema(EVENTS).parquet(path).inputFiles())):  # few rows: a batch still ends with its part
                d.limit(0).write.mode("append").parquet(path)
        if not parts:
            d.write.parquet(path)
        _files[slot] = path, files
    return _files[slot]


def event_stream(spark, sf, late: bool = False):
    """The events as a stream of one third a batch, with TIMESTAMP event time."""
    prepare(spark)
    path, files = event_files(spark, sf, late)
    d = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def metric_rows(spark, sf):
    """Metric rows cut into slices of equal size."""
    m = table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("name"), "value")
    return balanced_chunks(m, ["name"], ["ts", "event_id"])


def raw_ticks(s):
    return s.select(
        F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("int").alias("qty"),
    )


_LAST = "(SELECT max(ts) FROM events)"


@query(
    "tumbling_bars",
    f"""SELECT event_type AS symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, arg_min(value,(ts,event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value,(ts,event_id)) AS close,
        sum(CAST(json_extract_string(props,'$.k') AS INT))::DOUBLE AS volume FROM events GROUP BY 1,2 HAVING time_bucket(INTERVAL 15 MINUTE, any_value(ts)) + INTERVAL 15 MINUTE <= {_LAST} - INTERVAL 10 MINUTE""",
)
def _(spark, sf):
    path, _ = run_available(R.tumbling_bars(raw_ticks(event_stream(spark, sf))))
    return ntz(spark.read.parquet(f"{path}/data"), "ts")


@query(
    "stream_rollup",
    """SELECT date_trunc('hour',ts) AS bucket, event_type AS symbol, round(sum(value-50),6) AS pnl, count(*) AS trades FROM events GROUP BY 1,2""",
)
def _(spark, sf):
    s = event_stream(spark, sf).select(F.col("event_type").alias("symbol"), "ts", (F.col("value") - 50).alias("pnl"))
    path = fresh_path(spark)
    run_available(R.pnl_rollup(s), "update", R.keep_updates(f"{path}/u"), path)
    return rounded(ntz(R.merged(spark.read.parquet(f"{path}/u/*"), ["bucket", "symbol"]), "bucket"))


@query(
    "sliding_monitor",
    """WITH w AS (SELECT event_type AS name, value, unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 4 MINUTE, time_bucket(INTERVAL 1 MINUTE, ts), INTERVAL 1 MINUTE)) AS start_ts FROM events)
       SELECT start_ts, name, count(*) AS n, round(avg(value),6) AS mean, min(value) AS low, max(value) AS high FROM w GROUP BY 1,2""",
)
def _(spark, sf):
    s = event_stream(spark, sf).select(F.col("event_type").alias("name"), "ts", "value")
    path = fresh_path(spark)
    run_available(R.sliding_stats(s), "update", R.keep_updates(f"{path}/u"), path)
    return rounded(ntz(R.merged(spark.read.parquet(f"{path}/u/*"), ["start_ts", "name"]), "start_ts"))


@query(
    "session_activity",
    f"""WITH l AS (SELECT *, coalesce(epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 1800000000, true)::INT AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l)
        SELECT user_id, min(ts) AS start_ts, max(ts)+INTERVAL 30 MINUTE AS end_ts, count(*) AS events, round(sum(value),6) AS total FROM s GROUP BY user_id, k HAVING max(ts)+INTERVAL 30 MINUTE <= {_LAST} - INTERVAL 10 MINUTE""",
)
def _(spark, sf):
    path, _ = run_available(R.sessions(event_stream(spark, sf)))
    return rounded(ntz(spark.read.parquet(f"{path}/data"), "start_ts", "end_ts"))


@query(
    "latest_state",
    """SELECT event_type AS symbol, max(ts) AS ts, arg_max(event_id,(ts,event_id)) AS event_id, arg_max(value,(ts,event_id)) AS price FROM events GROUP BY 1""",
)
def _(spark, sf):
    path = fresh_path(spark)
    run_available(R.latest_state(raw_ticks(event_stream(spark, sf)), ["price"]), "update", R.keep_updates(f"{path}/u"), path)
    return ntz(R.newest(spark.read.parquet(f"{path}/u/*")), "ts")


def report_json():
    side = F.when(F.col("value") > 50, "BUY").otherwise("SELL")
    oid = F.concat(F.lit("o"), F.col("event_id").cast("string"))
    k = F.get_json_object("props", "$.k").cast("int")

    def fill(n, q):
        return F.struct(F.concat(oid, F.lit(f"-{n}")).alias("fill_id"), oid.alias("order_id"), q.cast("decimal(38,8)").alias("quantity"), F.col("value").cast("decimal(38,8)").alias("price"))

    body = F.struct(
        "event_id", F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("symbol"),
        F.array(F.struct(oid.alias("order_id"), side.alias("side"), k.cast("decimal(38,8)").alias("quantity"))).alias("orders"),
        F.array(fill(1, F.floor(k / 2)), fill(2, k - F.floor(k / 2))).alias("fills"),
    )
    # every 50th event is broken on purpose
    return F.when(F.pmod("event_id", F.lit(50)) == 49, F.lit("{broken")).otherwise(F.to_json(body))


@query(
    "event_fanout",
    """WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props,'$.k') AS INT) AS k, value FROM events WHERE event_id % 50 <> 49)
       SELECT 'fills' AS "table", event_type AS symbol, 2*count(*) AS rows, sum(k)::DOUBLE AS quantity FROM e GROUP BY 2
       UNION ALL SELECT 'orders', event_type, count(*), sum(k)::DOUBLE FROM e GROUP BY 2 UNION ALL SELECT 'quarantine', NULL, count(*), NULL FROM events WHERE event_id % 50 = 49""",
)
def _(spark, sf):
    raw = event_stream(spark, sf).select(report_json().alias("value"))
    path = fresh_path(spark)
    derive = {
        "fills": E.report_fills,
        "orders": E.report_orders,
        "quarantine": lambda b: b.where("bad").select("value"),
    }
    parsed = E.parse_events(raw).select("event", "bad", F.when(F.col("bad"), F.col("value")).alias("value"))  # parsed once for all tables
    run_available(parsed, "append", E.fan_out(derive, path), path)
    out = None
    for t in ("fills", "orders"):
        d = spark.read.parquet(f"{path}/{t}").groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("quantity").cast("double").alias("quantity"))
        d = d.select(F.lit(t).alias("table"), "symbol", "rows", "quantity")
        out = d if out is None else out.unionByName(d)
    bad = spark.read.parquet(f"{path}/quarantine").agg(F.count(F.lit(1)).alias("rows"))
    return out.unionByName(bad.select(F.lit("quarantine").alias("table"), F.lit(None).cast("string").alias("symbol"), "rows", F.lit(None).cast("double").alias("quantity")))


@query(
    "event_source",
    """SELECT event_type AS symbol, count(*) AS parsed, round(sum(value),6) AS total FROM events WHERE event_id % 50 <> 49 GROUP BY 1""",
)
def _(spark, sf):
    raw = event_stream(spark, sf).select(report_json().alias("value"))
    price = F.element_at("event.fills", 1)["price"].cast("double").alias("value")
    path, _ = run_available(E.good_events(E.parse_events(raw), "event.symbol", price))
    d = spark.read.parquet(f"{path}/data").groupBy("symbol")
    return rounded(d.agg(F.count(F.lit(1)).alias("parsed"), F.sum("value").alias("total")))


@query("event_handler_hook", "SELECT event_type AS kind, count(*) AS rows FROM events GROUP BY 1")
def _(spark, sf):
    path = fresh_path(spark)

    def saver(kind):
        def save(batch, batch_id):  # a batch that runs twice overwrites its own folder
            batch.write.mode("overwrite").parquet(f"{path}/handled/{kind}/b{batch_id}")

        return save

    kinds = ("click", "error", "purchase")
    run_available(event_stream(spark, sf), "append", E.route({k: saver(k) for k in kinds}, "event_type", saver("other")), path)
    return spark.read.parquet(f"{path}/handled/*/*").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("rows"))


@query("topic_lag_stats", "SELECT count(*) AS input_rows, 3::BIGINT AS batches_with_rows FROM events")
def _(spark, sf):
    _, log = run_logged(event_stream(spark, sf).select("event_id"))
    return log.table(spark).agg(F.sum("input_rows").alias("input_rows"), F.count_if(F.col("input_rows") > 0).alias("batches_with_rows"))


@query(
    "topic_error_stats",
    "SELECT event_type AS topic, count(*) AS processed, count(CASE WHEN event_id % 50 = 49 THEN 1 END) AS errors, NULL::BIGINT AS lag FROM events WHERE event_type IS NOT NULL GROUP BY 1",
)
def _(spark, sf):
    kinds = sorted(r[0] for r in table(spark, sf, "events").where("event_type is not null").select("event_type").distinct().collect())
    raw = event_stream(spark, sf).select(F.col("event_type").alias("topic"), report_json().alias("value"))
    _, log = run_logged(counted(E.parse_events(raw), kinds).select("topic", "bad"))
    return topic_stats(spark, log.batches, kinds)


@query(
    "anomaly_detector_plugin",
    """SELECT l_orderkey, l_partkey, 'large_fill' AS detector FROM lineitem WHERE l_quantity>=49 UNION ALL SELECT l_orderkey, l_partkey, 'high_tax' FROM lineitem WHERE l_tax>=0.08 AND l_discount<=0.01""",
)
def _(spark, sf):
    detectors = {
        "large_fill": lambda d: d.where("l_quantity >= 49"),
        "high_tax": lambda d: d.where("l_tax >= 0.08 AND l_discount <= 0.01"),
    }
    return run_detectors(table(spark, sf, "lineitem"), detectors, ["l_orderkey", "l_partkey"])


@query("late_and_dedup", "SELECT event_type, count(*) AS events, round(sum(value),6) AS total FROM events GROUP BY 1")
def _(spark, sf):
    s = event_stream(spark, sf, late=True)  # old events come again long after the watermark
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))  # at-least-once delivery
    path, _ = run_available(E.deduplicate(twice))
    return rounded(spark.read.parquet(f"{path}/data").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")))


@query(
    "risk_limit_alerts",
    """WITH m AS (SELECT event_id, value*1000 AS var, value/400 AS drawdown, CAST(json_extract_string(props,'$.k') AS INT)/30.0::DOUBLE AS leverage FROM events)
       SELECT event_id, 'VAR_LIMIT' AS type, round(var,6) AS value, 200000.0::DOUBLE AS "limit" FROM m WHERE var>200000 UNION ALL SELECT event_id, 'DRAWDOWN_LIMIT', round(drawdown,6), 0.2 FROM m WHERE drawdown>0.2
       UNION ALL SELECT event_id, 'LEVERAGE_LIMIT', round(leverage,6), 3.0 FROM m WHERE leverage>3""",
)
def _(spark, sf):
    s = event_stream(spark, sf).select(
        "event_id", (F.col("value") * 1000).alias("var"), (F.col("value") / 400).alias("drawdown"),
        (F.get_json_object("props", "$.k").cast("int") / 30.0).alias("leverage"),
    )
    path, _ = run_available(A.limit_alerts(s, ["event_id"]))
    return rounded(spark.read.parquet(f"{path}/data"))


@query(
    "dynamic_threshold_alerts",
    """WITH w AS (SELECT event_id, event_type AS name, value, count(*) OVER w AS n, quantile_cont(value,0.95) OVER w AS q, avg(value) OVER w + 3*stddev_samp(value) OVER w AS s FROM events
         WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))
       SELECT event_id, name, round(q,6) AS limit_pct, round(s,6) AS limit_sigma, value>q AS above_pct, value>s AS above_sigma FROM w WHERE n>=20 AND (value>q OR value>s)""",
)
def _(spark, sf):
    m = metric_rows(spark, sf)
    d = A.dynamic_thresholds(m, order=("ts", "event_id"))
    return rounded(d.select("event_id", "name", "limit_pct", "limit_sigma", "above_pct", "above_sigma"))


@query(
    "violation_spells",
    """WITH a AS (SELECT event_type AS name, ts, event_id, value, value>60 AS above, value>60 IS DISTINCT FROM lag(value>60) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS new FROM events), i AS (SELECT *, sum(new::INT) OVER (PARTITION BY name ORDER BY ts, event_id)::BIGINT AS island FROM a)
       SELECT name, island, min(ts) AS start_ts, max(ts) AS end_ts, max(value) AS peak, count(*) AS rows FROM i WHERE above GROUP BY 1,2 HAVING epoch_us(max(ts))-epoch_us(min(ts)) >= 1800000000""",
)
def _(spark, sf):
    m = metric_rows(spark, sf)
    return A.violation_spells(m, 60.0, 1800.0, order=("ts", "event_id"))


_COOL = """WITH RECURSIVE a AS (SELECT event_type AS name, ts, event_id, value, value>60 AS above, value>60 IS DISTINCT FROM lag(value>60) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS new FROM events),
       i AS (SELECT *, sum(new::INT) OVER (PARTITION BY name ORDER BY ts, event_id) AS island FROM a), e AS (SELECT name, ts, value FROM (SELECT *, min(ts) OVER (PARTITION BY name, island) AS since FROM i WHERE above) WHERE epoch_us(ts)-epoch_us(since) >= 600000000),
       n AS (SELECT e.name, e.ts, e.value, y.ts AS nx FROM e ASOF LEFT JOIN (SELECT name, ts FROM e) y ON e.name=y.name AND e.ts + INTERVAL 1 HOUR <= y.ts),
       p AS (SELECT n.* FROM n JOIN (SELECT name, min(ts) AS ts FROM e GROUP BY 1) f ON n.name=f.name AND n.ts=f.ts UNION ALL SELECT n.* FROM p JOIN n ON p.name=n.name AND p.nx=n.ts) SELECT name, ts, value FROM p"""


@query("alert_cooldown_batch", _COOL)
def _(spark, sf):
    m = metric_rows(spark, sf)
    return A.spell_alerts(m, 60.0, 600.0, 3600.0, order=("ts", "event_id")).select("name", "ts", "value")


@query("alert_duration_cooldown", _COOL)
def _(spark, sf):
    s = event_stream(spark, sf).select(F.col("event_type").alias("name"), "ts", "value")
    path, _ = run_available(A.cooldown_alerts(s, 60.0, 600.0, 3600.0))
    return ntz(spark.read.parquet(f"{path}/data"), "ts")


#: Rows whose slot of 6 hours ended before the last watermark (in milliseconds).
_SLOT = f"time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR < date_trunc('milliseconds', {_LAST}) - INTERVAL 10 MINUTE"


def keyed_run(stream, step):
    """Results of a step over the stream, and late rows left out."""
    with K.uses_rocks(stream.sparkSession):
        path, log = run_logged(K.in_order(stream, step, slot="6 hours", keep="10 days"))
    return stream.sparkSession.read.parquet(f"{path}/data").where("late is null").drop("late")


def keyed_stream(spark, sf, **values):
    """The event stream with late repeats, which change nothing."""
    s = event_stream(spark, sf, late=True)
    return s.select(F.col("event_type").alias("name"), "ts", "event_id", *[c.cast("double").alias(k) for k, c in values.items()])


@query("alert_cooldown_stream", _COOL.replace("FROM events),", f"FROM events WHERE {_SLOT}),", 1))
def _(spark, sf):
    d = keyed_run(keyed_stream(spark, sf, value=F.col("value")), K.cooldown(60.0, 600.0, 3600.0))
    return ntz(d.select("name", "ts", "value"), "ts")


@query(
    "dynamic_threshold_stream",
    f"""WITH w AS (SELECT event_id, ts, event_type AS name, value, count(*) OVER w AS n, quantile_cont(value,0.95) OVER w AS q, avg(value) OVER w + 3*stddev_samp(value) OVER w AS s FROM events
         WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))
       SELECT event_id, name, round(q,6) AS limit_pct, round(s,6) AS limit_sigma, value>q AS above_pct, value>s AS above_sigma FROM w WHERE n>=20 AND (value>q OR value>s) AND {_SLOT}""",
)
def _(spark, sf):
    d = keyed_run(keyed_stream(spark, sf, value=F.col("value")), K.trailing_thresholds())
    return rounded(d.select("event_id", "name", "limit_pct", "limit_sigma", "above_pct", "above_sigma"))


_TRAIL = """WITH l AS (SELECT event_type AS name, ts, event_id, value AS price, CAST(json_extract_string(props,'$.k') AS DOUBLE) AS volume,
         abs(value/nullif(lag(value) OVER o,0)-1) AS r, (epoch_us(ts)-epoch_us(lag(ts) OVER o))/1e6 AS gap, (value = lag(value) OVER o)::INT AS same, row_number() OVER o AS i FROM events WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id)),
       w AS (SELECT *, quantile_cont(r,0.99) OVER n AS q, quantile_cont(gap,0.5) OVER n AS med, sum(same) OVER f AS still, count(volume) OVER v AS m, (volume-avg(volume) OVER v)/nullif(stddev_samp(volume) OVER v,0) AS z FROM l
         WINDOW n AS (PARTITION BY name ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), f AS (PARTITION BY name ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), v AS (PARTITION BY name ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
       a AS (SELECT name, ts, event_id, unnest(list_filter([CASE WHEN i>=20 AND r>greatest(q,0.1) THEN 0 END, CASE WHEN m>=20 AND abs(z)>3 THEN 1 END, CASE WHEN i>=5 AND gap>3*med THEN 2 END, CASE WHEN still>=5 THEN 3 END], lambda x: x IS NOT NULL)) AS detector FROM w)
       SELECT name, event_id, detector FROM a"""


def volume_of():
    return F.get_json_object("props", "$.k")


@query("trailing_anomalies", _TRAIL)
def _(spark, sf):
    m = table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("name"), F.col("value").alias("price"), volume_of().cast("double").alias("volume"))
    return Q.trailing_anomalies(balanced_chunks(m, ["name"], ["ts", "event_id"])).select("name", "event_id", "detector")


@query("anomaly_detectors_stream", _TRAIL + f" WHERE {_SLOT}")
def _(spark, sf):
    d = keyed_run(keyed_stream(spark, sf, price=F.col("value"), volume=volume_of()), K.trailing_anomalies())
    return d.select("name", "event_id", "detector")


@query(
    "book_flow_stream",
    f"""WITH l AS (SELECT event_id, event_type AS name, value AS price, CAST(json_extract_string(props,'$.k') AS DOUBLE) AS qty, row_number() OVER w AS i, lag(value,9) OVER w AS p9, lag(CAST(json_extract_string(props,'$.k') AS DOUBLE),4) OVER w AS q4, lag(ts,9) OVER w AS t9, ts FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
       s AS (SELECT *, CASE WHEN i>=10 THEN regr_slope(price,i) OVER (PARTITION BY name ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS slope FROM l)
       SELECT event_id, name, round(price/nullif(p9,0)-1,6) AS momentum, round(slope,6) AS slope, round(qty/nullif(q4,0)-1,6) AS depth_change, round(9/nullif((epoch_us(ts)-epoch_us(t9))/1e6,0),6) AS update_rate FROM s WHERE {_SLOT}""",
)
def _(spark, sf):
    d = keyed_run(keyed_stream(spark, sf, mid=F.col("value"), depth=volume_of()), K.trailing_flow())
    return rounded(d.select("event_id", "name", "momentum", "slope", "depth_change", "update_rate"))


@query(
    "stream_quality_score",
    """WITH e AS (SELECT date_trunc('day',ts) AS day, event_type AS symbol, count(*) AS rows, avg((value>0.5)::INT) AS valid, avg((json_extract_string(props,'$.k') IS NOT NULL)::INT) AS complete FROM events GROUP BY 1,2)
       SELECT day, symbol, rows, round((valid+complete)/2,6) AS score, (valid+complete)/2 < 0.99 AS alert FROM e""",
)
def _(spark, sf):
    s = event_stream(spark, sf)
    path = fresh_path(spark)
    k = F.get_json_object("props", "$.k")

    def per_batch(batch, batch_id):
        d = batch.groupBy(F.window("ts", "1 day").start.alias("day"), F.col("event_type").alias("symbol")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum((F.col("value") > 0.5).cast("int")).alias("valid"), F.count(k).alias("complete")
        )
        d.write.mode("overwrite").parquet(f"{path}/q/b{batch_id}")

    run_available(s, "append", per_batch, path)
    d = spark.read.parquet(f"{path}/q/*").groupBy("day", "symbol").agg(*[F.sum(c).alias(c) for c in ("rows", "valid", "complete")])
    score = (F.col("valid") + F.col("complete")) / (F.col("rows") * 2)
    return rounded(ntz(d.select("day", "symbol", "rows", score.alias("score"), (score < 0.99).alias("alert")), "day"))


@query(
    "order_book_metrics",
    """WITH b AS (SELECT vec_id, 100 - abs(embedding[1]::DOUBLE) AS bid, 100 + abs(embedding[2]::DOUBLE) AS ask, list_sum(list_transform(embedding[1:10], lambda x: abs(x::DOUBLE))) AS bd, list_sum(list_transform(embedding[11:20], lambda x: abs(x::DOUBLE))) AS ad FROM embeddings)
       SELECT vec_id, round(bid,6) AS best_bid, round(ask,6) AS best_ask, round(ask-bid,6) AS spread, round((ask-bid)*100/((ask+bid)/2),6) AS spread_pct, round(bd,6) AS bid_depth, round(ad,6) AS ask_depth, round((bd-ad)/(bd+ad),6) AS imbalance FROM b""",
)
def _(spark, sf):
    e = F.col("embedding")

    def side(a, sign, first):
        best = F.lit(100.0) + F.abs(F.element_at(e, first).cast("double")) * sign
        return F.transform(F.slice(e, a, 10), lambda x: F.struct(best.alias("price"), F.abs(x.cast("double")).alias("qty")))

    d = table(spark, sf, "embeddings").select("vec_id", side(1, -1, 1).alias("bids"), side(11, 1, 2).alias("asks"))
    m = B.book_metrics()
    return rounded(d.withColumns(m).select("vec_id", *m))


@query(
    "book_flow",
    """WITH l AS (SELECT event_id, symbol, price, qty, row_number() OVER w AS i, lag(price,9) OVER w AS p9, lag(qty,4) OVER w AS q4, lag(ts,9) OVER w AS t9, ts FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)),
       s AS (SELECT *, CASE WHEN i>=10 THEN regr_slope(price,i) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS slope FROM l)
       SELECT event_id, symbol, round(price/p9-1,8) AS momentum, round(slope,6) AS slope, round(qty/nullif(q4,0)-1,6) AS depth_change, CASE WHEN price/p9-1>0.001 THEN 'up' WHEN price/p9-1 < -0.001 THEN 'down' WHEN p9 IS NOT NULL THEN 'flat' END AS direction FROM s""",
)
def _(spark, sf):
    t = ticks(spark, sf).select("event_id", "symbol", "ts", F.col("price").alias("mid"), F.col("qty").alias("depth"), CHUNK)
    d = B.book_flow(t, order=("ts", "event_id"))
    return rounded(d.select("event_id", "symbol", "momentum", "slope", "depth_change", "direction"), momentum=8)


_DET = f"""r AS (SELECT symbol, ts, abs(ret) AS a, volume, (volume-avg(volume) OVER w)/nullif(stddev_samp(volume) OVER w,0) AS z, count(*) OVER w AS n, epoch(ts)-epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS gap FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
        q AS (SELECT symbol, greatest(quantile_cont(a,0.99),0.02) AS q, quantile_cont(gap,0.5) AS med FROM r GROUP BY 1)"""


@query(
    "anomaly_detectors",
    f"""WITH {_DET} SELECT r.symbol, ts, 'spike' AS detector FROM r JOIN q ON r.symbol=q.symbol WHERE a>q UNION ALL SELECT symbol, ts, 'volume' FROM r WHERE n>=20 AND z>3
        UNION ALL SELECT r.symbol, ts, 'gap' FROM r JOIN q ON r.symbol=q.symbol WHERE gap>3*med""",
)
def _(spark, sf):
    from tidemark.operators.frames import framed
    from tidemark.operators.order_stats import exact_quantiles, join_stats
    from tidemark.operators.series import with_returns
    from tidemark.session import settle

    b = settle(with_returns(b1(spark, sf, "close", "volume")))

    def spike(d):
        s = exact_quantiles(d, F.abs("ret"), {"_q": 0.99}, ["symbol"])
        return join_stats(d, s, ["symbol"]).where(F.abs("ret") > F.greatest("_q", F.lit(0.02)))

    def volume(d):
        def build(x, fr):
            s = fr.std("volume", 20)
            return x.withColumn("_z", (F.col("volume") - fr.mean("volume", 20)) / F.when(s > 0, s))

        return framed(d, build, before=20).where("_z > 3")

    def gap(d):
        g = Q.with_gap(d)
        m = exact_quantiles(g, F.col("gap"), {"_m": 0.5}, ["symbol"])
        return join_stats(g, m, ["symbol"]).where(F.col("gap") > F.col("_m") * 3)

    return run_detectors(b, {"spike": spike, "volume": volume, "gap": gap})


@query(
    "anomaly_detectors_full",
    """WITH l AS (SELECT *, close = lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS same, epoch(ts)-epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS gap FROM rets),
       r AS (SELECT symbol, ts, abs(ret) AS a, gap, (volume-avg(volume) OVER w)/nullif(stddev_samp(volume) OVER w,0) AS z, count(*) OVER w AS n, count(CASE WHEN same THEN 1 END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS still
         FROM l WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
       q AS (SELECT symbol, greatest(quantile_cont(a,0.99),0.1) AS q, quantile_cont(gap,0.5) AS med FROM r GROUP BY 1)
       SELECT r.symbol, ts, 'spike' AS detector FROM r JOIN q ON r.symbol=q.symbol WHERE a>q UNION ALL SELECT symbol, ts, 'volume' FROM r WHERE n>=20 AND abs(z)>3
       UNION ALL SELECT r.symbol, ts, 'gap' FROM r JOIN q ON r.symbol=q.symbol WHERE gap>3*med UNION ALL SELECT symbol, ts, 'frozen' FROM r WHERE still=5""",
)
def _(spark, sf):
    return Q.anomalies(b1(spark, sf, "close", "volume"))


@query(
    "non_overlapping_trades",
    """WITH RECURSIVE e AS (SELECT symbol, ts, ts + to_minutes(30 + 60*(trades % 4)::INT) AS exit_ts FROM bars15 WHERE close < open), n AS (SELECT e.symbol, e.ts, e.exit_ts, y.ts AS nx FROM e ASOF LEFT JOIN e y ON e.symbol=y.symbol AND e.exit_ts <= y.ts),
       p AS (SELECT n.* FROM n JOIN (SELECT symbol, min(ts) AS ts FROM e GROUP BY 1) f ON n.symbol=f.symbol AND n.ts=f.ts UNION ALL SELECT n.* FROM p JOIN n ON p.symbol=n.symbol AND p.nx=n.ts) SELECT symbol, ts, exit_ts FROM p""",
)
def _(spark, sf):
    b = bars(spark, sf, 900).where("close < open")
    mins = (F.pmod("trades", F.lit(4)) * 60 + 30).cast("int")
    d = b.select("symbol", "ts", (F.col("ts") + F.make_dt_interval(mins=mins)).alias("exit_ts"))
    return non_overlapping(d, rows=500)


@query(
    "signal_spacing_sequential",
    """WITH RECURSIVE e AS (SELECT symbol, ts, trade_id FROM round_trips WHERE confidence >= 0.5), n AS (SELECT e.symbol, e.ts, e.trade_id, y.ts AS nx FROM e ASOF LEFT JOIN (SELECT symbol, ts FROM e) y ON e.symbol=y.symbol AND e.ts + INTERVAL 2 HOUR <= y.ts),
       p AS (SELECT n.* FROM n JOIN (SELECT symbol, min(ts) AS ts FROM e GROUP BY 1) f ON n.symbol=f.symbol AND n.ts=f.ts UNION ALL SELECT n.* FROM p JOIN n ON p.symbol=n.symbol AND p.nx=n.ts) SELECT symbol, ts, trade_id FROM p""",
)
def _(spark, sf):
    d = round_trips(spark, sf).where("confidence >= 0.5").select("symbol", "ts", "trade_id")
    return space_out(d, 7200, ["symbol"], tie=["trade_id"])


@query(
    "rolling_apply",
    """WITH x AS (SELECT symbol, ts, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS xs FROM bars)
       SELECT symbol, ts, round(CASE WHEN len(xs)>=20 THEN list_sum(list_transform(xs, lambda v, i: v*i))/210 END,6) AS wma FROM x""",
)
def _(spark, sf):
    def weighted(pdf):
        import numpy as np

        w = np.arange(1, 21) / 210.0
        return pdf.assign(wma=pdf["close"].rolling(20).apply(lambda v: float(v @ w), raw=True))

    d = apply_blocks(b1(spark, sf), weighted, "symbol STRING, ts TIMESTAMP_NTZ, wma DOUBLE", before=20)
    return rounded(d)


@query(
    "strategy_callback",
    f"""WITH x AS (SELECT symbol, ts, {pct('close')} AS r FROM bars), p(param_id, lim) AS (VALUES (0,-0.005::DOUBLE),(1,-0.01::DOUBLE)) SELECT param_id::INT AS param_id, symbol, ts, r < lim AS enter FROM x, p""",
)
def _(spark, sf):
    def dips(pdf, params):
        r = pdf["close"] / pdf["close"].shift(1) - 1
        return pdf.assign(enter=(r < params["limit"]).where(r.notna(), None))

    d = run_strategies(b1(spark, sf), dips, [{"limit": -0.005}, {"limit": -0.01}], "symbol STRING, ts TIMESTAMP_NTZ, enter BOOLEAN", before=1)
    return d


def scored_folds(spark, sf):
    """Scores of the models, written once per application."""
    from tidemark.operators.models import fold_scores
    from tidemark.operators.validation import purged_folds

    f = features(spark, sf).where("label IS NOT NULL")
    return materialize(spark, f"scored_folds:{sf}", lambda: fold_scores(purged_folds(f, 5, 12, 12), FEATURES, "label", 5))


@query("fold_model_scoring")
def _(spark, sf):
    return scored_folds(spark, sf)


@query(
    "fold_model_rows",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts)-1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM feats WHERE label IS NOT NULL)
       SELECT symbol, ts, least(i // (n//5), 4)::INT AS fold, label, true AS in_range, true AS mixed FROM n WHERE rsi IS NOT NULL AND volume_ratio IS NOT NULL AND volatility IS NOT NULL AND momentum IS NOT NULL""",
)
def _(spark, sf):
    """Every row with features is scored once, in the fold of its block; scores are probabilities and the mean lies between the models'."""
    d = scored_folds(spark, sf)
    scores = [F.col(c) for c in ("score_forest", "score_boosted", "score")]
    inside = scores[0].between(0, 1) & scores[1].between(0, 1)
    mixed = scores[2].between(F.least(*scores[:2]) - 1e-9, F.greatest(*scores[:2]) + 1e-9)
    return d.select("symbol", "ts", "fold", "label", inside.alias("in_range"), mixed.alias("mixed"))


_Z = """WITH f AS (SELECT symbol, ts, rsi, volume_ratio, volatility, momentum FROM feats WHERE rsi IS NOT NULL AND volume_ratio IS NOT NULL AND volatility IS NOT NULL AND momentum IS NOT NULL),
       t AS (SELECT * FROM f WHERE ts < TIMESTAMP '2024-01-20'), s AS (SELECT avg(rsi) AS a1, stddev_samp(rsi) AS b1, avg(volume_ratio) AS a2, stddev_samp(volume_ratio) AS b2, avg(volatility) AS a3, stddev_samp(volatility) AS b3, avg(momentum) AS a4, stddev_samp(momentum) AS b4 FROM t),
       z AS (SELECT symbol, ts, (rsi-a1)/b1 AS z1, (volume_ratio-a2)/b2 AS z2, (volatility-a3)/b3 AS z3, (momentum-a4)/b4 AS z4 FROM f, s)"""


@query("pca_features", f"{_Z} SELECT symbol, ts, round(z1*z1+z2*z2+z3*z3+z4*z4,6) AS square, 4 AS components FROM z")
def _(spark, sf):
    """All four components; a rotation keeps the sum of squares of a row."""
    from tidemark.operators.models import pca_features

    d, found = pca_features(features(spark, sf), FEATURES, as_ts("2024-01-20"))
    square = sum((F.col(f"pc_{k + 1}") * F.col(f"pc_{k + 1}") for k in range(len(found.variances))), F.lit(0.0))
    return rounded(d.select("symbol", "ts", square.alias("square"), F.lit(len(found.variances)).alias("components")))


@query(
    "pca_variances",
    f"""{_Z}, c AS (SELECT corr(z1,z2) AS p, corr(z1,z3) AS q, corr(z1,z4) AS r, corr(z2,z3) AS s, corr(z2,z4) AS t, corr(z3,z4) AS u FROM z WHERE ts < TIMESTAMP '2024-01-20')
       SELECT 4.0::DOUBLE AS total, round(4 + 2*(p*p+q*q+r*r+s*s+t*t+u*u),6) AS squares,
       round(1 + p*p*u*u + q*q*t*t + r*r*s*s - p*p - q*q - r*r - s*s - t*t - u*u + 2*(p*q*s + p*r*t + q*r*u + s*t*u) - 2*(p*q*t*u + p*r*s*u + q*r*s*t),6) AS product FROM c""",
)
def _(spark, sf):
    """Variances of the components on the training rows: their sum, sum of squares and product are those of the correlation matrix."""
    from tidemark.operators.models import pca_features

    d, found = pca_features(features(spark, sf), FEATURES, as_ts("2024-01-20"))
    own = d.where(F.col("ts") < as_ts("2024-01-20")).agg(*[F.var_samp(f"pc_{k + 1}").alias(f"v{k}") for k in range(len(found.variances))])
    v = [F.col(f"v{k}") for k in range(len(found.variances))]
    product = v[0]
    for x in v[1:]:
        product = product * x
    return rounded(own.select(sum(v, F.lit(0.0)).alias("total"), sum((x * x for x in v), F.lit(0.0)).alias("squares"), product.alias("product")))


__all__ = ["logs", "std"]
