"""Bars, gap grids, normalising, joins on time."""

from pyspark.sql import functions as F

from tidemark.functions.core import r6
from tidemark.operators import bars as B
from tidemark.operators import temporal_joins as J
from tidemark.plans.registry import query
from tidemark.sources.standins import bars, table, ticks

OHLCV = ("open", "high", "low", "close", "volume")


@query("ticks_to_bars", "SELECT symbol, ts, open, high, low, close, volume, trades FROM bars15")
def _(spark, sf):
    return bars(spark, sf, 900)


@query("ohlcv_resample", "SELECT symbol, ts, open, high, low, close, volume FROM bars4h")
def _(spark, sf):
    return B.resample(bars(spark, sf), 14_400)


@query(
    "scan_bars",
    """SELECT ts, close, volume FROM bars WHERE symbol='purchase'
       AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'""",
)
def _(spark, sf):
    from tidemark.sources.scan import scan

    return scan(
        bars(spark, sf), ["ts", "close", "volume"], "2024-01-05", "2024-01-20 12:00:00", equals={"symbol": "purchase"}
    )


@query(
    "scan_multi_symbol",
    "SELECT symbol, ts, close FROM bars WHERE symbol IN ('purchase','view','click') AND ts >= TIMESTAMP '2024-01-10'",
)
def _(spark, sf):
    from tidemark.sources.scan import scan

    return scan(bars(spark, sf), ["symbol", "ts", "close"], "2024-01-10", symbols=["purchase", "view", "click"])


@query(
    "time_range_filter",
    """SELECT order_id, symbol, quantity, ts FROM fills
       WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'""",
)
def _(spark, sf):
    from tidemark.sources.scan import scan
    from tidemark.sources.standins import fills

    return scan(fills(spark, sf), ["order_id", "symbol", "quantity", "ts"], "1997-01-01", "1997-06-30")


@query(
    "normalize_bars",
    """WITH raw AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, TRY_CAST(value::VARCHAR AS DOUBLE) AS close,
         CASE WHEN value > 200 THEN NULL ELSE value END AS volume FROM events)
       SELECT symbol, ts, min_by(close,(close,volume)) AS close, min_by(volume,(close,volume)) AS volume FROM raw
       WHERE close IS NOT NULL AND volume IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    from tidemark.functions.core import floor_ts

    e = table(spark, sf, "events")
    raw = e.select(
        F.col("event_type").alias("symbol"),
        floor_ts("ts", 60).alias("open_time"),
        F.col("value").cast("string").alias("c"),
        F.when(F.col("value") > 200, float("nan")).otherwise(F.col("value")).alias("vol"),
    )
    return B.normalize(raw, required=("close", "volume"))


@query(
    "expected_grid_gap_join",
    """WITH span AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1),
         grid AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM span)
       SELECT g.symbol, g.ts FROM grid g ANTI JOIN bars b ON g.symbol=b.symbol AND g.ts=b.ts""",
)
def _(spark, sf):
    return B.missing_bars(bars(spark, sf), 3600)


@query(
    "gap_repair",
    """WITH span AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars15 GROUP BY 1),
         grid AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL 15 MINUTE)) AS ts FROM span),
         d AS (SELECT g.symbol, g.ts, b.open, b.high, b.low, b.close, b.volume, b.close IS NULL AS repaired
               FROM grid g LEFT JOIN bars15 b ON g.symbol=b.symbol AND g.ts=b.ts),
         f AS (SELECT symbol, ts, last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high,
               last_value(low IGNORE NULLS) OVER w AS low, last_value(close IGNORE NULLS) OVER w AS close,
               coalesce(volume,0.0) AS volume, repaired FROM d
               WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING))
       SELECT symbol, ts, open, greatest(open,high,low,close) AS high, least(open,high,low,close) AS low, close, volume, repaired FROM f""",
)
def _(spark, sf):
    return B.repair_gaps(bars(spark, sf, 900), 900)


@query(
    "forward_fill",
    """WITH span AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1),
         grid AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM span),
         d AS (SELECT g.symbol, g.ts, b.close FROM grid g LEFT JOIN bars b ON g.symbol=b.symbol AND g.ts=b.ts),
         n AS (SELECT symbol, ts, close,
               last_value(close IGNORE NULLS) OVER w AS c0, last_value(CASE WHEN close IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS t0,
               first_value(close IGNORE NULLS) OVER v AS c1, first_value(CASE WHEN close IS NOT NULL THEN ts END IGNORE NULLS) OVER v AS t1
               FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING),
               v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
       SELECT symbol, ts, c0 AS filled, c1 AS back_filled,
         round(CASE WHEN close IS NOT NULL THEN close ELSE c0 + (c1-c0)*(epoch(ts)-epoch(t0))/(epoch(t1)-epoch(t0)) END,6) AS interpolated
       FROM n""",
)
def _(spark, sf):
    from tidemark.operators.fills import fill_series

    b = bars(spark, sf)
    grid = B.expected_grid(b, 3600).join(b.select("symbol", "ts", "close"), ["symbol", "ts"], "left")
    d = fill_series(grid, "close")
    return d.select("symbol", "ts", "filled", "back_filled", r6("interpolated").alias("interpolated"))


@query(
    "upsert_bars",
    """WITH old AS (SELECT symbol, ts, close, 1 AS load_ts FROM bars WHERE ts < TIMESTAMP '2024-01-20'),
         new AS (SELECT symbol, ts, round(close+1,6) AS close, 2 AS load_ts FROM bars WHERE ts >= TIMESTAMP '2024-01-15'),
         u AS (SELECT * FROM old UNION ALL SELECT * FROM new)
       SELECT symbol, ts, close, load_ts FROM u QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY load_ts DESC)=1""",
)
def _(spark, sf):
    b = bars(spark, sf).select("symbol", "ts", "close")
    old = b.where("ts < timestamp_ntz'2024-01-20'").withColumn("load_ts", F.lit(1))
    new = b.where("ts >= timestamp_ntz'2024-01-15'").select(
        "symbol", "ts", F.round(F.col("close") + 1, 6).alias("close"), F.lit(2).alias("load_ts")
    )
    return B.upsert(old, new)


@query(
    "coverage_catalog",
    """WITH f AS (SELECT symbol, '1h' AS timeframe, ts FROM bars UNION ALL SELECT symbol, '15m', ts FROM bars15 WHERE symbol <> 'view'),
         c AS (SELECT symbol, timeframe, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM f GROUP BY 1,2),
         want AS (SELECT s.symbol, t.timeframe FROM (SELECT DISTINCT symbol FROM bars) s, (VALUES ('15m'),('1h'),('4h')) t(timeframe))
       SELECT w.symbol, w.timeframe, coalesce(c.rows,0) AS rows, c.first_ts, c.last_ts, c.rows IS NULL AS missing
       FROM want w LEFT JOIN c ON w.symbol=c.symbol AND w.timeframe=c.timeframe""",
)
def _(spark, sf):
    h = bars(spark, sf).select("symbol", F.lit("1h").alias("timeframe"), "ts")
    q = bars(spark, sf, 900).where("symbol <> 'view'").select("symbol", F.lit("15m").alias("timeframe"), "ts")
    c = B.coverage(h.unionByName(q))
    frames = h.select("symbol").distinct().select(
        "symbol", F.explode(F.array(*[F.lit(t) for t in ("15m", "1h", "4h")])).alias("timeframe")
    )
    return frames.join(c, ["symbol", "timeframe"], "left").select(
        "symbol", "timeframe", F.coalesce("rows", F.lit(0)).alias("rows"), "first_ts", "last_ts",
        F.col("rows").isNull().alias("missing"),
    )


@query(
    "except_missing",
    """SELECT symbol, ts FROM (SELECT s.symbol, t.ts FROM (SELECT DISTINCT symbol FROM bars15) s, (SELECT DISTINCT ts FROM bars15) t)
       EXCEPT SELECT symbol, ts FROM bars15""",
)
def _(spark, sf):
    # stamps seen for any symbol but not for this one; found from the stamp's symbol set
    b = bars(spark, sf, 900)
    names = b.groupBy().agg(F.collect_set("symbol").alias("names"))  # one row: the list of symbols
    seen = b.groupBy("ts").agg(F.collect_set("symbol").alias("here"))
    return seen.join(F.broadcast(names)).select(F.explode(F.array_except("names", "here")).alias("symbol"), "ts")


@query(
    "intersect_timestamps",
    """SELECT ts FROM bars15 GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars15)""",
)
def _(spark, sf):
    from tidemark.operators.joins import common_timestamps

    return common_timestamps(bars(spark, sf, 900))


@query(
    "inner_equi_join_ts",
    """WITH c AS (SELECT ts FROM bars GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)),
         m AS (SELECT ts, avg(close) AS mkt FROM bars GROUP BY ts)
       SELECT b.symbol, b.ts, round(b.close/m.mkt,6) AS rel FROM bars b JOIN c ON b.ts=c.ts JOIN m ON b.ts=m.ts""",
)
def _(spark, sf):
    from tidemark.operators.joins import aligned_with_market

    return aligned_with_market(bars(spark, sf)).select("symbol", "ts", r6(F.col("close") / F.col("market")).alias("rel"))


@query(
    "left_join_market",
    """WITH m AS (SELECT ts, avg(ret) AS mkt_ret FROM rets GROUP BY ts), r AS (SELECT ts, ret AS ref_ret FROM rets WHERE symbol='purchase')
       SELECT a.symbol, a.ts, round(a.ret,8) AS ret, round(m.mkt_ret,8) AS mkt_ret, round(r.ref_ret,8) AS ref_ret
       FROM rets a LEFT JOIN m ON a.ts=m.ts LEFT JOIN r ON a.ts=r.ts""",
)
def _(spark, sf):
    from tidemark.operators.joins import with_market_returns
    from tidemark.operators.series import with_returns

    d = with_market_returns(with_returns(bars(spark, sf)), reference="purchase")
    return d.select("symbol", "ts", *[F.round(c, 8).alias(c) for c in ("ret", "mkt_ret", "ref_ret")])


@query(
    "bucket_floor_join",
    """SELECT q.symbol, q.ts, q.close, h.close AS h_close, h.volume AS h_volume FROM bars15 q
       LEFT JOIN bars h ON q.symbol=h.symbol AND h.ts = date_trunc('hour', q.ts) - INTERVAL 1 HOUR""",
)
def _(spark, sf):
    b = bars(spark, sf, 900).select("symbol", "ts", "close")
    h = bars(spark, sf).select("symbol", "ts", F.col("close").alias("h_close"), F.col("volume").alias("h_volume"))
    return J.bucket_floor_join(b, h, ["h_close", "h_volume"], 3600)


@query(
    "asof_join_backward",
    """SELECT b.symbol, b.ts, b.close, h.close AS h_close, h.ts AS h_ts FROM bars b
       ASOF LEFT JOIN bars4h h ON b.symbol=h.symbol AND b.ts >= h.ts""",
)
def _(spark, sf):
    b = bars(spark, sf)
    h = B.resample(b, 14_400).select("symbol", "ts", F.col("close").alias("h_close"))
    return J.asof_join(b.select("symbol", "ts", "close"), h, ["h_close"], keep_ts="h_ts")


@query(
    "nearest_join_tolerance",
    """WITH p AS (SELECT * FROM ticks WHERE event_id % 2 = 0), v AS (SELECT symbol, ts, event_id, qty FROM ticks WHERE event_id % 2 = 1),
         b AS (SELECT p.event_id, p.symbol, p.ts, p.price, v.qty AS bq, v.ts AS bt FROM p ASOF LEFT JOIN v ON p.symbol=v.symbol AND p.ts >= v.ts),
         f AS (SELECT p.event_id, v.qty AS fq, v.ts AS ft FROM p ASOF LEFT JOIN v ON p.symbol=v.symbol AND p.ts <= v.ts)
       SELECT b.event_id, b.symbol, b.price, CASE WHEN least(coalesce(epoch_us(b.ts)-epoch_us(bt),9e15), coalesce(epoch_us(ft)-epoch_us(b.ts),9e15)) < 300000000
         THEN CASE WHEN bt IS NOT NULL AND (ft IS NULL OR epoch_us(b.ts)-epoch_us(bt) <= epoch_us(ft)-epoch_us(b.ts)) THEN bq ELSE fq END END AS volume
       FROM b JOIN f ON b.event_id=f.event_id""",
)
def _(spark, sf):
    t = ticks(spark, sf)
    odd = F.pmod("event_id", F.lit(2)) == 1
    prices = t.where(~odd).select("event_id", "symbol", "ts", "price")
    volumes = t.where(odd).select("symbol", "ts", F.col("qty").alias("volume"))
    return J.nearest_join(prices, volumes, ["volume"], 300, chunk_seconds=None).drop("ts")


@query(
    "interval_join",
    """WITH s AS (SELECT event_id AS exec_id, symbol, ts AS start_ts, ts + to_minutes(qty) AS end_ts FROM ticks WHERE qty % 10 = 0)
       SELECT s.exec_id, s.symbol, count(*) AS n, round(avg(t.price),6) AS avg_price FROM s
       JOIN ticks t ON t.symbol=s.symbol AND t.ts BETWEEN s.start_ts AND s.end_ts GROUP BY 1,2""",
)
def _(spark, sf):
    t = ticks(spark, sf)
    spans = t.where(F.pmod("qty", F.lit(10)) == 0).select(
        F.col("event_id").alias("exec_id"), "symbol", F.col("ts").alias("start_ts"),
        (F.col("ts") + F.make_dt_interval(mins="qty")).alias("end_ts"),
    )
    d = J.interval_join(spans, t.select("symbol", "ts", "price"), "start_ts", "end_ts")
    return d.groupBy("exec_id", "symbol").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("price")).alias("avg_price"))
