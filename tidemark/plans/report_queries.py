"""Reporting queries: profit, fills, alerts, logs, metrics, rollups, top-k."""

from pyspark.sql import functions as F

from tidemark.functions.core import div, epoch_s, r6
from tidemark.operators import joins as K
from tidemark.operators import reports as R
from tidemark.operators.bars import latest_version
from tidemark.operators.frames import CHUNK, prefix
from tidemark.operators.order_stats import exact_quantiles
from tidemark.operators.series import with_returns
from tidemark.plans.registry import query
from tidemark.sources.standins import alerts, bars, chain, fills, logs, round_trips, table, ticks, trades


def rounded(df, digits=6, **special):
    """Round every double column so that the last bits of parallel sums do not show."""
    return df.select(
        *[
            F.round(c, special.get(c, digits)).alias(c) if t in ("double", "float") else F.col(c)
            for c, t in df.dtypes
        ]
    )


@query(
    "pnl_timeseries",
    """SELECT date_trunc('month', ts) AS bucket, symbol, round(sum(pnl),4) AS pnl, round(sum(commission),4) AS commission,
       count(*) AS trades FROM trades GROUP BY 1,2""",
)
def _(spark, sf):
    return rounded(R.pnl_timeseries(trades(spark, sf), "month"), 4)


@query(
    "pnl_summary",
    """SELECT round(sum(pnl),4) AS total_pnl, round(sum(commission),4) AS commission, count(*) AS trades,
       round(count_if(pnl>0)*100.0/count(*),4) AS win_rate, round(max(pnl),4) AS best, round(min(pnl),4) AS worst,
       round(sum(CASE WHEN pnl>0 THEN pnl END)/abs(sum(CASE WHEN pnl<0 THEN pnl END)),4) AS profit_factor,
       round(max(pnl)/abs(min(pnl)),4) AS profit_factor_extremes,
       round(coalesce(sum(pnl) FILTER (ts > TIMESTAMP '2000-06-29' AND ts <= TIMESTAMP '2000-06-30'),0),4) AS pnl_1d,
       round(coalesce(sum(pnl) FILTER (ts > TIMESTAMP '2000-06-23' AND ts <= TIMESTAMP '2000-06-30'),0),4) AS pnl_7d,
       round(coalesce(sum(pnl) FILTER (ts > TIMESTAMP '2000-05-31' AND ts <= TIMESTAMP '2000-06-30'),0),4) AS pnl_30d
       FROM trades""",
)
def _(spark, sf):
    return rounded(R.pnl_summary(trades(spark, sf), "2000-06-30"), 4)


_BY = """count(*) AS trades, count_if(pnl>0) AS wins, round(count_if(pnl>0)*100.0/count(*),4) AS win_rate,
       round(sum(pnl),4) AS pnl, round(avg(pnl),4) AS avg_pnl FROM trades"""


@query("pnl_by_symbol", f"SELECT symbol, {_BY} GROUP BY 1")
def _(spark, sf):
    return rounded(R.pnl_by(trades(spark, sf), ["symbol"]), 4)


@query("pnl_by_exit_reason", f"SELECT symbol, exit_reason, {_BY} GROUP BY 1,2")
def _(spark, sf):
    return rounded(R.pnl_by(trades(spark, sf), ["symbol", "exit_reason"]), 4)


@query(
    "cached_pnl_aggregates",
    """SELECT hour(ts) AS hour, symbol, round(sum(pnl),6) AS pnl, count(*) AS trades FROM round_trips GROUP BY 1,2""",
)
def _(spark, sf):
    d = round_trips(spark, sf).groupBy(F.hour("ts").alias("hour"), "symbol")
    return rounded(d.agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("trades")))


@query(
    "volume_analysis",
    """SELECT date_trunc('month', ts) AS bucket, symbol, sum(quantity) AS quantity, round(sum(notional),2) AS notional,
       count(*) AS fills, round(avg(price),6) AS avg_price, round(min(price),8) AS min_price, round(max(price),8) AS max_price,
       round(sum(commission),4) AS commission FROM fills GROUP BY 1,2""",
)
def _(spark, sf):
    return rounded(R.volume_analysis(fills(spark, sf)), 4, notional=2, avg_price=6, min_price=8, max_price=8)


@query(
    "fill_summary",
    """WITH l AS (SELECT symbol, price, qty, price*qty*0.001 AS commission, lag(price) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS pp FROM ticks)
       SELECT symbol, count(*) AS fills, sum(qty)::BIGINT AS volume, round(sum(commission),4) AS commission, round(avg(qty),6) AS avg_size,
       round(avg(abs(price-pp)),6) AS avg_move FROM l GROUP BY 1""",
)
def _(spark, sf):
    d = prefix(
        ticks(spark, sf), {"_pp": ("last", F.col("price"))}, ["symbol"], ["ts", "event_id"], upto=-1
    )
    return rounded(
        d.groupBy("symbol").agg(
            F.count(F.lit(1)).alias("fills"),
            F.sum("qty").alias("volume"),
            F.round(F.sum(F.col("price") * F.col("qty") * 0.001), 4).alias("commission"),
            F.avg("qty").alias("avg_size"),
            F.avg(F.abs(F.col("price") - F.col("_pp"))).alias("avg_move"),
        )
    )


@query(
    "trade_stats",
    """SELECT strategy, count(*) AS trades, count_if(pnl>0) AS wins, count_if(pnl<0) AS losses, round(avg(pnl),4) AS avg_pnl,
       round(avg(CASE WHEN pnl>0 THEN pnl END),4) AS avg_win, round(avg(CASE WHEN pnl<0 THEN pnl END),4) AS avg_loss,
       round(max(pnl),4) AS best, round(min(pnl),4) AS worst, round(stddev_samp(pnl),4) AS std_pnl,
       round(sum(commission),4) AS commission, round(avg(holding_days),4) AS avg_holding FROM trades GROUP BY 1""",
)
def _(spark, sf):
    return rounded(R.trade_stats(trades(spark, sf), ["strategy"]), 4)


@query(
    "returns_by_period",
    """SELECT date_trunc('week', ts) AS period, round(sum(pnl),4) AS pnl, count(*) AS trades, round(avg(ret_pct),4) AS avg_return,
       round(stddev_samp(ret_pct),4) AS std_return FROM trades GROUP BY 1""",
)
def _(spark, sf):
    return rounded(R.returns_by_period(trades(spark, sf), "week"), 4)


@query(
    "alert_stats",
    """SELECT date_trunc('day', ts) AS bucket, count(*) AS alerts, count_if(NOT resolved) AS active, count_if(severity='INFO') AS info,
       count_if(severity='WARNING') AS warning, count_if(severity='ERROR') AS error, count_if(severity='CRITICAL') AS critical
       FROM alerts GROUP BY 1""",
)
def _(spark, sf):
    return R.alert_stats(alerts(spark, sf))


@query(
    "alert_sources",
    """SELECT source, severity, count(*) AS alerts, count_if(resolved) AS resolved,
       round(count(*)/greatest((max(floor(epoch(ts)))-min(floor(epoch(ts))))/3600.0,1.0),6) AS per_hour
       FROM alerts GROUP BY GROUPING SETS ((source,severity),(source))""",
)
def _(spark, sf):
    return rounded(R.alert_sources(alerts(spark, sf)))


_SNAP = """SELECT symbol, date_trunc('day', ts) AS ts, price, qty, CASE WHEN event_id % 2 = 0 THEN qty ELSE -qty END AS signed
           FROM ticks"""


def snapshots(spark, sf):
    from tidemark.functions.core import floor_ts

    sign = F.when(F.pmod("event_id", F.lit(2)) == 0, F.col("qty")).otherwise(-F.col("qty"))
    return ticks(spark, sf).select(
        "symbol", floor_ts("ts", 86400).alias("ts"), (sign * F.col("price")).alias("market_value"),
        (sign * (F.col("price") - 100)).alias("unrealized"),
    )


@query(
    "position_snapshots",
    f"""WITH s AS ({_SNAP}) SELECT ts, symbol, round(sum(signed*price),4) AS market_value, round(sum(signed*(price-100)),4) AS unrealized,
        count(*) AS positions FROM s GROUP BY 1,2 ORDER BY ts DESC, symbol LIMIT 100""",
)
def _(spark, sf):
    return rounded(R.position_snapshots(snapshots(spark, sf)), 4)


@query(
    "pnl_curve_rollup_mv",
    """WITH d AS (SELECT date_trunc('day', ts) AS bucket, strategy, sum(pnl) AS pnl FROM trades GROUP BY 1,2)
       SELECT bucket, strategy, round(pnl,4) AS pnl, round(sum(pnl) OVER (PARTITION BY strategy ORDER BY bucket),4) AS cum_pnl FROM d""",
)
def _(spark, sf):
    return rounded(R.pnl_curve_rollup(trades(spark, sf)), 4)


@query(
    "risk_summary_rollup",
    """SELECT date_trunc('day', ts) AS bucket, symbol, count(*) AS n, round(avg(pnl),6) AS mean, round(min(pnl),6) AS low,
       round(max(pnl),6) AS high FROM round_trips GROUP BY 1,2""",
)
def _(spark, sf):
    hourly = R.mergeable_rollup(round_trips(spark, sf), "pnl", "hour", ["symbol"])
    return rounded(R.merge_rollup(hourly, "day", ["symbol"]))


@query(
    "daily_pnl_rollup",
    """SELECT date_trunc('day', ts) AS bucket, symbol, account, round(sum(pnl),4) AS pnl, round(sum(commission),4) AS commission,
       count(*) AS trades FROM trades GROUP BY 1,2,3""",
)
def _(spark, sf):
    return rounded(R.pnl_timeseries(trades(spark, sf), "day", ["symbol", "account"]), 4)


@query(
    "argmax_snapshot_rollup",
    """SELECT date_trunc('hour', ts) AS bucket, symbol, round(arg_max(price,(ts,event_id)),6) AS price, arg_max(qty,(ts,event_id)) AS qty
       FROM ticks GROUP BY 1,2""",
)
def _(spark, sf):
    return rounded(R.last_in_bucket(ticks(spark, sf), ["price", "qty"], "hour", ["symbol"], ["ts", "event_id"]))


@query(
    "replacing_dedup",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_quantity, l_extendedprice FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC)=1""",
)
def _(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_quantity", "l_extendedprice"]
    return latest_version(table(spark, sf, "lineitem").select(*cols), cols[:2], cols[2:])


@query(
    "multi_level_rollup",
    """WITH g AS (SELECT symbol, pnl, unnest([{'grain':'1h','bucket':date_trunc('hour',ts)},{'grain':'1d','bucket':date_trunc('day',ts)},
         {'grain':'15m','bucket':time_bucket(INTERVAL 15 MINUTE, ts)}]) AS b FROM round_trips)
       SELECT symbol, b.grain AS grain, b.bucket AS bucket, count(*) AS n, round(sum(pnl),6) AS total, round(min(pnl),6) AS low, round(max(pnl),6) AS high
       FROM g GROUP BY 1,2,3""",
)
def _(spark, sf):
    return rounded(R.multi_grain_rollup(round_trips(spark, sf), "pnl", {"15m": 900, "1h": 3600, "1d": 86400}))


@query(
    "level_distribution",
    """SELECT concat_ws(',', CASE WHEN grouping(level)=0 THEN 'level' END, CASE WHEN grouping(category)=0 THEN 'category' END,
         CASE WHEN grouping(component)=0 THEN 'component' END) AS "grouping", level, category, component, count(*) AS n,
         round(count_if(level='ERROR')*1.0/count(*),6) AS error_rate FROM logs GROUP BY GROUPING SETS ((level),(category),(component),())""",
)
def _(spark, sf):
    d = R.grouping_counts(
        logs(spark, sf),
        [["level"], ["category"], ["component"], []],
        [F.count(F.lit(1)).alias("n"), (F.count_if(F.col("level") == "ERROR") * 1.0 / F.count(F.lit(1))).alias("error_rate")],
    )
    return rounded(d)


@query(
    "metric_summary",
    """WITH m AS (SELECT event_type AS name, ts, event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20')
       SELECT name, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value),6) AS mean, arg_max(value,(ts,event_id)) AS latest,
       round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.9),6) AS p90, round(quantile_cont(value,0.95),6) AS p95,
       round(quantile_cont(value,0.99),6) AS p99, list_sort(list(value))[CAST(least(floor(count(*)*0.95::DOUBLE), count(*)-1) AS BIGINT)+1] AS p95_nearest
       FROM m GROUP BY 1""",
)
def _(spark, sf):
    m = table(spark, sf, "events").select(F.col("event_type").alias("name"), "ts", "event_id", "value")
    return rounded(R.metric_summary(m, "2024-01-10", "2024-01-20", ["ts", "event_id"]))


@query(
    "counter_rate",
    """WITH c AS (SELECT symbol AS name, ts, event_id, sum(qty) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS value FROM ticks)
       SELECT name, CAST(max(value)-min(value) AS BIGINT) AS delta, max(floor(epoch(ts)))::BIGINT-min(floor(epoch(ts)))::BIGINT AS seconds,
       round((max(value)-min(value))/(max(floor(epoch(ts)))-min(floor(epoch(ts)))),8) AS rate FROM c GROUP BY 1""",
)
def _(spark, sf):
    t = ticks(spark, sf).withColumnRenamed("symbol", "name")
    c = prefix(t, {"value": ("sum", F.col("qty"))}, ["name"], ["ts", "event_id"])
    return rounded(R.counter_rate(c, order=["ts", "event_id"]), 8)


@query(
    "hourly_profile",
    """WITH h AS (SELECT b.symbol, hour(b.ts) AS hour, avg(b.volume) AS volume, avg(b.high/b.low-1) AS "range", avg(abs(r.ret)) AS move
         FROM bars b JOIN rets r ON b.symbol=r.symbol AND b.ts=r.ts GROUP BY 1,2),
       s AS (SELECT *, (volume/max(volume) OVER (PARTITION BY symbol) + "range"/max("range") OVER (PARTITION BY symbol))/2 AS score FROM h)
       SELECT symbol, hour, round(volume,6) AS volume, round("range",8) AS "range", round(move,8) AS move, round(score,6) AS score,
       row_number() OVER (PARTITION BY symbol ORDER BY score DESC, hour) <= 6 AS best FROM s""",
)
def _(spark, sf):
    return rounded(R.hourly_profile(with_returns(bars(spark, sf))), range=8, move=8)


_SESSION = "CASE WHEN hour(ts) < 8 THEN 'asia' WHEN hour(ts) < 16 THEN 'europe' ELSE 'us' END"


@query(
    "time_pattern_scores",
    f"""WITH t AS (SELECT *, {_SESSION} AS session, (dayofweek(ts)+6) % 7 AS dow, hour(ts) AS hour FROM round_trips),
        g AS (SELECT concat_ws(',', CASE WHEN grouping(session)=0 THEN 'session' END, CASE WHEN grouping(dow)=0 THEN 'dow' END,
          CASE WHEN grouping(hour)=0 THEN 'hour' END) AS "grouping", session, dow, hour, count(*) AS trades,
          count_if(pnl_pct>0)*100.0/count(*) AS win_rate, avg(pnl_pct) AS avg_profit, avg(holding_minutes) AS avg_holding, stddev_pop(pnl_pct) AS s
          FROM t GROUP BY GROUPING SETS ((session),(dow),(hour)) HAVING count(*) >= 3),
        x AS (SELECT *, win_rate*0.4 + greatest(0,avg_profit*10)*0.3 + greatest(0,(90-avg_holding)/90*100)*0.2
          + greatest(0,(2-CASE WHEN s>0 THEN s ELSE 1.0 END)/2*100)*0.1 AS score FROM g)
        SELECT "grouping", session, dow, hour, trades, round(win_rate,6) AS win_rate, round(avg_profit,6) AS avg_profit, round(avg_holding,6) AS avg_holding,
        round(score,6) AS score, least(1.0,trades/20.0) AS confidence,
        row_number() OVER (PARTITION BY "grouping" ORDER BY score DESC, session, dow, hour) AS rank FROM x""",
)
def _(spark, sf):
    hour = F.hour("ts")
    t = round_trips(spark, sf).withColumns(
        {
            "session": F.when(hour < 8, "asia").when(hour < 16, "europe").otherwise("us"),
            "dow": F.weekday("ts"),
            "hour": hour,
        }
    )
    return rounded(R.time_pattern_scores(t, [["session"], ["dow"], ["hour"]]))


@query(
    "vol_stats",
    """SELECT symbol, round(stddev_samp(ret)*sqrt(24),8) AS daily_vol, round(stddev_samp(ret)*sqrt(168),8) AS weekly_vol,
       round(stddev_samp(ret)*sqrt(720),8) AS monthly_vol, round(avg(ret),8) AS mean_return, round(skewness(ret),6) AS skewness,
       round(kurtosis(ret),6) AS kurtosis FROM rets GROUP BY 1""",
)
def _(spark, sf):
    return rounded(R.vol_stats(with_returns(bars(spark, sf)), 24), 8, skewness=6, kurtosis=6)


@query(
    "liquidity_tiers",
    """WITH a AS (SELECT symbol, avg(volume) AS avg_volume, 1-stddev_samp(volume)/avg(volume) AS consistency FROM bars GROUP BY 1),
       s AS (SELECT *, least(1.0, avg_volume/100*consistency) AS score FROM a)
       SELECT symbol, round(avg_volume,6) AS avg_volume, round(consistency,6) AS consistency, round(score,6) AS score,
       CASE WHEN score>0.8 THEN 'high' WHEN score>0.5 THEN 'medium' ELSE 'low' END AS tier FROM s""",
)
def _(spark, sf):
    return rounded(R.liquidity_tiers(bars(spark, sf), 100.0))


@query(
    "symbol_pivot",
    """SELECT ts, round(max(close) FILTER (symbol='click'),6) AS click, round(max(close) FILTER (symbol='error'),6) AS error,
       round(max(close) FILTER (symbol='purchase'),6) AS purchase, round(max(close) FILTER (symbol='signup'),6) AS signup,
       round(max(close) FILTER (symbol='view'),6) AS "view" FROM bars GROUP BY ts""",
)
def _(spark, sf):
    return rounded(R.symbol_pivot(bars(spark, sf), ["click", "error", "purchase", "signup", "view"]))


_MONTHS = ", ".join(f"round(max(r) FILTER (m={k}),8) AS m{k}" for k in range(1, 13))


@query(
    "monthly_return_pivot",
    f"""WITH d AS (SELECT ts, sum(pnl)/sum(notional) AS ret FROM trades GROUP BY ts),
        m AS (SELECT year(ts)::INT AS year, month(ts) AS m, exp(sum(ln(1+ret)) FILTER (ret > -1))-1 AS r FROM d GROUP BY 1,2)
        SELECT year, {_MONTHS} FROM m GROUP BY year""",
)
def _(spark, sf):
    d = trades(spark, sf).groupBy("ts").agg((F.sum("pnl") / F.sum("notional")).alias("ret"))
    return rounded(R.monthly_return_pivot(d), 8)


@query(
    "corr_matrix",
    """SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(corr(a.ret,b.ret),6) AS corr FROM rets a JOIN rets b
       ON a.ts=b.ts AND a.symbol<b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1,2""",
)
def _(spark, sf):
    return rounded(K.corr_matrix(with_returns(bars(spark, sf)), "ret"))


@query(
    "pairwise_cross_join",
    """SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(covar_samp(a.close,b.close),6) AS cov, round(sum(abs(a.close*b.close)),4) AS sxy
       FROM bars15 a JOIN bars15 b ON a.ts=b.ts AND a.symbol<b.symbol GROUP BY 1,2""",
)
def _(spark, sf):
    d = K.pair_moments(bars(spark, sf, 900), "close")
    return rounded(d.select("a", "b", "n", "cov", F.round("sxy", 4).alias("sxy")))


@query(
    "ewma_cov_matrix",
    """WITH u AS (SELECT ts, row_number() OVER (ORDER BY ts DESC)-1 AS k FROM (SELECT DISTINCT ts FROM rets WHERE ret IS NOT NULL)),
       r AS (SELECT s.symbol, s.ts, s.ret, pow(0.94,u.k) AS w FROM rets s JOIN u ON s.ts=u.ts WHERE s.ret IS NOT NULL),
       m AS (SELECT a.symbol AS a, b.symbol AS b, sum(a.w) AS sw, sum(a.w*a.w) AS sw2, sum(a.w*a.ret) AS sx, sum(a.w*b.ret) AS sy, sum(a.w*a.ret*b.ret) AS sxy
         FROM r a JOIN r b ON a.ts=b.ts AND a.symbol<=b.symbol GROUP BY 1,2)
       SELECT a, b, round((sxy-sx*sy/sw)/(sw-sw2/sw),10) AS cov FROM m""",
)
def _(spark, sf):
    from tidemark.operators.portfolio import ewma_covariance

    return rounded(ewma_covariance(with_returns(bars(spark, sf)), "ret", 0.94).select("a", "b", "cov"), 10)


@query(
    "distinct_venues",
    """SELECT order_id, count(DISTINCT venue) AS venues, round(avg(CAST(is_maker AS INT)),6) AS maker_ratio, round(sum(round(notional*100))/sum(quantity)/100,8) AS vwap
       FROM fills GROUP BY 1""",
)
def _(spark, sf):
    return rounded(R.execution_venues(fills(spark, sf)), vwap=8)


@query(
    "mode_and_hist",
    """WITH h AS (SELECT symbol, hour(ts) AS hour, count_if(pnl<0) AS losses, round(sum(pnl) FILTER (pnl<0),6) AS loss,
         round(avg(holding_minutes) FILTER (pnl<0)-avg(holding_minutes) FILTER (pnl>=0),6) AS holding_gap FROM round_trips GROUP BY 1,2)
       SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY losses DESC, hour) AS rank FROM h
       QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY losses DESC, hour) <= 3""",
)
def _(spark, sf):
    return rounded(R.loss_patterns(round_trips(spark, sf)))


@query(
    "yearly_evolution",
    """WITH y AS (SELECT symbol, year(ts)::INT AS year, count(*) AS trades, count_if(pnl>0)*1.0::DOUBLE/count(*) AS win_rate FROM trades GROUP BY 1,2)
       SELECT symbol, year, trades, round(win_rate,6) AS win_rate, round(regr_slope(win_rate,year) OVER (PARTITION BY symbol),8) AS slope FROM y""",
)
def _(spark, sf):
    return rounded(R.yearly_evolution(trades(spark, sf)), slope=8)


@query(
    "quality_metric_rollup",
    """SELECT hour(ts) AS hour, level AS stage, round(avg(value),6) AS mean, min(value) AS low, max(value) AS high, count(*) AS n FROM logs GROUP BY 1,2""",
)
def _(spark, sf):
    d = logs(spark, sf).groupBy(F.hour("ts").alias("hour"), F.col("level").alias("stage"))
    return rounded(
        d.agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))
    )


@query(
    "health_union_counts",
    """SELECT 'fills' AS "table", count(*) AS rows, max(l_shipdate) AS last_ts FROM lineitem UNION ALL
       SELECT 'orders', count(*), max(o_orderdate) FROM orders UNION ALL SELECT 'events', count(*), max(ts) FROM events""",
)
def _(spark, sf):
    return R.union_counts(
        {
            "fills": (table(spark, sf, "lineitem"), "l_shipdate"),
            "orders": (table(spark, sf, "orders"), "o_orderdate"),
            "events": (table(spark, sf, "events"), "ts"),
        }
    )


@query(
    "union_all_tables",
    """SELECT l_shipdate AS ts, 'fill' AS kind, l_orderkey AS id, l_quantity AS qty, NULL::VARCHAR AS status FROM lineitem
       UNION ALL SELECT o_orderdate, 'order', o_orderkey, NULL, o_orderstatus FROM orders""",
)
def _(spark, sf):
    a = table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("ts"), F.lit("fill").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("qty")
    )
    b = table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("ts"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")
    )
    return a.unionByName(b, allowMissingColumns=True)


def position_book(spark, sf):
    """One row per symbol: signed size and value at the last price."""
    sign = F.when(F.pmod("event_id", F.lit(3)) == 0, -F.col("qty")).otherwise(F.col("qty"))
    sized = F.when(F.col("symbol").isin("view", "error"), -sign).otherwise(sign)
    d = ticks(spark, sf).groupBy("symbol").agg(F.sum(sized).alias("qty"), F.max_by("price", F.struct("ts", "event_id")).alias("mark"))
    return d.withColumn("market_value", F.col("qty") * F.col("mark"))


BOOK = """SELECT symbol, sum(CASE WHEN (symbol IN ('view','error')) <> (event_id % 3 = 0) THEN -qty ELSE qty END) AS qty,
          arg_max(price,(ts,event_id)) AS mark,
          sum(CASE WHEN (symbol IN ('view','error')) <> (event_id % 3 = 0) THEN -qty ELSE qty END)*arg_max(price,(ts,event_id)) AS market_value
          FROM ticks GROUP BY 1"""


@query(
    "portfolio_exposure",
    f"""WITH p AS ({BOOK}), t AS (SELECT sum(abs(market_value)) AS gross, coalesce(sum(market_value) FILTER (market_value>0),0) AS "long",
         coalesce(-sum(market_value) FILTER (market_value<0),0) AS short, max(abs(market_value)) AS top FROM p)
        SELECT p.symbol, round(market_value,4) AS market_value, round(gross,4) AS gross, round("long",4) AS "long", round(short,4) AS short,
        round("long"-short,4) AS net, round(abs(market_value)*100/gross,4) AS share_pct, round(top*100/gross,4) AS largest_pct FROM p, t""",
)
def _(spark, sf):
    return rounded(R.portfolio_exposure(position_book(spark, sf)), 4)


@query(
    "log_metric_extraction",
    """WITH m AS (SELECT lower(concat_ws('.', level, component, unnest(['value','category']))) AS name, unnest([value, category::DOUBLE]) AS v FROM logs)
       SELECT name, count(*) AS n, round(avg(v),6) AS mean, max(v) AS high FROM m GROUP BY 1""",
)
def _(spark, sf):
    d = R.log_metrics(logs(spark, sf), ["value", "category"]).groupBy("name")
    return rounded(d.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("high")))


@query(
    "pnl_attribution",
    """WITH t AS (SELECT *, hour(ts) AS hour FROM round_trips)
       SELECT concat_ws(',', CASE WHEN grouping(symbol)=0 THEN 'symbol' END, CASE WHEN grouping(strategy)=0 THEN 'strategy' END,
       CASE WHEN grouping(hour)=0 THEN 'hour' END) AS "grouping", symbol, strategy, hour, count(*) AS trades, count_if(pnl>0) AS wins,
       round(sum(pnl),6) AS pnl FROM t GROUP BY GROUPING SETS ((symbol),(strategy),(hour))""",
)
def _(spark, sf):
    t = round_trips(spark, sf).withColumn("hour", F.hour("ts"))
    aggs = [F.count(F.lit(1)).alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"), F.sum("pnl").alias("pnl")]
    return rounded(R.grouping_counts(t, [["symbol"], ["strategy"], ["hour"]], aggs))


@query(
    "signal_quality_summary",
    """SELECT symbol, count(*) AS signals, round(avg(confidence),6) AS mean_confidence, round(quantile_cont(confidence,0.25),6) AS q25,
       round(quantile_cont(confidence,0.5),6) AS q50, round(quantile_cont(confidence,0.75),6) AS q75, count_if(confidence>=0.6) AS strong,
       round(count_if(pnl>0)*1.0/count(*),6) AS hit_rate FROM round_trips GROUP BY 1""",
)
def _(spark, sf):
    t = round_trips(spark, sf)
    n = F.count(F.lit(1))
    base = t.groupBy("symbol").agg(
        n.alias("signals"), F.avg("confidence").alias("mean_confidence"),
        F.count_if(F.col("confidence") >= 0.6).alias("strong"), (F.count_if(F.col("pnl") > 0) * 1.0 / n).alias("hit_rate"),
    )
    q = exact_quantiles(t, F.col("confidence"), {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["symbol"])
    return rounded(base.join(q, "symbol"))


@query(
    "dynamic_filter_query",
    """SELECT alert_id, ts, severity, source, value FROM alerts WHERE severity='ERROR' AND source='svc2' AND NOT resolved AND ts >= TIMESTAMP '2024-01-05'
       ORDER BY ts DESC, alert_id DESC LIMIT 20 OFFSET 20""",
)
def _(spark, sf):
    d = R.dynamic_filter(
        alerts(spark, sf), {"severity": "error", "source": "svc2", "resolved": False, "value": None}, start="2024-01-05",
        order=("ts", "alert_id"), page=2, page_size=20, upper=("severity",),
    )
    return d.select("alert_id", "ts", "severity", "source", "value")


@query(
    "log_search",
    """SELECT log_id, ts, level, component, message FROM logs WHERE level='ERROR' AND component='c2' AND contains(lower(message),'7')
       AND ts > TIMESTAMP '2024-01-20' - INTERVAL 4320 MINUTE AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, log_id DESC LIMIT 100""",
)
def _(spark, sf):
    d = R.log_search(logs(spark, sf), "2024-01-20", 4320, "error", "c2", "7")
    return d.select("log_id", "ts", "level", "component", "message")


@query("order_limit_offset", "SELECT order_id, symbol, ts, round(notional,2) AS notional FROM fills ORDER BY ts DESC, order_id DESC, notional DESC LIMIT 20 OFFSET 20")
def _(spark, sf):
    d = fills(spark, sf).select("order_id", "symbol", "ts", "notional")
    return rounded(R.dynamic_filter(d, {}, order=("ts", "order_id", "notional"), page=2, page_size=20), 2)


@query(
    "topk_per_group",
    """SELECT symbol, trade_id, ts, confidence FROM round_trips WHERE confidence >= 0.6
       QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, trade_id DESC) <= 3""",
)
def _(spark, sf):
    d = round_trips(spark, sf).where("confidence >= 0.6").select("symbol", "trade_id", "ts", "confidence")
    return R.top_per_group(d, ["symbol"], [F.col("ts").desc(), F.col("trade_id").desc()], 3)


@query("global_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query(
    "best_worst_trades",
    """(SELECT trade_id, symbol, round(pnl,6) AS pnl, 'best' AS side FROM round_trips ORDER BY round_trips.pnl DESC, trade_id LIMIT 10)
       UNION ALL (SELECT trade_id, symbol, round(pnl,6), 'worst' FROM round_trips ORDER BY round_trips.pnl, trade_id LIMIT 10)""",
)
def _(spark, sf):
    return rounded(R.extremes(round_trips(spark, sf).select("trade_id", "symbol", "pnl"), "pnl", 10, ["trade_id"]))


@query(
    "bounded_history",
    """SELECT symbol, ts, round(close,6) AS close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 252""",
)
def _(spark, sf):
    d = bars(spark, sf).select("symbol", "ts", "close")
    return rounded(R.top_per_group(d, ["symbol"], [F.col("ts").desc()], 252))


@query(
    "distinct_dedupe",
    """WITH d AS (SELECT DISTINCT l_orderkey, l_suppkey, l_shipdate FROM lineitem)
       SELECT l_orderkey, l_suppkey, l_shipdate FROM d""",
)
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    return d.unionByName(d).dropDuplicates()


@query(
    "latest_snapshot_semijoin",
    """SELECT symbol, ts, round(close,6) AS close FROM bars b WHERE ts = (SELECT max(ts) FROM bars c WHERE c.symbol=b.symbol)""",
)
def _(spark, sf):
    return rounded(K.latest_snapshot(bars(spark, sf).select("symbol", "ts", "close"), ["symbol"]))


@query(
    "orphan_antijoin",
    """SELECT key, 'signal_without_position' AS problem FROM signals WHERE key NOT IN (SELECT key FROM positions)
       UNION ALL SELECT key, 'position_without_execution' FROM positions WHERE key NOT IN (SELECT key FROM executions)
       UNION ALL SELECT key, 'execution_without_parent' FROM executions WHERE key NOT IN (SELECT key FROM signals UNION SELECT key FROM positions)""",
)
def _(spark, sf):
    return K.orphans(*chain(spark, sf))


@query(
    "matched_pairs",
    """SELECT 'signal_position' AS pair, count(*) AS left_rows, count(p.key) AS matched, round(count(p.key)/count(*),6) AS match_rate
       FROM signals s LEFT JOIN positions p ON s.key=p.key
       UNION ALL SELECT 'position_execution', count(*), count(e.key), round(count(e.key)/count(*),6) FROM positions p LEFT JOIN executions e ON p.key=e.key""",
)
def _(spark, sf):
    s, p, e = chain(spark, sf)
    return rounded(K.match_rates([("signal_position", s, p), ("position_execution", p, e)]))


@query(
    "retention_purge",
    """SELECT alert_id, ts, resolved FROM alerts WHERE ts >= TIMESTAMP '2024-01-20' OR NOT resolved""",
)
def _(spark, sf):
    from tidemark.sources.scan import retention_keep

    return retention_keep(alerts(spark, sf), "2024-01-20", "resolved").select("alert_id", "ts", "resolved")


@query(
    "snapshot_diff",
    """WITH a AS (SELECT symbol, ts, close, CASE WHEN hour(ts)=5 THEN volume END AS x, CAST(NULL AS DOUBLE) AS y FROM bars WHERE ts < TIMESTAMP '2024-01-25'),
       b AS (SELECT symbol, ts, close + CASE WHEN hour(ts)=3 THEN 1 ELSE 0 END AS close, CAST(NULL AS DOUBLE) AS x, CASE WHEN hour(ts)=5 THEN volume END AS y
         FROM bars WHERE ts >= TIMESTAMP '2024-01-03')
       SELECT symbol, CASE WHEN a.ts IS NULL THEN 'added' WHEN b.ts IS NULL THEN 'removed'
         WHEN a.close=b.close AND a.x IS NOT DISTINCT FROM b.x AND a.y IS NOT DISTINCT FROM b.y THEN 'same' ELSE 'changed' END AS status,
       count(*) AS rows FROM a FULL JOIN b USING (symbol, ts) GROUP BY 1,2""",
)
def _(spark, sf):
    from tidemark.sources.scan import as_ts, snapshot_diff

    some, none = F.when(F.hour("ts") == 5, F.col("volume")), F.lit(None).cast("double")
    b = bars(spark, sf).select("symbol", "ts", "close", "volume")
    old = b.where(F.col("ts") < as_ts("2024-01-25")).withColumns({"x": some, "y": none}).drop("volume")
    new = b.where(F.col("ts") >= as_ts("2024-01-03")).withColumns(
        {"close": F.col("close") + F.when(F.hour("ts") == 3, 1).otherwise(0), "x": none, "y": some}
    )
    d = snapshot_diff(old, new.drop("volume"), ["symbol", "ts"])
    return d.groupBy("symbol", "status").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "content_hash_version",
    """WITH r AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_linestatus, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS a,
         CASE WHEN l_linenumber % 2 = 1 THEN l_partkey END AS b FROM lineitem),
       t AS (SELECT l_returnflag, md5(concat(coalesce(length(a::VARCHAR)||':'||a, 'n'), coalesce(length(b::VARCHAR)||':'||b, 'n'),
         length(l_linenumber::VARCHAR)||':'||l_linenumber, length(l_linestatus)||':'||l_linestatus, length(l_orderkey::VARCHAR)||':'||l_orderkey,
         length(l_returnflag)||':'||l_returnflag)) AS h FROM r)
       SELECT l_returnflag, count(*) AS rows, CAST(sum(CAST('0x'||substr(h,1,15) AS BIGINT)) AS DECIMAL(38,0)) AS content_hash FROM t GROUP BY 1""",
)
def _(spark, sf):
    from tidemark.sources.scan import content_hash

    d = table(spark, sf, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_linenumber", "l_linestatus",
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("a"),
        F.when(F.col("l_linenumber") % 2 == 1, F.col("l_partkey")).alias("b"),
    )
    return content_hash(d, ["l_returnflag"])


@query(
    "scan_json_records",
    """SELECT event_id, event_type, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props,'$.k') AS INT) >= 90""",
)
def _(spark, sf):
    from tidemark.streaming.run import fresh_path

    path = fresh_path(spark)
    table(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "k INT").alias("props")).write.json(path)
    d = spark.read.schema("event_id BIGINT, event_type STRING, props STRUCT<k: INT>").json(path)
    return d.where("props.k >= 90").select("event_id", "event_type", F.col("props.k").alias("k"))


@query(
    "reconcile_score",
    """WITH j AS (SELECT p.key, p.symbol, s.symbol IS NULL AS no_signal, e.symbol IS NULL AS no_exec, s.side<>p.side AS side_diff, s.symbol<>p.symbol AS symbol_diff,
         abs(p.price-s.price)/s.price*1e4 AS bps, abs(epoch_us(p.ts)-epoch_us(s.ts))/1e6 AS secs, abs(e.qty-p.qty)/nullif(p.qty,0)::DOUBLE AS qd
         FROM positions p LEFT JOIN signals s ON p.key=s.key LEFT JOIN executions e ON p.key=e.key),
       x AS (SELECT key, symbol, greatest(0, 100 - CASE WHEN no_signal THEN 50 ELSE 0 END - CASE WHEN no_exec THEN 30 ELSE 0 END - CASE WHEN symbol_diff THEN 20 ELSE 0 END
         - CASE WHEN side_diff THEN 30 ELSE 0 END - CASE WHEN bps>50 THEN least(20,(bps-50)/10) ELSE 0 END
         - CASE WHEN secs>60 THEN least(15,(secs-60)/60) ELSE 0 END - CASE WHEN qd>0.1 THEN 10 ELSE 0 END) AS score FROM j)
       SELECT key, symbol, round(score,8) AS score, CASE WHEN score>=95 THEN 'excellent' WHEN score>=85 THEN 'good' WHEN score>=70 THEN 'fair' ELSE 'poor' END AS level FROM x""",
)
def _(spark, sf):
    from tidemark.operators.reconcile import reconcile_score

    return rounded(reconcile_score(*chain(spark, sf)), 8)


@query(
    "gap_stats",
    """WITH l AS (SELECT symbol, epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS gap FROM bars15),
       m AS (SELECT symbol, quantile_cont(gap,0.5) AS med FROM l GROUP BY 1)
       SELECT l.symbol, round(avg(gap)/1e6,6) AS mean_gap, round(any_value(med)/1e6,6) AS median_gap, count_if(gap>3*med) AS long_gaps FROM l JOIN m ON l.symbol=m.symbol GROUP BY 1""",
)
def _(spark, sf):
    from tidemark.operators.quality import gap_stats

    return rounded(gap_stats(bars(spark, sf, 900)))


__all__ = ["BOOK", "CHUNK", "div", "epoch_s", "position_book", "r6", "rounded"]
