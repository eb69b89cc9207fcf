"""Execution analysis queries: an execution is the ticks of one symbol in one hour."""

from pyspark.sql import functions as F

from tidemark.functions.core import floor_ts
from tidemark.operators import execution as X
from tidemark.operators.temporal_joins import nearest_join
from tidemark.plans.registry import part, query
from tidemark.plans.report_queries import rounded
from tidemark.sources.standins import bars, ticks

BY = ("symbol", "hour_ts")

part(
    "xfills",
    ("ticks",),
    """SELECT symbol, date_trunc('hour', ts) AS hour_ts, ts, event_id, price, qty AS quantity, user_id % 4 AS venue, event_id % 3 = 0 AS is_maker,
       price*qty*0.0005::DOUBLE AS fees, CASE WHEN hour(ts) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 'algo'||(hour(ts) % 3) AS algo,
       sum(qty) OVER (PARTITION BY date_trunc('hour', ts)) AS market_volume, sum(qty) OVER (PARTITION BY symbol, date_trunc('hour', ts)) + (hour(ts) % 3)*20 AS target_quantity FROM ticks""",
)
part(
    "execs0",
    ("xfills",),
    """SELECT symbol, hour_ts, max(side) AS side, max(algo) AS algo, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS slices, sum(quantity)::BIGINT AS executed, max(target_quantity)::BIGINT AS target,
       max(market_volume)::BIGINT AS market_volume, sum(price*quantity) AS notional, sum(fees) AS fees, arg_min(price,(ts,event_id)) AS arrival_price, avg(is_maker::INT) AS maker_ratio, count(DISTINCT venue) AS venues FROM xfills GROUP BY 1,2""",
)
part(
    "execs1",
    ("execs0",),
    """SELECT *, coalesce(executed/nullif(target,0),0) AS fill_rate, coalesce(notional/nullif(executed,0),arrival_price) AS avg_price, (epoch_us(end_ts)-epoch_us(start_ts))/1e6 AS duration_seconds,
       coalesce(executed/nullif(market_volume,0),0) AS participation FROM execs0""",
)
part(
    "execs2",
    ("execs1",),
    """SELECT *, CASE WHEN side='SELL' THEN -1 ELSE 1 END*(avg_price-arrival_price)/arrival_price*10000 AS slippage_bps, greatest(0,abs((avg_price-arrival_price)/arrival_price*10000)-5) AS impact_bps FROM execs1""",
)
part(
    "execs3",
    ("execs2",),
    """SELECT *, (fill_rate<0.8)::INT+(abs(slippage_bps)>50)::INT+(impact_bps>30)::INT+(duration_seconds>3600)::INT+(participation>0.5)::INT AS n_flags FROM execs2""",
)
part(
    "execs",
    ("execs3",),
    """SELECT *, greatest(0,least(100, fill_rate*30 + greatest(0,25-least(25,abs(slippage_bps)/2)) + greatest(0,20-least(20,impact_bps))
       + CASE WHEN participation<0.05 THEN participation*200 WHEN participation<0.3 THEN 10 ELSE greatest(0,10-(participation-0.3)*25) END + maker_ratio*10 + greatest(0,5-n_flags))) AS quality_score FROM execs3""",
)


def exec_fills(spark, sf):
    t = ticks(spark, sf).withColumn("hour_ts", floor_ts("ts", 3600))
    volume = t.groupBy("hour_ts").agg(F.sum("qty").alias("market_volume"))
    own = t.groupBy("symbol", "hour_ts").agg(F.sum("qty").alias("_own"))
    hour = F.hour("ts")
    return (
        t.join(volume, "hour_ts")
        .join(own, ["symbol", "hour_ts"])
        .select(
            "symbol", "hour_ts", "ts", "event_id", "price", F.col("qty").alias("quantity"),
            F.pmod("user_id", F.lit(4)).alias("venue"), (F.pmod("event_id", F.lit(3)) == 0).alias("is_maker"),
            (F.col("price") * F.col("qty") * 0.0005).alias("fees"),
            F.when(F.pmod(hour, F.lit(2)) == 0, "BUY").otherwise("SELL").alias("side"),
            F.concat(F.lit("algo"), F.pmod(hour, F.lit(3)).cast("string")).alias("algo"),
            "market_volume", (F.col("_own") + F.pmod(hour, F.lit(3)) * 20).alias("target_quantity"),
        )
    )


def execs(spark, sf):
    return X.execution_metrics(exec_fills(spark, sf), BY)


@query(
    "execution_metrics",
    """SELECT symbol, hour_ts, side, slices, executed, round(fill_rate,8) AS fill_rate, round(avg_price,6) AS avg_price, round(slippage_bps,5) AS slippage_bps, round(impact_bps,5) AS impact_bps,
       round(participation,8) AS participation, round(maker_ratio,8) AS maker_ratio, venues, duration_seconds FROM execs""",
)
def _(spark, sf):
    d = execs(spark, sf).select(
        *BY, "side", "slices", "executed", "fill_rate", "avg_price", "slippage_bps", "impact_bps", "participation", "maker_ratio", "venues", "duration_seconds"
    )
    return rounded(d, 8, avg_price=6, slippage_bps=5, impact_bps=5)


@query(
    "execution_anomaly_flags",
    """SELECT symbol, hour_ts, concat_ws(',', CASE WHEN fill_rate<0.8 THEN 'LOW_FILL_RATE' END, CASE WHEN abs(slippage_bps)>50 THEN 'HIGH_SLIPPAGE' END, CASE WHEN impact_bps>30 THEN 'HIGH_MARKET_IMPACT' END,
       CASE WHEN duration_seconds>3600 THEN 'LONG_EXECUTION_TIME' END, CASE WHEN participation>0.5 THEN 'HIGH_PARTICIPATION_RATE' END) AS flags FROM execs""",
)
def _(spark, sf):
    return execs(spark, sf).select(*BY, F.concat_ws(",", "flags").alias("flags"))


@query("quality_score", "SELECT symbol, hour_ts, round(quality_score,6) AS quality_score, CASE WHEN quality_score>=90 THEN 'A' WHEN quality_score>=80 THEN 'B' WHEN quality_score>=70 THEN 'C' WHEN quality_score>=60 THEN 'D' ELSE 'F' END AS grade FROM execs")
def _(spark, sf):
    return rounded(execs(spark, sf).select(*BY, "quality_score", X.grade("quality_score").alias("grade")))


@query(
    "ladder_scores",
    """WITH g AS (SELECT algo, avg(abs(slippage_bps)) AS s, avg(duration_seconds) AS t, avg(impact_bps) AS i, avg((executed>0)::INT) AS f, stddev_pop(slippage_bps) AS v FROM execs GROUP BY 1),
       x AS (SELECT algo, CASE WHEN s<=2 THEN 100 WHEN s<=5 THEN 80 WHEN s<=10 THEN 60 ELSE greatest(20,60-(s-10)*2) END AS c, CASE WHEN t<=60 THEN 100 WHEN t<=600 THEN 80 WHEN t<=1800 THEN 60 ELSE greatest(20,60-(t-1800)/10) END AS p,
         CASE WHEN i<=5 THEN 100 WHEN i<=15 THEN 80 ELSE greatest(20,80-(i-15)*2) END AS m, CASE WHEN v<=2 THEN 100 WHEN v<=5 THEN 80 ELSE greatest(20,80-(v-5)*5) END AS k, f FROM g)
       SELECT algo, round(c,5) AS cost_score, round(p,5) AS speed_score, round(m,5) AS impact_score, round(k,5) AS consistency_score, round(c*0.3+p*0.2+f*20+m*0.2+k*0.1,5) AS overall FROM x""",
)
def _(spark, sf):
    d = X.ladder_scores(execs(spark, sf), ["algo"])
    return rounded(d.select("algo", "cost_score", "speed_score", "impact_score", "consistency_score", "overall"), 5)


@query(
    "cost_breakdown",
    """WITH c AS (SELECT *, coalesce(fees/nullif(notional,0),0)*10000 AS cb, greatest(5,abs(slippage_bps)*0.3) AS sb, least(10,duration_seconds/360) AS tb FROM execs)
       SELECT symbol, hour_ts, round(cb,5) AS commission_bps, round(sb,5) AS spread_bps, round(impact_bps,5) AS impact_bps, round(tb,9) AS timing_bps, round(cb+sb+impact_bps+tb,5) AS total_bps, round((cb+sb+impact_bps+tb)/10000*notional,4) AS total_cost FROM c""",
)
def _(spark, sf):
    d = X.cost_breakdown(execs(spark, sf))
    return rounded(d.select(*BY, "commission_bps", "spread_bps", "impact_bps", "timing_bps", "total_bps", "total_cost"), 5, timing_bps=9, total_cost=4)


@query(
    "tca_report",
    """SELECT concat_ws(',', CASE WHEN grouping(algo)=0 THEN 'algo' END, CASE WHEN grouping(symbol)=0 THEN 'symbol' END, CASE WHEN grouping(side)=0 THEN 'side' END) AS "grouping", algo, symbol, side, count(*) AS executions,
       round(avg(fill_rate),6) AS fill_rate, round(avg(slippage_bps),5) AS slippage_bps, round(sum(slippage_bps*notional)/sum(notional),5) AS weighted_slippage_bps, round(avg(quality_score),5) AS quality_score,
       round(sum(notional),4) AS notional, sum(n_flags)::BIGINT AS flags FROM execs GROUP BY GROUPING SETS ((algo),(symbol),(side),())""",
)
def _(spark, sf):
    d = X.tca_report(execs(spark, sf), [["algo"], ["symbol"], ["side"], []])
    return rounded(d, 5, fill_rate=6, notional=4)


_NEXT = "n AS (SELECT symbol, ts, price, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nx FROM ticks)"
_TWAP = f"""{_NEXT}, j AS (SELECT e.symbol, e.hour_ts, n.price, (least(epoch_us(coalesce(n.nx,e.end_ts)),epoch_us(e.end_ts))-epoch_us(n.ts))::DOUBLE AS w FROM execs0 e JOIN n ON e.symbol=n.symbol AND n.ts BETWEEN e.start_ts AND e.end_ts),
         tw AS (SELECT symbol, hour_ts, coalesce(sum(price*w)/nullif(sum(w),0),avg(price)) AS twap FROM j GROUP BY 1,2)"""


@query("twap_benchmark", f"WITH {_TWAP} SELECT symbol, hour_ts, round(twap,6) AS twap FROM tw")
def _(spark, sf):
    return rounded(X.twap(execs(spark, sf), ticks(spark, sf), BY))


_VW = """p AS (SELECT * FROM ticks WHERE event_id % 2 = 0), v AS (SELECT symbol, ts, qty FROM ticks WHERE event_id % 2 = 1),
         b AS (SELECT p.event_id, p.symbol, p.ts, p.price, v.qty AS bq, v.ts AS bt FROM p ASOF LEFT JOIN v ON p.symbol=v.symbol AND p.ts >= v.ts),
         f AS (SELECT p.event_id, v.qty AS fq, v.ts AS ft FROM p ASOF LEFT JOIN v ON p.symbol=v.symbol AND p.ts <= v.ts),
         pv AS (SELECT b.symbol, b.ts, b.price, CASE WHEN least(coalesce(epoch_us(b.ts)-epoch_us(bt),9e15), coalesce(epoch_us(ft)-epoch_us(b.ts),9e15)) < 300000000
           THEN CASE WHEN bt IS NOT NULL AND (ft IS NULL OR epoch_us(b.ts)-epoch_us(bt) <= epoch_us(ft)-epoch_us(b.ts)) THEN bq ELSE fq END END AS volume FROM b JOIN f ON b.event_id=f.event_id),
         vw AS (SELECT e.symbol, e.hour_ts, sum(price*volume) FILTER (volume IS NOT NULL)/nullif(sum(volume),0) AS vwap FROM execs0 e JOIN pv ON e.symbol=pv.symbol AND pv.ts BETWEEN e.start_ts AND e.end_ts GROUP BY 1,2)"""


def vwap_table(spark, sf, e):
    t = ticks(spark, sf)
    odd = F.pmod("event_id", F.lit(2)) == 1
    prices = t.where(~odd).select("event_id", "symbol", "ts", "price")
    near = nearest_join(prices, t.where(odd).select("symbol", "ts", F.col("qty").alias("volume")), ["volume"], 300, chunk_seconds=None)
    return X.vwap(e, near, BY, X.twap(e, t, BY))


@query("vwap_benchmark", f"WITH {_TWAP}, {_VW} SELECT tw.symbol, tw.hour_ts, round(coalesce(vwap,twap),6) AS vwap FROM tw LEFT JOIN vw ON tw.symbol=vw.symbol AND tw.hour_ts=vw.hour_ts")
def _(spark, sf):
    return rounded(vwap_table(spark, sf, execs(spark, sf)))


@query(
    "bps_costs",
    """SELECT event_id, symbol, round(CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END*(price-arrival)/arrival*10000,5) AS bps FROM (SELECT t.*, b.open AS arrival FROM ticks t JOIN bars b ON t.symbol=b.symbol AND date_trunc('hour',t.ts)=b.ts)""",
)
def _(spark, sf):
    from tidemark.functions.candles import bps

    b = bars(spark, sf).select("symbol", F.col("ts").alias("_h"), F.col("open").alias("arrival"))
    side = F.when(F.pmod("user_id", F.lit(2)) == 0, "BUY").otherwise("SELL")
    t = ticks(spark, sf).withColumns({"_h": floor_ts("ts", 3600), "side": side}).join(b, ["symbol", "_h"])
    return rounded(t.select("event_id", "symbol", bps("price", "arrival").alias("bps")), 5)


@query(
    "parent_order_rollup",
    """SELECT l_orderkey AS order_id, count(*) AS slices, sum(l_quantity) AS executed, round(sum(round(l_extendedprice*100))/sum(l_quantity)/100,8) AS vwap, min(l_shipdate) AS start_ts, max(l_shipdate) AS end_ts,
       date_diff('day', min(l_shipdate), max(l_shipdate)) AS days, round(avg((l_returnflag='N')::INT),6) AS passive_ratio FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    from tidemark.sources.standins import fills

    d = fills(spark, sf).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("slices"), F.sum("quantity").alias("executed"),
        (F.sum(F.round(F.col("notional") * 100)) / F.sum("quantity") / 100).alias("vwap"),
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        F.date_diff(F.max("ts"), F.min("ts")).alias("days"), F.avg(F.col("is_maker").cast("double")).alias("passive_ratio"),
    )
    return rounded(d, vwap=8)


@query(
    "intraday_volume_curve",
    """WITH d AS (SELECT symbol, (hour(ts)*60+minute(ts))//60 AS slot, sum(volume) AS volume FROM bars15 GROUP BY 1,2), s AS (SELECT *, volume/sum(volume) OVER (PARTITION BY symbol) AS share FROM d)
       SELECT symbol, slot, volume, round(share,8) AS share, round(sum(share) OVER (PARTITION BY symbol ORDER BY slot),8) AS cum_share FROM s""",
)
def _(spark, sf):
    return rounded(X.volume_curve(bars(spark, sf, 900)), 8)


@query(
    "violations",
    """SELECT symbol, hour_ts, 'high_slippage' AS type, CASE WHEN abs(slippage_bps)>100 THEN 'high' ELSE 'medium' END AS severity, round(abs(slippage_bps),6) AS value, 50.0::DOUBLE AS "limit" FROM execs WHERE abs(slippage_bps)>50
       UNION ALL SELECT symbol, hour_ts, 'execution_timeout', 'medium', round(duration_seconds,6), 300.0 FROM execs WHERE duration_seconds>300
       UNION ALL SELECT symbol, hour_ts, 'low_fill_rate', CASE WHEN fill_rate>0.7 THEN 'medium' ELSE 'high' END, round(fill_rate,6), 0.9 FROM execs WHERE fill_rate<0.9""",
)
def _(spark, sf):
    return rounded(X.violations(execs(spark, sf), BY))


@query(
    "implementation_shortfall",
    f"""WITH {_TWAP} SELECT e.symbol, e.hour_ts, round(slippage_bps,5) AS vs_arrival_bps, round(CASE WHEN side='SELL' THEN -1 ELSE 1 END*(avg_price-twap)/twap*10000,5) AS vs_benchmark_bps,
        round(slippage_bps/10000*arrival_price*executed,5) AS shortfall FROM execs e JOIN tw ON e.symbol=tw.symbol AND e.hour_ts=tw.hour_ts""",
)
def _(spark, sf):
    e = execs(spark, sf)
    d = X.shortfall(e.join(X.twap(e, ticks(spark, sf), BY), list(BY)), "twap")
    return rounded(d.select(*BY, "vs_arrival_bps", "vs_benchmark_bps", "shortfall"), 5)


@query(
    "cross_venue_spread_join",
    """WITH q AS (SELECT symbol, date_trunc('hour',ts) AS ts, user_id % 4 AS venue, avg(price)*(1-0.0002::DOUBLE) AS bid, avg(price)*(1+0.0002::DOUBLE) AS ask, sum(qty) AS q FROM ticks GROUP BY 1,2,3),
       j AS (SELECT a.symbol, a.ts, a.venue AS buy_venue, b.venue AS sell_venue, (b.bid-a.ask)/a.ask*10000-20 AS p, least(a.q,b.q) AS qty FROM q a JOIN q b ON a.symbol=b.symbol AND a.ts=b.ts AND a.venue<>b.venue AND b.bid>a.ask)
       SELECT symbol, ts, buy_venue, sell_venue, round(p,5) AS profit_bps, qty::BIGINT AS qty FROM j WHERE p>=5 ORDER BY p DESC, symbol, ts, buy_venue, sell_venue LIMIT 10""",
)
def _(spark, sf):
    t = ticks(spark, sf).groupBy("symbol", floor_ts("ts", 3600).alias("ts"), F.pmod("user_id", F.lit(4)).alias("venue"))
    q = t.agg(
        (F.avg("price") * (1 - 0.0002)).alias("bid"), (F.avg("price") * (1 + 0.0002)).alias("ask"),
        F.sum("qty").alias("bid_qty"), F.sum("qty").alias("ask_qty"),
    )
    d = X.cross_venue_spreads(q)
    return rounded(d.select("symbol", "ts", "buy_venue", "sell_venue", "profit_bps", "qty"), 5)
