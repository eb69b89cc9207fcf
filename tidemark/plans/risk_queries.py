"""Performance, portfolio and risk queries."""

from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.operators import reports as R
from tidemark.operators import risk as K
from tidemark.operators.frames import framed
from tidemark.operators.joins import corr_matrix
from tidemark.operators.rolling import regimes_ma_vol
from tidemark.operators.series import with_returns
from tidemark.operators.temporal_joins import asof_join
from tidemark.plans.feature_queries import _TR
from tidemark.plans.registry import part, query
from tidemark.plans.report_queries import BOOK, position_book, rounded
from tidemark.plans.sqltext import ewm, full, lag, mean, over, pct, std
from tidemark.plans.window_queries import REGIME, b1
from tidemark.sources.standins import bars, chain, round_trips, ticks, trades

part("book", ("ticks",), BOOK)
part("weights", ("book",), "SELECT symbol, market_value/(SELECT sum(abs(market_value)) FROM book) AS weight FROM book")
part(
    "port",
    ("rets", "weights"),
    "SELECT r.ts, sum(w.weight*r.ret) AS pr FROM rets r JOIN weights w ON r.symbol=w.symbol WHERE r.ret IS NOT NULL GROUP BY r.ts",
)
part(
    "covs",
    ("rets",),
    """SELECT a.symbol AS a, b.symbol AS b, covar_samp(a.ret,b.ret) AS cov FROM rets a JOIN rets b ON a.ts=b.ts
       WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1,2""",
)


def rets(spark, sf):
    return with_returns(b1(spark, sf, "close", "volume"))


def weights(spark, sf):
    book = position_book(spark, sf)
    total = book.agg(F.sum(F.abs("market_value")).alias("_g"))
    return book.join(F.broadcast(total)).select("symbol", "qty", "market_value", (F.col("market_value") / F.col("_g")).alias("weight"))


_DD = """c AS (SELECT symbol, ts, trade_id, sum(pnl_pct) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS eq FROM round_trips),
       dd AS (SELECT symbol, min(eq-pk) AS max_drawdown FROM (SELECT symbol, eq, greatest(0,max(eq) OVER (PARTITION BY symbol ORDER BY ts, trade_id)) AS pk FROM c) GROUP BY 1)"""


@query(
    "backtest_metrics",
    f"""WITH {_DD}, v AS (SELECT symbol, quantile_cont(pnl_pct,0.05) AS var_5 FROM round_trips GROUP BY 1),
        t AS (SELECT r.symbol, avg(pnl_pct) AS cvar_5 FROM round_trips r JOIN v ON r.symbol=v.symbol WHERE pnl_pct<=var_5 GROUP BY 1),
        b AS (SELECT symbol, count(*) AS trades, count_if(pnl_pct>0)*1.0::DOUBLE/count(*) AS win_rate, sum(pnl_pct) FILTER (pnl_pct>0)/abs(sum(pnl_pct) FILTER (pnl_pct<0)) AS profit_factor,
          avg(pnl_pct) AS m, stddev_samp(pnl_pct) AS s, sqrt(avg(CASE WHEN pnl_pct<0 THEN pnl_pct*pnl_pct ELSE 0 END)) AS dn, skewness(pnl_pct) AS skewness, kurtosis(pnl_pct) AS kurtosis,
          sum(pnl_pct) AS total FROM round_trips GROUP BY 1)
        SELECT b.symbol, trades, round(win_rate,6) AS win_rate, round(profit_factor,6) AS profit_factor, round(m,6) AS expectancy, round(skewness,6) AS skewness, round(kurtosis,6) AS kurtosis,
        round(total,6) AS total, round(var_5,6) AS var_5, round(cvar_5,6) AS cvar_5, round(max_drawdown,6) AS max_drawdown, round(m/s*sqrt(365),6) AS sharpe, round(m/dn*sqrt(365),6) AS sortino,
        round(total/abs(max_drawdown),6) AS calmar, round(m/(s/sqrt(trades)),6) AS t_stat FROM b JOIN v ON b.symbol=v.symbol JOIN t ON b.symbol=t.symbol JOIN dd ON b.symbol=dd.symbol""",
)
def _(spark, sf):
    return rounded(K.backtest_metrics(round_trips(spark, sf)))


@query(
    "live_performance",
    """WITH r AS (SELECT * FROM round_trips WHERE ts <= TIMESTAMP '2024-01-25'),
       k AS (SELECT symbol, pnl, (row_number() OVER (PARTITION BY symbol ORDER BY ts, trade_id)-1)//10 AS g FROM r),
       g AS (SELECT symbol, avg((t>0)::INT) AS consistency FROM (SELECT symbol, g, sum(pnl) AS t FROM k GROUP BY 1,2 HAVING count(*)=10) GROUP BY 1)
       SELECT r.symbol, count(*) AS trades, round(sum(pnl),6) AS pnl, round(count_if(pnl>0)*1.0/count(*),6) AS win_rate,
       round(sum(pnl) FILTER (pnl>0)/abs(sum(pnl) FILTER (pnl<0)),6) AS profit_factor, count_if(ts > TIMESTAMP '2024-01-24') AS trades_24h,
       round(coalesce(sum(pnl) FILTER (ts > TIMESTAMP '2024-01-24'),0),6) AS pnl_24h, round(any_value(consistency),6) AS consistency FROM r JOIN g ON r.symbol=g.symbol GROUP BY 1""",
)
def _(spark, sf):
    return rounded(K.live_performance(round_trips(spark, sf), "2024-01-25"))


@query(
    "by_regime_performance",
    f"""WITH {REGIME}, k AS (SELECT symbol, ts + INTERVAL 1 HOUR AS kts, regime FROM g), j AS (SELECT t.*, k.regime FROM round_trips t ASOF LEFT JOIN k ON t.symbol=k.symbol AND t.ts >= k.kts)
        SELECT regime, count(*) AS trades, round(count_if(pnl_pct>0)*1.0/count(*),6) AS win_rate, round(avg(pnl_pct),6) AS mean, round(stddev_samp(pnl_pct),6) AS std,
        round(avg(pnl_pct)/stddev_samp(pnl_pct),6) AS sharpe, round(count(*)/sum(count(*)) OVER (),6) AS trade_share FROM j GROUP BY 1""",
)
def _(spark, sf):
    g = regimes_ma_vol(b1(spark, sf)).select("symbol", (F.col("ts") + F.expr("interval 1 hour")).alias("kts"), "regime")
    d = asof_join(round_trips(spark, sf), g, ["regime"], right_ts="kts", chunk_seconds=None)
    return rounded(K.performance_by(d, ["regime"]))


@query(
    "var_es",
    """WITH s AS (SELECT list_sort(list(pr)) AS xs, count(*) AS n, avg(pr) AS m, stddev_samp(pr) AS s FROM port), c AS (SELECT *, xs[CAST(floor(round(n*0.05::DOUBLE,9)) AS BIGINT)+1] AS cut FROM s)
       SELECT n, round(-cut,8) AS var_hist, round(-coalesce((SELECT avg(pr) FROM port WHERE pr < cut),cut),8) AS es_hist, round(s*1.6448536269514722-m,8) AS var_normal,
       round(s*0.10313564037537139/0.05-m,8) AS es_normal FROM c""",
)
def _(spark, sf):
    return rounded(K.var_es(K.portfolio_returns(rets(spark, sf), weights(spark, sf)), "port_ret"), 8)


@query(
    "monte_carlo_var",
    """WITH b AS (SELECT avg(pr) AS m, stddev_samp(pr) AS s FROM port), h AS (SELECT md5('7-' || epoch_us(ts) || '-' || i) AS d FROM port, (SELECT unnest(range(1, 11)) AS i)),
       z AS (SELECT m + s*sqrt(ln((('0x' || substr(d,1,8))::BIGINT+0.5::DOUBLE)/4294967296::DOUBLE)*-2)*cos((('0x' || substr(d,9,8))::BIGINT+0.5::DOUBLE)/4294967296::DOUBLE*6.283185307179586::DOUBLE) AS x FROM h, b),
       c AS (SELECT list_sort(list(x)) AS xs, count(*) AS n FROM z), q AS (SELECT n, xs[CAST(floor(round(n*0.05::DOUBLE,9)) AS BIGINT)+1] AS cut FROM c)
       SELECT n, round(-cut,8) AS var_mc, round(-coalesce((SELECT avg(x) FROM z WHERE x < cut),cut),8) AS es_mc FROM q""",
)
def _(spark, sf):
    return rounded(K.monte_carlo_var(K.portfolio_returns(rets(spark, sf), weights(spark, sf)), "port_ret"), 8)


@query(
    "rolling_var_backtest",
    """WITH v AS (SELECT ts, pr, CASE WHEN count(*) OVER w >= 252 THEN -quantile_cont(pr,0.05) OVER w END AS var FROM port WINDOW w AS (ORDER BY ts ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
       a AS (SELECT count(*) AS days, count_if(-pr>var) AS violations, count_if(abs(pr)>abs(var)) AS violations_abs FROM v WHERE var IS NOT NULL)
       SELECT days, violations, violations_abs, round(violations/days,6) AS rate,
       round(-2*((days-violations)*ln(0.95::DOUBLE)+violations*ln(0.05::DOUBLE)-(days-violations)*ln(1-violations/days)-violations*ln(violations/days)),6) AS kupiec FROM a""",
)
def _(spark, sf):
    d = K.var_backtest(K.portfolio_returns(rets(spark, sf), weights(spark, sf)), "port_ret")
    return rounded(d.drop("p_value"))


@query(
    "stress_scenarios",
    """WITH b AS (SELECT sum(abs(market_value)) AS gross FROM book),
       s(scenario, shock, vf, ill) AS (VALUES ('market_crash',-0.20::DOUBLE,3.0::DOUBLE,0.5::DOUBLE),('flash_crash',-0.10,5.0,0.7),('volatility_spike',-0.05,4.0,0.2),('liquidity_crisis',-0.08,2.0,0.8),('mild_correction',-0.05,1.5,0.1)),
       l AS (SELECT scenario, gross, gross*abs(shock) + gross*0.02::DOUBLE*vf + gross*ill*0.01::DOUBLE AS loss FROM b, s)
       SELECT scenario, round(loss,4) AS loss, round(loss/gross,6) AS loss_share, CASE WHEN loss/gross>=0.2 THEN 'critical' WHEN loss/gross>=0.1 THEN 'high' WHEN loss/gross>=0.05 THEN 'medium' ELSE 'low' END AS level FROM l""",
)
def _(spark, sf):
    d = K.stress_losses(position_book(spark, sf))
    return rounded(d.select("scenario", "loss", "loss_share", "level"), loss=4)


@query(
    "risk_attribution",
    """WITH d AS (SELECT c.a, any_value(wa.weight) AS w, sum(c.cov*wb.weight) AS sw, max(CASE WHEN c.a=c.b THEN sqrt(c.cov) END) AS vol FROM covs c JOIN weights wa ON c.a=wa.symbol JOIN weights wb ON c.b=wb.symbol GROUP BY 1),
       p AS (SELECT sqrt(sum(w*sw)) AS pv, sum(abs(w)*vol) AS wv FROM d)
       SELECT a AS symbol, round(w,6) AS weight, round(vol,8) AS vol, round(pv,8) AS portfolio_vol, round(sw/pv,8) AS marginal, round(w*sw/pv,8) AS component, round(w*sw/pv/pv,6) AS share, round(wv/pv,6) AS diversification FROM d, p""",
)
def _(spark, sf):
    d = K.risk_attribution(K.covariance(rets(spark, sf)), weights(spark, sf))
    return rounded(d, vol=8, portfolio_vol=8, marginal=8, component=8)


@query(
    "marginal_var",
    """WITH t AS (SELECT sum(weight) AS tw FROM weights), b AS (SELECT r.symbol, (p.pr+r.ret*0.001)*tw/(tw+0.001) AS x FROM rets r JOIN port p ON r.ts=p.ts, t WHERE r.ret IS NOT NULL),
       q0 AS (SELECT quantile_cont(pr,0.05) AS q0 FROM port), q1 AS (SELECT symbol, quantile_cont(x,0.05) AS q1 FROM b GROUP BY 1)
       SELECT symbol, round(-q0,8) AS var, round((q0-q1)/0.001,5) AS marginal_var FROM q1, q0""",
)
def _(spark, sf):
    return rounded(K.marginal_var(rets(spark, sf), weights(spark, sf)), 8, marginal_var=5)


@query(
    "beta_concentration",
    """WITH d AS (SELECT p.pr, r.ret AS ref FROM port p JOIN rets r ON p.ts=r.ts WHERE r.symbol='purchase' AND r.ret IS NOT NULL),
       b AS (SELECT covar_samp(pr,ref)/var_samp(ref) AS beta, count(*) AS n FROM d), h AS (SELECT sum(weight*weight) AS hhi, max(abs(weight)) AS largest FROM weights)
       SELECT round(beta,6) AS beta, n, round(hhi,6) AS hhi, round(largest,6) AS largest FROM b, h""",
)
def _(spark, sf):
    return rounded(K.beta_concentration(rets(spark, sf), weights(spark, sf), "purchase"))


@query(
    "kelly_weights",
    """WITH a AS (SELECT symbol, count(*) AS trades, count_if(pnl_pct>0)*1.0::DOUBLE/count(*) AS p, avg(pnl_pct) FILTER (pnl_pct>0)/abs(avg(pnl_pct) FILTER (pnl_pct<0)) AS b, avg(confidence) AS confidence FROM round_trips GROUP BY 1)
       SELECT symbol, trades, round(p,6) AS p, round(confidence,6) AS confidence, round(b,6) AS b, round((b*p-(1-p))/b,6) AS kelly, round(greatest(0,least((b*p-(1-p))/b*confidence,0.25)),6) AS weight FROM a""",
)
def _(spark, sf):
    return rounded(K.kelly_weights(round_trips(spark, sf)))


_VOLS = "v AS (SELECT symbol, stddev_samp(ret) AS vol FROM rets GROUP BY 1)"


def vols(spark, sf):
    return rets(spark, sf).groupBy("symbol").agg(F.stddev_samp("ret").alias("vol"))


@query(
    "vol_target_caps",
    f"""WITH {_VOLS}, s AS (SELECT w.symbol, w.weight*greatest(0.2,least(2.0,0.01/vol)) AS scaled FROM weights w JOIN v ON w.symbol=v.symbol),
        k AS (SELECT * FROM s ORDER BY abs(scaled) DESC, symbol LIMIT 4), g AS (SELECT sum(abs(scaled)) AS gross FROM k)
        SELECT symbol, round(scaled,6) AS scaled, round(scaled/gross,6) AS normalized, round(scaled*least(1.0,0.5/gross),6) AS capped FROM k, g""",
)
def _(spark, sf):
    d = weights(spark, sf).select("symbol", "weight").join(vols(spark, sf), "symbol")
    return rounded(K.vol_target_weights(d, 0.01, 0.5, 4).drop("weight", "vol"))


@query(
    "portfolio_summary",
    """WITH m AS (SELECT symbol, avg(ret) AS e FROM rets GROUP BY 1), a AS (SELECT count(*) AS positions, sum(abs(weight)) AS gross, sum(weight) AS net, coalesce(sum(weight) FILTER (weight>0),0) AS "long",
         coalesce(-sum(weight) FILTER (weight<0),0) AS short, sum(weight*e) AS er FROM weights w JOIN m ON w.symbol=m.symbol),
       p AS (SELECT sqrt(sum(c.cov*wa.weight*wb.weight)) AS vol FROM covs c JOIN weights wa ON c.a=wa.symbol JOIN weights wb ON c.b=wb.symbol)
       SELECT positions, round(gross,6) AS gross, round(net,6) AS net, round("long",6) AS "long", round(short,6) AS short, round(er,10) AS expected_return, round(vol,8) AS volatility, round(er/vol,6) AS sharpe, round(vol*1.6448536269514722,8) AS var FROM a, p""",
)
def _(spark, sf):
    r = rets(spark, sf)
    d = K.portfolio_summary(weights(spark, sf), K.covariance(r), r.groupBy("symbol").agg(F.avg("ret").alias("expected")))
    return rounded(d, expected_return=10, volatility=8, var=8)


@query(
    "position_risk",
    f"""WITH {_VOLS}, d AS (SELECT symbol, avg(x) AS dv FROM (SELECT symbol, date_trunc('day',ts) AS d, sum(volume) AS x FROM bars GROUP BY 1,2) GROUP BY 1), g AS (SELECT sum(abs(market_value)) AS gross FROM book)
        SELECT b.symbol, round(abs(market_value)*vol*1.6448536269514722,4) AS var_1d, round(abs(market_value)*vol*1.6448536269514722*sqrt(5),4) AS var_5d, round(abs(market_value)*vol*0.10313564037537139/0.05,4) AS shortfall,
        round(abs(market_value)/gross,6) AS concentration, round(abs(qty)/(dv*0.1),6) AS days_to_liquidate FROM book b JOIN v ON b.symbol=v.symbol JOIN d ON b.symbol=d.symbol, g""",
)
def _(spark, sf):
    daily = R.mergeable_rollup(bars(spark, sf), "volume", "day", ["symbol"]).groupBy("symbol").agg(F.avg("total").alias("daily_volume"))
    d = K.position_risk(position_book(spark, sf), vols(spark, sf), daily)
    return rounded(d.select("symbol", "var_1d", "var_5d", "shortfall", "concentration", "days_to_liquidate"), 4, concentration=6, days_to_liquidate=6)


@query(
    "correlation_limits",
    """WITH c AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.ret,b.ret) AS corr FROM rets a JOIN rets b ON a.ts=b.ts AND a.symbol<b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1,2)
       SELECT a, b, round(corr,6) AS corr, round(abs(p.market_value)+abs(q.market_value),4) AS exposure, round(greatest(0,1-2*(abs(corr)-0.01)),6) AS size_factor FROM c JOIN book p ON a=p.symbol JOIN book q ON b=q.symbol
       WHERE abs(corr)>0.01 AND abs(p.market_value)+abs(q.market_value)>10000""",
)
def _(spark, sf):
    c = corr_matrix(rets(spark, sf), "ret")
    return rounded(K.correlation_limits(c, position_book(spark, sf), 0.01).drop("n"), exposure=4)


@query(
    "position_pnl",
    """WITH m AS (SELECT symbol, arg_max(price,(ts,event_id)) AS mark FROM ticks GROUP BY 1),
       j AS (SELECT p.key, p.symbol, e.ts IS NULL AS is_open, (coalesce(e.price,m.mark)-p.price)*CASE WHEN p.side='SELL' THEN -1 ELSE 1 END AS d, p.qty, p.price, (epoch_us(e.ts)-epoch_us(p.ts))/6e7 AS holding_minutes
         FROM positions p LEFT JOIN executions e ON p.key=e.key JOIN m ON p.symbol=m.symbol)
       SELECT key, symbol, is_open, round(d*qty,6) AS pnl, round(d*100/price,6) AS pnl_pct, round(holding_minutes,8) AS holding_minutes FROM j""",
)
def _(spark, sf):
    _, p, e = chain(spark, sf)
    marks = ticks(spark, sf).groupBy("symbol").agg(F.max_by("price", F.struct("ts", "event_id")).alias("mark"))
    d = K.mark_positions(p, e, marks)
    return rounded(d.select("key", "symbol", "is_open", "pnl", "pnl_pct", "holding_minutes"), holding_minutes=8)


@query(
    "var_breach_rate",
    """WITH d AS (SELECT strategy, date_trunc('day',ts) AS ts, sum(pnl) AS pnl FROM trades GROUP BY 1,2),
       v AS (SELECT *, CASE WHEN count(*) OVER w >= 60 THEN -quantile_cont(pnl,0.05) OVER w END AS var FROM d WINDOW w AS (PARTITION BY strategy ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
       SELECT strategy, count(*) AS days, count_if(pnl < -var) AS breaches, round(count_if(pnl < -var)*100.0/count(*),6) AS breach_pct, abs(count_if(pnl < -var)*100.0/count(*)-5.0)<=2.0 AS good FROM v WHERE var IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    daily = R.pnl_curve_rollup(trades(spark, sf)).withColumnRenamed("bucket", "ts")
    d = K.rolling_var(daily, "pnl", 60, 0.05, ["strategy"])
    return rounded(K.var_breach_rate(d, by=["strategy"]))


@query(
    "trade_costs",
    """WITH t AS (SELECT t.event_id, t.symbol, t.price, t.qty AS quantity, t.qty*10 AS holding_minutes, b.volume FROM ticks t JOIN bars b ON t.symbol=b.symbol AND date_trunc('hour',t.ts)=b.ts),
       c AS (SELECT event_id, abs(quantity*price) AS size, least(coalesce(least(abs(quantity*price)/nullif(volume*price,0),0.01)*0.1,0)+0.0005+0.0001,0.01) AS slippage, floor(holding_minutes/480)*0.0001*abs(quantity*price) AS funding,
         abs(quantity*price)*0.0004*2 AS commission FROM t)
       SELECT event_id, round(slippage,8) AS slippage, round(funding,6) AS funding, round(commission,6) AS commission, round(slippage*size+funding+commission,6) AS total_cost FROM c""",
)
def _(spark, sf):
    from tidemark.functions.core import floor_ts

    b = bars(spark, sf).select("symbol", F.col("ts").alias("_h"), "volume")
    t = ticks(spark, sf).withColumn("_h", floor_ts("ts", 3600)).join(b, ["symbol", "_h"])
    t = t.withColumns({"quantity": F.col("qty"), "holding_minutes": F.col("qty") * 10})
    d = K.trade_costs(t, "volume")
    return rounded(d.select("event_id", "slippage", "funding", "commission", "total_cost"), slippage=8)


@query(
    "realized_volatility",
    f"""WITH s AS (SELECT symbol, ts, {std('ret', 24)} AS s FROM rets)
        SELECT symbol, ts, round(CASE WHEN s IS NOT NULL THEN greatest(0.01,least(s*sqrt(24),0.5)) END,8) AS daily_vol, round(s*sqrt(24*365),8) AS annual_vol FROM s""",
)
def _(spark, sf):
    d = K.realized_volatility(rets(spark, sf), 24, 24)
    return rounded(d.select("symbol", "ts", "daily_vol", "annual_vol"), 8)


@query(
    "diversification_tiers",
    """WITH a AS (SELECT symbol, avg(volume) AS v, 1-stddev_samp(volume)/avg(volume) AS c FROM bars GROUP BY 1), s AS (SELECT symbol, least(1.0, v/100*c) AS score FROM a),
       t AS (SELECT symbol, CASE WHEN score>0.8 THEN 'high' WHEN score>0.5 THEN 'medium' ELSE 'low' END AS tier FROM s)
       SELECT tier, count(*) AS symbols, round(sum(abs(weight)),6) AS weight, round(sum(abs(weight))/sum(sum(abs(weight))) OVER (),6) AS share FROM weights w JOIN t ON w.symbol=t.symbol GROUP BY 1""",
)
def _(spark, sf):
    return rounded(K.tier_weights(weights(spark, sf), R.liquidity_tiers(bars(spark, sf), 100.0)))


@query(
    "symbol_scoring",
    f"""WITH pf AS (SELECT symbol, count_if(pnl_pct>0)*100.0::DOUBLE/count(*) AS wr, avg(pnl_pct) FILTER (pnl_pct>0)/abs(avg(pnl_pct) FILTER (pnl_pct<=0)) AS wl, avg(pnl_pct)/stddev_pop(pnl_pct) AS sh FROM round_trips GROUP BY 1),
        {_TR}, a AS (SELECT symbol, ts, close, volume, (high-low)/close*1e4 AS sp, {mean('tr', 14)}/close AS ap, {mean('close', 20)} AS mc, {mean('volume', 20)} AS mv FROM t),
        l AS (SELECT *, {mean('sp', 20)} AS ms FROM a), q AS (SELECT symbol, stddev_pop(ap) AS atr_std, arg_max(ap,ts) AS atr_pct, arg_max(mc*mv,ts) AS usd, arg_max(ms,ts) AS spr FROM l GROUP BY 1),
        cc AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.ret,b.ret) AS c FROM rets a JOIN rets b ON a.ts=b.ts AND a.symbol<>b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1,2),
        mc AS (SELECT a AS symbol, max(abs(c)) AS m FROM cc GROUP BY 1),
        s AS (SELECT pf.symbol, least(wr,100)*0.4+least(wl*20,35)+greatest(0,least(sh*12.5,25)) AS p,
          CASE WHEN usd/10000>=5 THEN 60 WHEN usd/10000>=1 THEN 30+(usd/10000-1)/4*30 ELSE usd/10000*30 END + CASE WHEN spr<=5 THEN 40 WHEN spr<=20 THEN 40-(spr-5)/15*20 ELSE greatest(0,20-(spr-20)) END AS l,
          CASE WHEN atr_pct<0.03 THEN 70*atr_pct/0.03 WHEN atr_pct<=0.08 THEN 70 WHEN atr_pct<=0.15 THEN 70-(atr_pct-0.08)/0.07*40 ELSE 10 END + 30/(1+atr_std) AS v,
          greatest(0, CASE WHEN m<=0.3 THEN 100 WHEN m<=0.7 THEN 100-(m-0.3)/0.4*50 ELSE 50-(m-0.7)*200 END) AS c FROM pf JOIN q ON pf.symbol=q.symbol JOIN mc ON pf.symbol=mc.symbol)
        SELECT symbol, round(p,6) AS performance, round(l,6) AS liquidity, round(v,6) AS volatility, round(c,6) AS correlation, round(0.4*p+0.25*l+0.2*v+0.15*c,6) AS total, rank() OVER (ORDER BY 0.4*p+0.25*l+0.2*v+0.15*c DESC) AS rank FROM s""",
)
def _(spark, sf):
    x = F.col("pnl_pct")
    perf = round_trips(spark, sf).groupBy("symbol").agg(
        (F.count_if(x > 0) * 100.0 / F.count(F.lit(1))).alias("win_rate"),
        (F.avg(F.when(x > 0, x)) / F.abs(F.avg(F.when(x <= 0, x)))).alias("win_loss"),
        (F.avg(x) / F.stddev_pop(x)).alias("sharpe"),
    )

    def build(d, fr):
        d = d.withColumns({"_tr": I.true_range(fr), "_sp": (F.col("high") - F.col("low")) / F.col("close") * 1e4})
        return d.withColumns(
            {
                "_ap": fr.mean("_tr", 14) / F.col("close"),
                "_usd": fr.mean("close", 20) * fr.mean("volume", 20),
                "_ms": fr.mean("_sp", 20),
            }
        )

    market = framed(b1(spark, sf, "open", "high", "low", "close", "volume"), build, before=22).groupBy("symbol").agg(
        F.stddev_pop("_ap").alias("atr_std"), F.max_by("_ap", "ts").alias("atr_pct"),
        F.max_by("_usd", "ts").alias("volume_usd"), F.max_by("_ms", "ts").alias("spread_bps"),
    )
    c = corr_matrix(rets(spark, sf), "ret")
    both = c.select(F.col("a").alias("symbol"), "corr").unionByName(c.select(F.col("b").alias("symbol"), "corr"))
    top = both.groupBy("symbol").agg(F.max(F.abs("corr")).alias("max_corr"))
    parts = perf.join(market, "symbol").join(top, "symbol")
    w = {"performance": 0.4, "liquidity": 0.25, "volatility": 0.2, "correlation": 0.15}
    d = K.symbol_scores(parts, 10_000.0, w)
    return rounded(d.select("symbol", *w, "total", "rank"))


__all__ = ["ewm", "full", "lag", "over", "pct"]
