"""Indicators, signals, candle and session features, labels on bars."""

from pyspark.sql import functions as F

from tidemark.functions import candles as C
from tidemark.functions.core import ladder
from tidemark.operators import indicators as I
from tidemark.operators import labels as L
from tidemark.operators import signals as S
from tidemark.operators.frames import framed
from tidemark.operators.rolling import regimes_ma_vol
from tidemark.plans.registry import part, query
from tidemark.plans.report_queries import rounded
from tidemark.plans.sqltext import ewm, full, hi, lag, lead, lo, mean, over, pct, quant, span, std, total
from tidemark.plans.window_queries import REGIME, b1
from tidemark.sources.standins import bars, ticks, trades

BAR = ("open", "high", "low", "close", "volume")


def keep(df, *cols, digits=6, **special):
    return rounded(df.select("symbol", "ts", *cols), digits, **special)


part(
    "rsi14",
    ("bars",),
    f"""SELECT symbol, ts, 100*ag/nullif(ag+al,0) AS rsi FROM (SELECT symbol, ts, {mean('g', 14)} AS ag, {mean('l', 14)} AS al FROM
        (SELECT symbol, ts, greatest(d,0) AS g, greatest(-d,0) AS l FROM (SELECT symbol, ts, close-{lag('close')} AS d FROM bars) WHERE true))""".replace(
        "greatest(d,0) AS g, greatest(-d,0) AS l", "CASE WHEN d IS NOT NULL THEN greatest(d,0) END AS g, CASE WHEN d IS NOT NULL THEN greatest(-d,0) END AS l"
    ),
)


@query("rsi", "SELECT symbol, ts, round(rsi,6) AS rsi FROM rsi14")
def _(spark, sf):
    return keep(I.rsi(b1(spark, sf)), "rsi")


@query(
    "rsi_wilder",
    f"""WITH d AS (SELECT symbol, ts, close-{lag('close')} AS d FROM bars),
        g AS (SELECT symbol, ts, CASE WHEN d IS NOT NULL THEN greatest(d,0) END AS g, CASE WHEN d IS NOT NULL THEN greatest(-d,0) END AS l FROM d),
        a AS (SELECT symbol, ts, list(g) FILTER (g IS NOT NULL) {over(100000)} AS gs, list(l) FILTER (l IS NOT NULL) {over(100000)} AS ls FROM g),
        s AS (SELECT symbol, ts, CASE WHEN len(gs)>=14 THEN list_reduce(list_concat([list_avg(gs[1:14])], gs[15:]), lambda a, b: a*13/14 + b/14) END AS ag,
          CASE WHEN len(ls)>=14 THEN list_reduce(list_concat([list_avg(ls[1:14])], ls[15:]), lambda a, b: a*13/14 + b/14) END AS al FROM a)
        SELECT symbol, ts, round(100*ag/nullif(ag+al,0),6) AS rsi FROM s""",
)
def _(spark, sf):
    return keep(I.rsi_wilder(b1(spark, sf)), "rsi")


@query(
    "moving_averages",
    f"""WITH m AS (SELECT symbol, ts, close, {mean('close', 5)} AS a, {mean('close', 20)} AS b, {mean('close', 50)} AS c FROM bars)
        SELECT symbol, ts, round(a,8) AS sma_5, round(b,8) AS sma_20, round(c,8) AS sma_50, round(close/a-1,8) AS dist_5, round(close/b-1,8) AS dist_20,
        round(close/c-1,8) AS dist_50, round({pct('a')},8) AS slope_5, round({pct('b')},8) AS slope_20, round({pct('c')},8) AS slope_50 FROM m""",
)
def _(spark, sf):
    d = I.moving_averages(b1(spark, sf))
    return keep(d, *[f"{k}_{n}" for k in ("sma", "dist", "slope") for n in (5, 20, 50)], digits=8)


_BB = f"""b AS (SELECT symbol, ts, close, {mean('close', 20)} AS mid, {std('close', 20)} AS s FROM bars),
        w AS (SELECT *, mid+2*s AS up, mid-2*s AS dn, (4*s)/mid AS width FROM b)"""


@query(
    "bollinger",
    f"""WITH {_BB} SELECT symbol, ts, round(mid,8) AS bb_mid, round(up,6) AS bb_upper, round(dn,6) AS bb_lower, round(width,8) AS bb_width,
        round((close-dn)/nullif(up-dn,0),6) AS bb_pct, width < {quant('width', 0.2, 50)} AS squeeze FROM w""",
)
def _(spark, sf):
    d = I.bollinger(b1(spark, sf))
    return keep(d, "bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pct", "squeeze", bb_mid=8, bb_width=8)


@query(
    "macd",
    f"""WITH e AS (SELECT symbol, ts, {ewm('close', 2 / 13)} - {ewm('close', 2 / 27)} AS macd FROM bars),
        s AS (SELECT symbol, ts, macd, {ewm('macd', 0.2)} AS signal FROM e), h AS (SELECT *, macd-signal AS hist FROM s)
        SELECT symbol, ts, round(macd,6) AS macd, round(signal,6) AS signal, round(hist,6) AS hist FROM h""",
)
def _(spark, sf):
    return keep(I.macd(b1(spark, sf)), "macd", "signal", "hist")


@query(
    "stochastic_williams",
    f"""WITH e AS (SELECT symbol, ts, close, {hi('high', 14)} AS h, {lo('low', 14)} AS l FROM bars),
        k AS (SELECT symbol, ts, (close-l)*100/nullif(h-l,0) AS k, (h-close)*-100/nullif(h-l,0) AS r FROM e), d AS (SELECT *, {mean('k', 3)} AS d FROM k)
        SELECT symbol, ts, round(k,6) AS k, round(d,6) AS d, round(3*k-2*d,6) AS j, round(r,6) AS williams_r FROM d""",
)
def _(spark, sf):
    return keep(I.stochastic(b1(spark, sf, *BAR)), "k", "d", "j", "williams_r")


@query(
    "cci",
    f"""WITH t AS (SELECT symbol, ts, (high+low+close)/3 AS tp FROM bars), m AS (SELECT *, {mean('tp', 20)} AS m, list(tp) {over(20)} AS xs FROM t)
        SELECT symbol, ts, round((tp-m)/nullif(0.015*list_sum(list_transform(xs, lambda x: abs(x-m)))/20,0),5) AS cci FROM m""",
)
def _(spark, sf):
    return keep(I.cci(b1(spark, sf, *BAR)), "cci", digits=5)


_TR = f"t AS (SELECT *, greatest(high-low, coalesce(abs(high-{lag('close')}),0), coalesce(abs(low-{lag('close')}),0)) AS tr FROM bars)"


@query(
    "atr_true_range",
    f"WITH {_TR}, a AS (SELECT *, {mean('tr', 14)} AS atr FROM t) SELECT symbol, ts, round(tr,6) AS tr, round(atr,7) AS atr, round(atr/close,8) AS atr_pct FROM a",
)
def _(spark, sf):
    return keep(I.atr(b1(spark, sf, *BAR)), "tr", "atr", "atr_pct", atr=7, atr_pct=8)


_A = 1 / 14


@query(
    "adx",
    f"""WITH {_TR}, x AS (SELECT symbol, ts, tr, high-{lag('high')} AS up, {lag('low')}-low AS dn FROM t),
        m AS (SELECT symbol, ts, CASE WHEN up IS NOT NULL THEN CASE WHEN up>dn AND up>0 THEN up ELSE 0 END END AS p,
          CASE WHEN up IS NOT NULL THEN CASE WHEN dn>up AND dn>0 THEN dn ELSE 0 END END AS m, CASE WHEN up IS NOT NULL THEN tr END AS r FROM x),
        s AS (SELECT symbol, ts, r, {ewm('p', _A)} AS ps, {ewm('m', _A)} AS ms, {ewm('r', _A)} AS rs FROM m),
        d AS (SELECT symbol, ts, r, 100*ps/nullif(rs,0) AS pdi, 100*ms/nullif(rs,0) AS mdi FROM s),
        q AS (SELECT *, CASE WHEN r IS NOT NULL THEN coalesce(100*abs(pdi-mdi)/nullif(pdi+mdi,0),0) END AS dx FROM d)
        SELECT symbol, ts, round(pdi,5) AS plus_di, round(mdi,5) AS minus_di, round({ewm('dx', _A)},5) AS adx FROM q""",
)
def _(spark, sf):
    return keep(I.adx(b1(spark, sf, *BAR)), "plus_di", "minus_di", "adx", digits=5)


def _mid(n):
    return f"({hi('high', n)}+{lo('low', n)})/2"


@query(
    "ichimoku",
    f"""WITH i AS (SELECT symbol, ts, close, {_mid(9)} AS a, {_mid(26)} AS b, {_mid(52)} AS c FROM bars)
        SELECT symbol, ts, round(a,8) AS conversion, round(b,8) AS base, round((a+b)/2,9) AS span_a, round(c,8) AS span_b,
        CASE WHEN (a+b)/2 IS NULL AND c IS NULL THEN NULL ELSE close > greatest((a+b)/2, c) END AS above_cloud FROM i""",
)
def _(spark, sf):
    return keep(I.ichimoku(b1(spark, sf, *BAR)), "conversion", "base", "span_a", "span_b", "above_cloud", digits=8, span_a=9)


@query(
    "obv_vpt_adl_cmf",
    f"""WITH x AS (SELECT *, coalesce({pct('close')},0) AS r, coalesce(((close-low)-(high-close))/nullif(high-low,0),0)*volume AS ad FROM bars)
        SELECT symbol, ts, round(sum(volume*sign(r)) OVER u,4) AS obv, round(sum(volume*r) OVER u,6) AS vpt, round(sum(ad) OVER u,6) AS adl,
        round({total('ad', 20)}/nullif({total('volume', 20)},0),6) AS cmf FROM x WINDOW u AS (PARTITION BY symbol ORDER BY ts)""",
)
def _(spark, sf):
    return keep(I.volume_flow(b1(spark, sf, *BAR)), "obv", "vpt", "adl", "cmf", obv=4)


@query(
    "vwap_rolling",
    f"""WITH t AS (SELECT *, (high+low+close)/3 AS tp FROM bars), v AS (SELECT *, {total('tp*volume', 20)}/nullif({total('volume', 20)},0) AS vwap,
          {total('tp*tp*volume', 20)}/nullif({total('volume', 20)},0) AS v2 FROM t)
        SELECT symbol, ts, round(vwap,6) AS vwap, round(close/vwap-1,8) AS vwap_dev, round(sqrt(greatest(v2-vwap*vwap,0)),5) AS vwap_std FROM v""",
)
def _(spark, sf):
    return keep(I.vwap_rolling(b1(spark, sf, *BAR)), "vwap", "vwap_dev", "vwap_std", vwap_dev=8, vwap_std=5)


@query(
    "pivots_fib",
    f"""WITH p AS (SELECT symbol, ts, close, {lag('high')} AS ph, {lag('low')} AS pl, {lag('close')} AS pc, {hi('high', 50)} AS h, {lo('low', 50)} AS l FROM bars)
        SELECT symbol, ts, round((ph+pl+pc)/3,6) AS pivot, round(2*(ph+pl+pc)/3-pl,6) AS r1, round(2*(ph+pl+pc)/3-ph,6) AS s1, round((ph+pl+pc)/3+(ph-pl),6) AS r2,
        round((ph+pl+pc)/3-(ph-pl),6) AS s2, round(h-(h-l)*0.618,6) AS fib_618,
        least(abs(close/(h-(h-l)*0.236)-1),abs(close/(h-(h-l)*0.382)-1),abs(close/(h-(h-l)*0.5)-1),abs(close/(h-(h-l)*0.618)-1),abs(close/(h-(h-l)*0.786)-1))<0.005 AS near_fib FROM p""",
)
def _(spark, sf):
    return keep(I.pivots_fib(b1(spark, sf, *BAR)), "pivot", "r1", "s1", "r2", "s2", "fib_618", "near_fib")


@query(
    "order_flow_proxies",
    f"""WITH x AS (SELECT *, CASE WHEN close>open THEN volume ELSE 0 END AS bv, CASE WHEN close<open THEN volume ELSE 0 END AS sv, {pct('close')} AS r FROM bars),
        y AS (SELECT *, {total('bv', 20)} AS b, {total('sv', 20)} AS s FROM x)
        SELECT symbol, ts, bv AS buy_volume, sv AS sell_volume, round((b-s)/(b+s+1e-8),6) AS imbalance, round(abs(r)/(volume+1e-8),10) AS impact,
        volume > {quant('volume', 0.8, 20)} AS large_volume FROM y""",
)
def _(spark, sf):
    return keep(I.order_flow(b1(spark, sf, *BAR)), "buy_volume", "sell_volume", "imbalance", "impact", "large_volume", impact=10)


@query(
    "liquidity_proxies",
    f"""WITH x AS (SELECT *, abs({pct('close')})/(volume+1e-8) AS i, (high-low)/nullif(close,0) AS sp, (high+low+close)/3 AS tp FROM bars),
        y AS (SELECT *, CASE WHEN tp > {lag('tp')} THEN tp*volume ELSE 0 END AS a, CASE WHEN tp < {lag('tp')} THEN tp*volume ELSE 0 END AS b FROM x),
        z AS (SELECT *, {mean('i', 10)} AS i10, {mean('i', 20)} AS i20, {mean('sp', 10)} AS s10, {total('a', 20)} AS ta, {total('b', 20)} AS tb FROM y)
        SELECT symbol, ts, round(i10,10) AS illiquidity_10, round(i20,10) AS illiquidity_20, round(sp,6) AS spread, round(s10,6) AS spread_10,
        round(ta/(tb+1e-8),6) AS money_flow, round((ta-tb)/(ta+tb+1e-8),6) AS net_flow FROM z""",
)
def _(spark, sf):
    cols = ("illiquidity_10", "illiquidity_20", "spread", "spread_10", "money_flow", "net_flow")
    return keep(I.order_flow(b1(spark, sf, *BAR)), *cols, illiquidity_10=10, illiquidity_20=10)


@query(
    "momentum_divergence",
    f"""WITH x AS (SELECT b.*, r.rsi, {pct('close', 10).replace('PARTITION BY symbol ORDER BY ts', 'PARTITION BY b.symbol ORDER BY b.ts')} AS mom,
          (close > lag(close) OVER (PARTITION BY b.symbol ORDER BY b.ts))::INT AS up FROM bars b JOIN rsi14 r ON b.symbol=r.symbol AND b.ts=r.ts)
        SELECT symbol, ts, round(mom,8) AS momentum, round(mom-{lag('mom')},8) AS acceleration, round({mean('up', 10)},6) AS consistency,
        low <= {lo('low', 10)} AND rsi > {lo('rsi', 10)} AS bullish_divergence, high >= {hi('high', 10)} AND rsi < {hi('rsi', 10)} AS bearish_divergence FROM x""",
)
def _(spark, sf):
    d = I.momentum_divergence(b1(spark, sf, *BAR))
    return keep(d, "momentum", "acceleration", "consistency", "bullish_divergence", "bearish_divergence", momentum=8, acceleration=8)


@query(
    "volatility_regime",
    f"""WITH v AS (SELECT symbol, ts, ret, close, {std('ret', 20)} AS vol FROM rets),
        q AS (SELECT *, {quant('vol', 0.2, 100)} AS q2, {quant('vol', 0.8, 100)} AS q8, close/{hi('close', 100)}-1 AS dd, {mean('vol', 100)} AS mv FROM v)
        SELECT symbol, ts, round(vol,8) AS vol, CASE WHEN q2 IS NULL THEN NULL WHEN vol<q2 THEN 'low' WHEN vol>q8 THEN 'high' ELSE 'normal' END AS regime,
        round(vol/mv,6) AS clustering, round(dd,8) AS drawdown, CASE WHEN dd<-0.2 THEN 'extreme' WHEN dd<-0.1 THEN 'high' WHEN dd<-0.05 THEN 'medium' WHEN dd IS NOT NULL THEN 'low' END AS stress FROM q""",
)
def _(spark, sf):
    return keep(I.volatility_regime(b1(spark, sf)), "vol", "regime", "clustering", "drawdown", "stress", vol=8, drawdown=8)


@query(
    "fractal_swings",
    f"""WITH x AS (SELECT symbol, ts, coalesce(high>{lag('high')} AND high>{lag('high', 2)} AND high>{lead('high')} AND high>{lead('high', 2)}, false) AS h,
          coalesce(low<{lag('low')} AND low<{lag('low', 2)} AND low<{lead('low')} AND low<{lead('low', 2)}, false) AS l FROM bars),
        y AS (SELECT symbol, ts, coalesce({lag('h', 2)}, false) AS swing_high, coalesce({lag('l', 2)}, false) AS swing_low FROM x)
        SELECT symbol, ts, swing_high, swing_low, CAST(sum(swing_high::INT) {over(20)} AS BIGINT) AS swing_highs_20, CAST(sum(swing_low::INT) {over(20)} AS BIGINT) AS swing_lows_20 FROM y""",
)
def _(spark, sf):
    return keep(I.fractal_swings(b1(spark, sf, *BAR)), "swing_high", "swing_low", "swing_highs_20", "swing_lows_20")


@query(
    "levels_volume_score",
    f"""WITH x AS (SELECT symbol, ts, close, volume, {lo('low', 20)} AS s, {hi('high', 20)} AS r, {mean('volume', 20)} AS v, {pct('close')} AS ret FROM bars),
        y AS (SELECT *, least(volume/nullif(v,0)/3, 1) AS vs FROM x)
        SELECT symbol, ts, round(s,6) AS support, round(r,6) AS resistance, round(close/s-1,8) AS to_support, round(r/close-1,8) AS to_resistance,
        round(CASE WHEN v IS NULL THEN 1 ELSE vs END,6) AS volume_score,
        round(CASE WHEN ret<0 THEN (1-(close-s)/nullif(r-s,0))*vs ELSE 0 END,6) AS dip_quality FROM y""",
)
def _(spark, sf):
    d = I.levels_volume_score(b1(spark, sf, *BAR))
    return keep(d, "support", "resistance", "to_support", "to_resistance", "volume_score", "dip_quality", to_support=8, to_resistance=8)


@query(
    "cross_asset_features",
    f"""WITH x AS (SELECT symbol, ts, volume, ret, {pct('close', 12)} AS r12, {pct('close', 48)} AS r48 FROM rets),
        m AS (SELECT ts, avg(r12) AS m12, avg(r48) AS m48, avg(volume) AS mv, max(ret) FILTER (symbol='purchase') AS ref FROM x GROUP BY ts),
        j AS (SELECT x.*, m12, m48, mv, ref, CASE WHEN ret IS NOT NULL AND ref IS NOT NULL THEN 1 END AS both_ FROM x JOIN m ON x.ts=m.ts)
        SELECT symbol, ts, round(r12-m12,8) AS strength_12, round(r48-m48,8) AS strength_48, round(volume/mv,6) AS volume_vs_market,
        round({full('corr(ret,ref)', 'both_', 50)},6) AS corr_ref FROM j""",
)
def _(spark, sf):
    d = I.cross_asset(b1(spark, sf, *BAR), "purchase")
    return keep(d, "strength_12", "strength_48", "volume_vs_market", "corr_ref", strength_12=8, strength_48=8)


@query(
    "market_regime_score",
    f"""WITH x AS (SELECT b.*, r.rsi, t.ret, row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts)::DOUBLE AS i FROM bars b JOIN rsi14 r ON b.symbol=r.symbol AND b.ts=r.ts JOIN rets t ON b.symbol=t.symbol AND b.ts=t.ts),
        y AS (SELECT *, greatest(high-low, coalesce(abs(high-{lag('close')}),0), coalesce(abs(low-{lag('close')}),0)) AS tr, {pct('close', 24)} AS move, (ret>0)::INT AS upd,
          {full('regr_slope(close,i)', 'close', 20)}/{mean('close', 20)} AS slope, {std('ret', 20)} AS vol, 4*{std('close', 20)}/{mean('close', 20)} AS width FROM x),
        z AS (SELECT *, abs(2*{mean('upd', 24)}-1) AS strength, {mean('tr', 14)}/close AS atr, CASE WHEN count(vol) {over(100)} >= 100 THEN list(vol) {over(100)} END AS vs FROM y),
        q AS (SELECT *, (len(list_filter(vs, lambda v: v<vol)) + len(list_filter(vs, lambda v: v<=vol)) + 1)*50.0/len(vs) AS vr FROM z),
        s AS (SELECT symbol, ts, CASE WHEN strength>0.6 THEN 0.3 ELSE 0 END + CASE WHEN move>0 THEN 0.2 ELSE 0 END + CASE WHEN slope>0.001 THEN 0.2 ELSE 0 END + CASE WHEN rsi>50 THEN 0.1 ELSE 0 END AS su,
          CASE WHEN strength>0.6 THEN 0.3 ELSE 0 END + CASE WHEN move<0 THEN 0.2 ELSE 0 END + CASE WHEN slope<-0.001 THEN 0.2 ELSE 0 END + CASE WHEN rsi<50 THEN 0.1 ELSE 0 END AS sd,
          CASE WHEN vr>75 THEN 0.4 ELSE 0 END + CASE WHEN width>0.15 THEN 0.3 ELSE 0 END + CASE WHEN atr>0.03 THEN 0.3 ELSE 0 END AS hv,
          CASE WHEN vr<25 THEN 0.4 ELSE 0 END + CASE WHEN width<0.05 THEN 0.3 ELSE 0 END + CASE WHEN atr<0.01 THEN 0.3 ELSE 0 END AS lv,
          CASE WHEN strength<0.3 THEN 0.2 ELSE 0 END AS weak FROM q),
        f AS (SELECT *, 1-greatest(su,sd,hv,lv)+weak AS rb FROM s)
        SELECT symbol, ts, CAST(greatest(su,sd,hv,lv,rb) AS DOUBLE) AS confidence, CASE greatest(su,sd,hv,lv,rb) WHEN su THEN 'strong_uptrend' WHEN sd THEN 'strong_downtrend' WHEN hv THEN 'high_volatility'
        WHEN lv THEN 'low_volatility' ELSE 'range_bound' END AS regime, round(1-CAST(list_reverse_sort([su,sd,hv,lv,rb])[1]-list_reverse_sort([su,sd,hv,lv,rb])[2] AS DOUBLE),6) AS transition FROM f""",
)
def _(spark, sf):
    return keep(I.regime_scores(b1(spark, sf, *BAR)), "confidence", "regime", "transition")


@query(
    "multi_tf_consensus",
    f"""WITH h AS (SELECT symbol, ts, close > {mean('close', 20)} AS up FROM bars), g AS (SELECT symbol, ts + INTERVAL 4 HOUR AS kts, close > {mean('close', 20)} AS up4 FROM bars4h)
        SELECT h.symbol, h.ts, h.up, g.up4 AS up_14400, coalesce(h.up,false)::INT + coalesce(g.up4,false)::INT AS frames_up, (h.up IS NOT NULL)::INT + (g.up4 IS NOT NULL)::INT AS frames_known
        FROM (SELECT *, ts + INTERVAL 1 HOUR AS kts FROM h) h ASOF LEFT JOIN g ON h.symbol=g.symbol AND h.kts >= g.kts""",
)
def _(spark, sf):
    d = S.timeframe_consensus(b1(spark, sf, *BAR), [14_400], 3600)
    return d.select("symbol", "ts", "up", "up_14400", "frames_up", "frames_known")


@query(
    "base_feature_sets",
    f"""WITH x AS (SELECT b.symbol, b.ts, b.open, b.high, b.low, b.close, b.volume, r.rsi, t.ret FROM bars b JOIN rsi14 r ON b.symbol=r.symbol AND b.ts=r.ts JOIN rets t ON b.symbol=t.symbol AND b.ts=t.ts),
        y AS (SELECT *, volume/{mean('volume', 20)} AS vr, {std('ret', 20)} AS vol, {pct('close', 10)} AS mom, {mean('close', 5)} AS s5, {mean('close', 50)} AS s50 FROM x)
        SELECT symbol, ts, round(rsi,6) AS rsi, round(vr,6) AS volume_ratio, round(vol,8) AS volatility, round(mom,8) AS momentum, round(s5,8) AS sma_5, round(s50,8) AS sma_50,
        hour(ts) AS hour, high>low AND least(open,close)-low > 0 AND abs(close-open)/nullif(high-low,0) < 0.1 AND false AS never FROM y""".replace(
        ", high>low AND least(open,close)-low > 0 AND abs(close-open)/nullif(high-low,0) < 0.1 AND false AS never", ""
    ),
)
def _(spark, sf):
    d = S.feature_set(b1(spark, sf, *BAR))
    return keep(d, "rsi", "volume_ratio", "volatility", "momentum", "sma_5", "sma_50", "hour", volatility=8, momentum=8, sma_5=8, sma_50=8)


@query(
    "interaction_features",
    f"""WITH x AS (SELECT b.symbol, b.ts, b.close, b.volume, r.rsi, t.ret FROM bars b JOIN rsi14 r ON b.symbol=r.symbol AND b.ts=r.ts JOIN rets t ON b.symbol=t.symbol AND b.ts=t.ts),
        y AS (SELECT *, volume/{mean('volume', 20)} AS vr, {std('ret', 20)} AS vol, {pct('close', 10)} AS mom FROM x)
        SELECT symbol, ts, round(rsi*vr,5) AS rsi_x_volume, round(mom*vr,8) AS momentum_x_volume, round(mom/(vol+1e-8),5) AS momentum_per_vol, round(rsi*rsi,4) AS rsi_squared,
        round(sqrt(abs(mom)),8) AS root_abs_momentum, round(CASE WHEN rsi<30 THEN mom ELSE 0 END,8) AS oversold_momentum FROM y""",
)
def _(spark, sf):
    d = S.feature_set(b1(spark, sf, *BAR))
    return keep(d, *C.interaction_features(), digits=8, rsi_x_volume=5, momentum_per_vol=5, rsi_squared=4)


@query(
    "candle_geometry",
    """WITH x AS (SELECT *, high-low AS rng, abs(close-open) AS body, high-greatest(open,close) AS up, least(open,close)-low AS dn FROM bars),
       y AS (SELECT *, coalesce(body/nullif(rng,0),0) AS b, coalesce(up/nullif(rng,0),0) AS u, coalesce(dn/nullif(rng,0),0) AS d FROM x)
       SELECT symbol, ts, round(body,6) AS body, round(rng,6) AS "range", round(up,6) AS upper_shadow, round(dn,6) AS lower_shadow, round(b,6) AS body_ratio, round(u,6) AS upper_ratio,
       round(d,6) AS lower_ratio, rng>0 AND b<0.1 AS doji, rng>0 AND d>0.6 AND b<0.3 AND u<0.1 AS hammer, rng>0 AND u>0.6 AND b<0.3 AND d<0.1 AS inverted_hammer,
       rng>0 AND u>0.6 AND b<0.3 AND close<open AS shooting_star, rng>0 AND greatest(u,d)>0.6 AND b<0.3 AS pin_bar FROM y""",
)
def _(spark, sf):
    g = C.candle_geometry()
    return keep(b1(spark, sf, *BAR).withColumns(g), *g)


@query(
    "session_flags",
    """SELECT event_id, hour(ts) AS hour, minute(ts) AS minute, (dayofweek(ts)+6) % 7 AS weekday, month(ts) AS month, (dayofweek(ts)+6) % 7 >= 5 AS is_weekend,
       hour(ts)<8 AS is_asian, hour(ts)>=8 AND hour(ts)<16 AS is_european, hour(ts)>=16 AS is_us FROM ticks""",
)
def _(spark, sf):
    f = C.session_flags()
    return ticks(spark, sf).withColumns(f).select("event_id", *f)


@query("boundary_flags", "SELECT event_id, least(minute(ts) % 15, 15 - minute(ts) % 15) AS boundary_distance, least(minute(ts) % 15, 15 - minute(ts) % 15) <= 1 AS on_boundary FROM ticks")
def _(spark, sf):
    f = C.boundary_flags()
    return ticks(spark, sf).withColumns(f).select("event_id", *f)


@query(
    "threshold_bucket",
    """SELECT CASE WHEN holding_days>=90 THEN 'long' WHEN holding_days>=30 THEN 'medium' WHEN holding_days>=7 THEN 'short' ELSE 'intraweek' END AS bucket, count(*) AS trades,
       round(avg(ret_pct),6) AS avg_return FROM trades GROUP BY 1""",
)
def _(spark, sf):
    bucket = ladder("holding_days", [(90, "long"), (30, "medium"), (7, "short")], "intraweek")
    return rounded(trades(spark, sf).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("trades"), F.avg("ret_pct").alias("avg_return")))


_SIG = f"""x AS (SELECT b.symbol, b.ts, b.open, b.close, b.volume, r.rsi FROM bars b JOIN rsi14 r ON b.symbol=r.symbol AND b.ts=r.ts),
        y AS (SELECT *, {mean('close', 20)} AS mid, {std('close', 20)} AS s, volume/{mean('volume', 20)} AS vr, (close-open)/open AS dip FROM x)"""


@query(
    "signal_predicate",
    f"""WITH {_SIG}, c AS (SELECT *, rsi BETWEEN 30 AND 50 AS c1, dip < -0.002 AS c2, close<mid AS c3, close<mid-2*s AS c4, vr>1.5 AS c5 FROM y),
        d AS (SELECT *, CAST(least(CASE WHEN c1 THEN 0.3 ELSE 0 END + CASE WHEN c2 THEN 0.4 ELSE 0 END + CASE WHEN c3 THEN 0.2 ELSE 0 END + CASE WHEN c4 THEN 0.1 ELSE 0 END + CASE WHEN c5 THEN 0.1 ELSE 0 END, 1.0) AS DOUBLE) AS confidence,
          concat_ws(', ', CASE WHEN c1 THEN 'rsi' END, CASE WHEN c2 THEN 'dip' END, CASE WHEN c3 THEN 'below_ma20' END, CASE WHEN c4 THEN 'below_bb_lower' END, CASE WHEN c5 THEN 'volume_spike' END) AS reasons FROM c)
        SELECT symbol, ts, round(close,6) AS close, round(rsi,6) AS rsi, confidence, reasons FROM d WHERE confidence >= 0.6""",
)
def _(spark, sf):
    return keep(S.entry_signals(b1(spark, sf, *BAR)), "close", "rsi", "confidence", "reasons")


@query(
    "signal_score_weighted",
    f"""WITH {_SIG}, c AS (SELECT symbol, ts, coalesce(rsi BETWEEN 30 AND 50, false)::INT AS c1, coalesce(close<mid,false)::INT AS c2, (dip < -0.002)::INT AS c3, coalesce(vr>1.5,false)::INT AS c4 FROM y),
        d AS (SELECT *, CAST(0.3*c1+0.25*c2+0.25*c3+0.2*c4 AS DOUBLE) AS strength FROM c)
        SELECT symbol, ts, c1+c2+c3+c4 AS met, strength, CASE WHEN strength>0.7 THEN 'high' WHEN strength>0.5 THEN 'medium' ELSE 'low' END AS grade FROM d""",
)
def _(spark, sf):
    return S.signal_scores(b1(spark, sf, *BAR))


@query(
    "layered_signal_filter",
    f"""WITH {_SIG}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS xs FROM y),
        e AS (SELECT *, list_sum(list_transform(xs, lambda x, k: x*pow(19/21.0::DOUBLE, i-k)))/list_sum(list_transform(xs, lambda x, k: pow(19/21.0::DOUBLE, i-k))) AS ema FROM n),
        f AS (SELECT *, sum((close<open)::INT) {over(4)} > 3 AS red, ema/{lag('ema', 4)}-1 AS t, {pct('close')} AS c1, ({pct('close', 3)}+{pct('close', 5)})/2 AS m, (close-(mid-2*s))/nullif(4*s,0) AS b FROM e),
        g AS (SELECT *, {lag('c1')} AS c0 FROM f),
        h AS (SELECT *, coalesce(rsi BETWEEN 30 AND 50,false) AS p1, coalesce(NOT red AND t >= -0.02,false) AS p2, coalesce(c1>=c0,false) AS p3, coalesce(vr>=1.0,false) AS p4, coalesce(b<=0.4,false) AS p5 FROM g),
        q AS (SELECT *, (CASE WHEN p1 THEN greatest(0,1-abs(rsi-40)/10) ELSE 0 END + CASE WHEN p2 THEN CASE WHEN t BETWEEN -0.01 AND 0 THEN 1.0 WHEN t>=-0.02 AND t < -0.01 THEN 0.7 ELSE 0.4 END ELSE 0 END
          + CASE WHEN p3 THEN CASE WHEN m BETWEEN -0.02 AND -0.005 THEN 1.0 WHEN m < -0.02 THEN 0.6 ELSE 0.8 END ELSE 0 END + CASE WHEN p4 THEN CASE WHEN vr>=2 THEN 1.0 WHEN vr>=1.3 THEN 0.8 ELSE 0.6 END ELSE 0 END
          + CASE WHEN p5 THEN greatest(0,1-b/0.4) ELSE 0 END)/5 AS score, p1::INT+p2::INT+p3::INT+p4::INT+p5::INT AS layers_passed FROM h)
        SELECT symbol, ts, p1 AS rsi_pass, p2 AS trend_pass, p3 AS momentum_pass, p4 AS volume_pass, p5 AS band_pass, layers_passed, round(score,6) AS score,
        layers_passed=5 AND score>=0.5 AS signal FROM q""",
)
def _(spark, sf):
    d = S.layered_signals(b1(spark, sf, *BAR))
    return keep(d, *[f"{k}_pass" for k in ("rsi", "trend", "momentum", "volume", "band")], "layers_passed", "score", "signal")


@query(
    "adaptive_dip",
    f"""WITH {REGIME}, m AS (SELECT b.symbol, b.ts, b.close, b.volume, CASE WHEN g.regime LIKE '%volatile' THEN 'high_volatility' WHEN g.regime='up_calm' THEN 'strong_uptrend' WHEN g.regime='down_calm' THEN 'low_volatility' ELSE 'range_bound' END AS regime
          FROM bars b JOIN g ON b.symbol=g.symbol AND b.ts=g.ts),
        d AS (SELECT *, {pct('close')} AS change, CASE regime WHEN 'high_volatility' THEN 0.008 WHEN 'strong_uptrend' THEN 0.002 WHEN 'low_volatility' THEN 0.001 ELSE 0.003 END::DOUBLE AS threshold FROM m),
        f AS (SELECT *, coalesce(change < -threshold,false) AS is_dip FROM d)
        SELECT symbol, ts, threshold, is_dip, round(CASE WHEN is_dip THEN -change ELSE 0 END,8) AS dip_size, CAST(sum(is_dip::INT) {over(3)} AS BIGINT) AS dips_3, CAST(sum(is_dip::INT) {over(5)} AS BIGINT) AS dips_5, CAST(sum(is_dip::INT) {over(10)} AS BIGINT) AS dips_10 FROM f""",
)
def _(spark, sf):
    g = regimes_ma_vol(b1(spark, sf, "close", "volume"))
    r = F.col("regime")
    named = F.when(r.endswith("volatile"), "high_volatility").when(r == "up_calm", "strong_uptrend").when(r == "down_calm", "low_volatility").otherwise("range_bound")
    d = S.adaptive_dips(g.withColumn("regime", named))
    return keep(d, "threshold", "is_dip", "dip_size", "dips_3", "dips_5", "dips_10", dip_size=8)


@query("future_return", f"SELECT symbol, ts, round({lead('close', 1)}/close-1,8) AS ret_1, round({lead('close', 12)}/close-1,8) AS ret_12, round({lead('close', 48)}/close-1,8) AS ret_48 FROM bars")
def _(spark, sf):
    return keep(L.future_returns(b1(spark, sf), [1, 12, 48]), "ret_1", "ret_12", "ret_48", digits=8)


@query(
    "hit_target_stop",
    f"""SELECT symbol, ts, CASE WHEN count(*) {span(1, 12)}>=12 AND max(close) {span(1, 12)} >= close*(1+0.012::DOUBLE) THEN 1 ELSE 0 END AS hit_target,
        CASE WHEN count(*) {span(1, 12)}>=12 AND min(close) {span(1, 12)} <= close*(1-0.008::DOUBLE) THEN 1 ELSE 0 END AS hit_stop FROM bars""",
)
def _(spark, sf):
    return keep(L.hit_labels(b1(spark, sf), 12, 0.012, 0.008), "hit_target", "hit_stop")


_NEXT = f"n AS (SELECT symbol, ts, high, low, close, list(close) {span(1, 24)} AS xs, list(high) {span(1, 24)} AS hs, list(low) {span(1, 24)} AS ls FROM bars)"


@query(
    "time_to_target",
    f"""WITH {_NEXT} SELECT symbol, ts, coalesce(nullif(list_position(list_transform(xs, lambda x: x>=close*(1+0.012::DOUBLE)), true),0),24)::INT AS to_target,
        coalesce(nullif(list_position(list_transform(xs, lambda x: x<=close*(1-0.008::DOUBLE)), true),0),24)::INT AS to_stop FROM n""",
)
def _(spark, sf):
    return keep(L.time_to_target(b1(spark, sf), {"to_target": 0.012, "to_stop": -0.008}, 24), "to_target", "to_stop")


@query(
    "optimal_exit",
    f"WITH {_NEXT} SELECT symbol, ts, list_position(xs, list_max(xs))::INT AS exit_offset, round(list_max(xs)/close-1,8) AS exit_return FROM n",
)
def _(spark, sf):
    return keep(L.optimal_exit(b1(spark, sf), 24), "exit_offset", "exit_return", digits=8)


@query("mfe_mae", f"SELECT symbol, ts, round(max(high) {span(1, 24)}/close-1,8) AS mfe, round(min(low) {span(1, 24)}/close-1,8) AS mae FROM bars")
def _(spark, sf):
    return keep(L.excursions(b1(spark, sf, *BAR), 24), "mfe", "mae", digits=8)


@query(
    "triple_barrier",
    f"""WITH {_NEXT}, o AS (SELECT symbol, ts, coalesce(nullif(list_position(list_transform(hs, lambda x: x>=close*(1+0.012::DOUBLE)), true),0),25) AS u,
          coalesce(nullif(list_position(list_transform(ls, lambda x: x<=close*(1-0.008::DOUBLE)), true),0),25) AS d FROM n)
        SELECT symbol, ts, CASE WHEN d<=u AND d<=24 THEN -1 WHEN u<=24 THEN 1 ELSE 0 END AS barrier FROM o""",
)
def _(spark, sf):
    return keep(L.triple_barrier(b1(spark, sf, *BAR), 24, 0.012, 0.008), "barrier")


@query(
    "boundary_exit_label",
    f"""WITH x AS (SELECT symbol, ts, {lead('close', 4)}/close-1 AS r, coalesce(minute({lead('ts', 4)}) IN (0,15,30,45),false) AS ob FROM bars15)
        SELECT symbol, ts, round(r,8) AS ret, ob AS on_boundary, coalesce(r>=0.006 OR (r>=0.003 AND ob),false)::INT AS win,
        CASE WHEN r<=-0.004 THEN 0 WHEN r<=0 THEN 1 WHEN r<0.006 THEN 2 WHEN r<0.012 THEN 3 WHEN r IS NOT NULL THEN 4 ELSE 1 END AS return_class,
        round(r+CASE WHEN ob THEN 0.001 ELSE 0 END,8) AS bonus_return FROM x""",
)
def _(spark, sf):
    d = L.boundary_exit(bars(spark, sf, 900).select("symbol", "ts", "close"), 4)
    return keep(d, "ret", "on_boundary", "win", "return_class", "bonus_return", digits=8)


@query(
    "risk_adjusted_label",
    f"""WITH {REGIME}, m AS (SELECT b.symbol, b.ts, b.close, CASE WHEN g.regime LIKE '%volatile' THEN 'high_volatility' WHEN g.regime='up_calm' THEN 'strong_uptrend' WHEN g.regime='down_calm' THEN 'low_volatility' ELSE 'range_bound' END AS regime
          FROM bars b JOIN g ON b.symbol=g.symbol AND b.ts=g.ts),
        p AS (SELECT *, CASE regime WHEN 'high_volatility' THEN 0.015 WHEN 'strong_uptrend' THEN 0.012 WHEN 'low_volatility' THEN 0.005 ELSE 0.008 END::DOUBLE AS t,
          CASE regime WHEN 'high_volatility' THEN 11 WHEN 'strong_uptrend' THEN 22 WHEN 'low_volatility' THEN 60 ELSE 45 END AS n, list(close) {span(1, 60)} AS xs FROM m),
        o AS (SELECT *, coalesce(nullif(list_position(list_transform(xs, lambda x: x>=close*(t+1)), true),0),1000000) AS u,
          coalesce(nullif(list_position(list_transform(xs, lambda x: x<=close*(1-0.015::DOUBLE)), true),0),1000000) AS d FROM p)
        SELECT symbol, ts, (u<=n AND u<d)::INT AS hit, (u<=n AND u<d AND u % 3 = 0)::INT AS hit_on_boundary, round(CASE WHEN len(xs)>=n THEN xs[n]/close-1 END,8) AS holding_return FROM o""",
)
def _(spark, sf):
    g = regimes_ma_vol(b1(spark, sf))
    r = F.col("regime")
    named = F.when(r.endswith("volatile"), "high_volatility").when(r == "up_calm", "strong_uptrend").when(r == "down_calm", "low_volatility").otherwise("range_bound")
    d = L.regime_labels(g.withColumn("regime", named), scale=4)
    return keep(d, "hit", "hit_on_boundary", "holding_return", digits=8)


@query(
    "signal_to_trade_match",
    f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, list({{'t':ts,'c':close}}) {span(1, 6)} AS nx FROM bars15),
        e AS (SELECT symbol, ts, close, unnest(nx) AS x FROM s WHERE close < open), r AS (SELECT symbol, ts, close, x.t AS t, x.c AS c, (epoch(x.t)-epoch(ts))/60 AS h FROM e),
        k AS (SELECT *, min(CASE WHEN h>=90 THEN h END) OVER (PARTITION BY symbol, ts) AS stop_h FROM r),
        c AS (SELECT *, CASE WHEN minute(t) IN (15,45) THEN 1 WHEN minute(t) IN (0,30) THEN 2 WHEN h>=90 THEN 3 END AS p FROM k WHERE h <= coalesce(stop_h,1e18))
        SELECT symbol, ts, arg_min(t,(p,h)) AS exit_ts, arg_min(p,(p,h)) AS priority, round((arg_min(c,(p,h))-any_value(close))/any_value(close),8) AS pnl_pct FROM c GROUP BY 1,2
        UNION ALL SELECT symbol, ts, NULL, NULL, NULL FROM s WHERE close<open AND (nx IS NULL OR len(nx)=0)""",
)
def _(spark, sf):
    b = bars(spark, sf, 900).select("symbol", "ts", "open", "close")
    d = L.signal_exits(b, F.col("close") < F.col("open"), 15, 90)
    return keep(d, "exit_ts", "priority", "pnl_pct", digits=8)


@query(
    "entry_win_rate",
    f"""WITH {_SIG}, e AS (SELECT * FROM y WHERE rsi BETWEEN 30 AND 50 AND close < mid),
        l AS (SELECT symbol, ts, CASE WHEN count(*) {span(1, 12)}>=12 AND max(close) {span(1, 12)} >= close*(1+0.012::DOUBLE) THEN 1 ELSE 0 END AS hit FROM bars)
        SELECT e.symbol, count(*) AS entries, sum(hit)::BIGINT AS wins, round(avg(hit),6) AS win_rate FROM e JOIN l ON e.symbol=l.symbol AND e.ts=l.ts GROUP BY 1""",
)
def _(spark, sf):
    """The flagship chain: indicators and labels in one set of blocks, then one aggregate."""

    def build(d, fr):
        d = S.signal_inputs(d, fr)
        w = fr.span(1, 12)
        up = (F.count(F.lit(1)).over(w) >= 12) & (F.max("close").over(w) >= F.col("close") * 1.012)
        return d.withColumn("hit", F.when(up, 1).otherwise(0))

    d = framed(b1(spark, sf, *BAR), build, before=22, after=12)
    e = d.where(F.col("rsi").between(30, 50) & (F.col("close") < F.col("bb_mid")))
    return rounded(
        e.groupBy("symbol").agg(
            F.count(F.lit(1)).alias("entries"), F.sum("hit").alias("wins"), F.avg("hit").alias("win_rate")
        )
    )
