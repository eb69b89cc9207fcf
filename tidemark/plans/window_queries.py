"""Window operators on hourly bars and intraday trades."""

from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.operators import rolling as W
from tidemark.operators.frames import CHUNK, framed
from tidemark.operators.scans import Mean, exponential_means
from tidemark.operators.joins import with_market_returns
from tidemark.operators.series import with_returns
from tidemark.plans.registry import query
from tidemark.plans.report_queries import rounded
from tidemark.plans.sqltext import ewm, full, hi, lag, lead, lo, mean, over, pct, quant, span, std, total
from tidemark.sources.standins import bars, round_trips

TS_ID = ("ts", "trade_id")


def b1(spark, sf, *cols):
    return bars(spark, sf).select("symbol", "ts", *(cols or ("close",)))


@query(
    "rolling_mean_std",
    f"""SELECT symbol, ts, round({mean('close', 20)},8) AS mean, round({std('close', 20)},8) AS std, round({total('close', 20)},6) AS total,
        round({lo('close', 20)},6) AS low, round({hi('close', 20)},6) AS high FROM bars""",
)
def _(spark, sf):
    return rounded(W.rolling_basic(b1(spark, sf), "close", 20).drop("close"), mean=8, std=8)


@query(
    "rolling_quantile",
    f"SELECT symbol, ts, round({quant('close', 0.2, 50)},8) AS q20, round({quant('close', 0.8, 50)},8) AS q80 FROM bars",
)
def _(spark, sf):
    return rounded(W.rolling_quantiles(b1(spark, sf), "close", 50, {"q20": 0.2, "q80": 0.8}).drop("close"), 8)


@query(
    "rolling_corr_cov_beta",
    f"""WITH m AS (SELECT ts, avg(ret) AS mkt FROM rets GROUP BY ts), d AS (SELECT r.symbol, r.ts, r.ret, m.mkt FROM rets r JOIN m ON r.ts=m.ts)
        SELECT symbol, ts, round({full('corr(ret,mkt)', 'ret', 50)},6) AS corr, round({full('covar_samp(ret,mkt)', 'ret', 50)},10) AS cov,
        round({full('covar_samp(ret,mkt)', 'ret', 50)}/{full('var_samp(CASE WHEN ret IS NOT NULL THEN mkt END)', 'ret', 50)},6) AS beta FROM d""",
)
def _(spark, sf):
    d = with_market_returns(with_returns(b1(spark, sf)))
    return rounded(W.rolling_pair(d, "ret", "mkt_ret", 50).select("symbol", "ts", "corr", "cov", "beta"), cov=10)


@query(
    "rolling_skew_kurt",
    f"""SELECT symbol, ts, round({full('skewness(ret)', 'ret', 50)},5) AS skewness, round({full('kurtosis_pop(ret)', 'ret', 50)},5) AS kurtosis FROM rets""",
)
def _(spark, sf):
    return rounded(W.rolling_shape(with_returns(b1(spark, sf)), "ret", 50).select("symbol", "ts", "skewness", "kurtosis"), 5)


@query(
    "rolling_slope_autocorr",
    f"""WITH d AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts)::DOUBLE AS i, {lag('close')} AS p FROM bars),
        x AS (SELECT symbol, ts, {full('regr_slope(close,i)', 'close', 20)} AS slope, {full('corr(close,i)', 'close', 20)} AS trend_corr,
          {full('corr(close,p)', 'p', 20)} AS autocorr FROM d)
        SELECT symbol, ts, round(slope,6) AS slope, round(trend_corr,6) AS trend_corr, round(autocorr,6) AS autocorr,
        round(CASE WHEN autocorr>0 AND autocorr<1 THEN -ln(2)/ln(autocorr) END,4) AS half_life FROM x""",
)
def _(spark, sf):
    return rounded(W.rolling_trend(b1(spark, sf), "close", 20).drop("close"), half_life=4)


@query(
    "rolling_extrema",
    f"""WITH d AS (SELECT symbol, ts, close, {lo('low', 20)} AS support, {hi('high', 20)} AS resistance FROM bars)
        SELECT symbol, ts, round(support,6) AS support, round(resistance,6) AS resistance, close <= support*(1+0.01::DOUBLE) AS near_support,
        close >= resistance*(1-0.01::DOUBLE) AS near_resistance FROM d""",
)
def _(spark, sf):
    d = W.rolling_levels(b1(spark, sf, "high", "low", "close"), 20)
    return rounded(d.drop("high", "low", "close"))


@query(
    "lag_pct_change",
    f"""SELECT symbol, ts, round({lag('close', 1)},6) AS lag_1, round({lag('close', 5)},6) AS lag_5, round({pct('close', 1)},8) AS chg_1,
        round({pct('close', 5)},8) AS chg_5, round(close-2*{lag('close')}+{lag('close', 2)},6) AS diff2 FROM bars""",
)
def _(spark, sf):
    return rounded(W.lag_changes(b1(spark, sf), "close", [1, 5]).drop("close"), chg_1=8, chg_5=8)


@query(
    "lead_forward",
    f"SELECT symbol, ts, round({lead('close', 1)},6) AS lead_1, round({lead('close', 12)},6) AS lead_12 FROM bars",
)
def _(spark, sf):
    return rounded(W.forward_values(b1(spark, sf), "close", [1, 12]).drop("close"))


@query(
    "forward_frame_extrema",
    f"SELECT symbol, ts, round(max(high) {span(1, 12)},6) AS high_12, round(min(low) {span(1, 12)},6) AS low_12 FROM bars",
)
def _(spark, sf):
    def build(d, fr):
        w = fr.span(1, 12)
        return d.withColumns({"high_12": F.max("high").over(w), "low_12": F.min("low").over(w)})

    return rounded(framed(b1(spark, sf, "high", "low"), build, before=0, after=12).drop("high", "low"))


@query(
    "cumulative_sum",
    """SELECT trade_id, symbol, round(sum(pnl) OVER w,6) AS cum_pnl, CAST(sum(holding_minutes) OVER w AS BIGINT) AS cum_minutes FROM round_trips
       WINDOW w AS (PARTITION BY symbol ORDER BY ts, trade_id)""",
)
def _(spark, sf):
    t = round_trips(spark, sf)
    d = W.running_totals(t, {"cum_pnl": F.col("pnl"), "cum_minutes": F.col("holding_minutes")}, order=TS_ID)
    return rounded(d.select("trade_id", "symbol", "cum_pnl", "cum_minutes"))


_CUM = """c AS (SELECT symbol, ts, trade_id, sum(pnl) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS equity FROM round_trips),
       p AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS peak FROM c)"""


def equity(spark, sf):
    t = round_trips(spark, sf).select("symbol", "ts", "trade_id", "pnl", CHUNK)
    return W.running_totals(t, {"equity": F.col("pnl")}, order=TS_ID)


@query(
    "drawdown_series",
    f"""WITH {_CUM}, q AS (SELECT symbol, trade_id, equity, greatest(0,peak) AS peak FROM p)
        SELECT symbol, trade_id, round(equity,6) AS equity, round(peak,6) AS peak, round(equity-peak,6) AS drawdown,
        round((equity-peak)/nullif(peak,0),6) AS drawdown_pct FROM q""",
)
def _(spark, sf):
    d = W.drawdowns(equity(spark, sf), "equity", order=TS_ID, floor_zero=True)
    return rounded(d.drop("ts", "pnl", CHUNK))


@query(
    "drawdown_episodes",
    f"""WITH {_CUM}, e AS (SELECT *, sum(CASE WHEN equity>=peak THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, trade_id)::BIGINT AS episode FROM p)
        SELECT symbol, episode, min(ts) AS start_ts, max(ts) AS end_ts, round(min(equity-peak),6) AS depth, count(*) AS rows,
        max(ts) < (SELECT max(ts) FROM round_trips r WHERE r.symbol=e.symbol) AS recovered FROM e WHERE equity<peak GROUP BY 1,2""",
)
def _(spark, sf):
    return rounded(W.drawdown_episodes(equity(spark, sf), "equity", order=TS_ID))


@query(
    "gaps_and_islands",
    """WITH d AS (SELECT trade_id, symbol, ts, pnl>0 AS win, pnl>0 IS DISTINCT FROM lag(pnl>0) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS new FROM round_trips),
       i AS (SELECT *, sum(new::INT) OVER (PARTITION BY symbol ORDER BY ts, trade_id)::BIGINT AS island FROM d)
       SELECT trade_id, symbol, win, island, row_number() OVER (PARTITION BY symbol, island ORDER BY ts, trade_id) AS run_position FROM i""",
)
def _(spark, sf):
    t = round_trips(spark, sf).select("trade_id", "symbol", "ts", (F.col("pnl") > 0).alias("win"), CHUNK)
    return W.runs(t, "win", order=TS_ID).drop("ts", CHUNK)


@query(
    "max_consecutive",
    """WITH d AS (SELECT trade_id, symbol, ts, pnl>0 AS win, pnl>0 IS DISTINCT FROM lag(pnl>0) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS new FROM round_trips),
       i AS (SELECT *, sum(new::INT) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS island FROM d),
       n AS (SELECT symbol, win, island, count(*) AS n FROM i GROUP BY 1,2,3) SELECT symbol, win, max(n) AS longest, count(*) AS runs FROM n GROUP BY 1,2""",
)
def _(spark, sf):
    from tidemark.operators.frames import islands

    t = round_trips(spark, sf).select("trade_id", "symbol", "ts", (F.col("pnl") > 0).alias("win"), CHUNK)
    d = islands(t, "win", order=TS_ID).groupBy("symbol", "win", "island").agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("symbol", "win").agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("runs"))


REGIME = f"""x AS (SELECT symbol, ts, close, {pct('close')} AS ret FROM bars),
        v AS (SELECT *, {mean('close', 20)} AS f, {mean('close', 50)} AS s, {std('ret', 20)} AS vol FROM x),
        q AS (SELECT symbol, quantile_cont(vol,0.7) AS q FROM v GROUP BY 1),
        g AS (SELECT v.symbol, v.ts, v.vol, CASE WHEN s IS NOT NULL AND vol IS NOT NULL THEN CASE WHEN f>s THEN 'up' ELSE 'down' END ||
          CASE WHEN vol>q.q*(1+1e-12::DOUBLE) THEN '_volatile' ELSE '_calm' END END AS regime FROM v JOIN q ON v.symbol=q.symbol)"""


@query(
    "regime_change_list",
    f"""WITH {REGIME}, n AS (SELECT * FROM g WHERE regime IS NOT NULL),
        p AS (SELECT symbol, ts, {lag('regime')} AS previous, regime FROM n) SELECT * FROM p WHERE regime<>previous""",
)
def _(spark, sf):
    return W.regime_changes(W.regimes_ma_vol(b1(spark, sf)))


@query(
    "frame_share_and_sequence",
    f"""WITH {REGIME}, n AS (SELECT symbol, ts, regime, list(regime) {over(10)} AS seen, {lag('regime')} AS a, {lag('regime', 2)} AS b FROM g WHERE regime IS NOT NULL)
        SELECT symbol, ts, regime, round(len(list_filter(seen, lambda s: s=regime))/len(seen),6) AS share, len(list_distinct(seen)) AS distinct_states,
        coalesce(regime=b AND regime<>a, false) AS back_and_forth FROM n""",
)
def _(spark, sf):
    d = W.regimes_ma_vol(b1(spark, sf)).where("regime IS NOT NULL").select("symbol", "ts", "regime")
    return rounded(W.frame_share(d, "regime"))


@query(
    "ewma",
    f"""WITH e AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, {ewm('close', 0.1)} AS ewm,
          list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS xs FROM bars)
        SELECT symbol, ts, round(ewm,6) AS ewm, round(list_sum(list_transform(xs, lambda x, k: x*pow(0.9::DOUBLE, i-k)))
          / list_sum(list_transform(xs, lambda x, k: pow(0.9::DOUBLE, i-k))),6) AS ewm_adjusted FROM e""",
)
def _(spark, sf):
    d = exponential_means(b1(spark, sf), {"ewm": Mean("close", 0.1), "ewm_adjusted": Mean("close", 0.1, "adjust")})
    return rounded(d.drop("close"))


@query(
    "cross_section_rank",
    """SELECT symbol, ts, round((rank() OVER (PARTITION BY ts ORDER BY volume) + (count(*) OVER (PARTITION BY ts, volume)-1)/2.0)
       / count(*) OVER (PARTITION BY ts),6) AS rank FROM bars""",
)
def _(spark, sf):
    return rounded(I.cross_section_rank(b1(spark, sf, "volume"), "volume").drop("volume"))


@query(
    "performance_rank",
    "WITH s AS (SELECT symbol, sum(pnl) AS pnl FROM trades GROUP BY 1) SELECT symbol, round(pnl,4) AS pnl, dense_rank() OVER (ORDER BY pnl DESC) AS rank FROM s",
)
def _(spark, sf):
    from tidemark.sources.standins import trades

    d = trades(spark, sf).groupBy("symbol").agg(F.sum("pnl").alias("pnl"))
    return rounded(W.performance_rank(d, "pnl"), 4)


@query(
    "rolling_zscore",
    f"""SELECT symbol, ts, round((close-{full('avg(close)', 'close', 200, 50)})/({full('stddev_samp(close)', 'close', 200, 50)}+1e-8),6) AS z FROM bars""",
)
def _(spark, sf):
    return rounded(W.rolling_zscore(b1(spark, sf), "close").drop("close"))


@query(
    "expanding_percentile",
    f"""WITH d AS (SELECT symbol, ts, close, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS xs FROM bars)
        SELECT symbol, ts, round((len(list_filter(xs, lambda x: x<close)) + len(list_filter(xs, lambda x: x<=close)) + 1)*50.0/len(xs),6) AS percentile FROM d""",
)
def _(spark, sf):
    return rounded(W.expanding_percentile(b1(spark, sf), "close").drop("close"))


@query(
    "rolling_percent_rank",
    f"""WITH d AS (SELECT symbol, ts, close, list(close) {over(100)} AS xs FROM bars)
        SELECT symbol, ts, round(CASE WHEN len(xs)>=100 THEN (len(list_filter(xs, lambda x: x<close)) + len(list_filter(xs, lambda x: x<=close)) + 1)*50.0/len(xs) END,6) AS pct_rank FROM d""",
)
def _(spark, sf):
    return rounded(W.rolling_percent_rank(b1(spark, sf), "close").drop("close"))


@query(
    "sliding_time_windows",
    """WITH d AS (SELECT symbol, epoch(date_trunc('day', ts))::BIGINT // 86400 AS day, pnl FROM round_trips),
       w AS (SELECT symbol, pnl, unnest(generate_series(CAST(floor((day-10)/3.0) AS BIGINT)+1, day//3)) AS w FROM d)
       SELECT symbol, TIMESTAMP '1970-01-01' + to_days(CAST(w*3 AS INT)) AS window_start, round(sum(pnl),6) AS pnl, count(*)::BIGINT AS trades, count_if(pnl>0)::BIGINT AS wins
       FROM w GROUP BY 1,2""",
)
def _(spark, sf):
    one = F.lit(1)
    sums = {"pnl": F.col("pnl"), "trades": one, "wins": (F.col("pnl") > 0).cast("int")}
    return rounded(W.window_sums(round_trips(spark, sf), 10, 3, sums))


@query(
    "block_windows",
    """WITH d AS (SELECT symbol, pnl, (row_number() OVER (PARTITION BY symbol ORDER BY ts, trade_id)-1)//10 AS block FROM round_trips)
       SELECT symbol, block, round(sum(pnl),6) AS total FROM d GROUP BY 1,2 HAVING count(*)=10""",
)
def _(spark, sf):
    return rounded(W.block_windows(round_trips(spark, sf), 10, "pnl", order=TS_ID))


@query(
    "lag_gap_stats",
    """WITH l AS (SELECT symbol, ts, epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS gap FROM ticks),
       m AS (SELECT symbol, quantile_cont(gap,0.5) AS med FROM l GROUP BY 1)
       SELECT l.symbol, round(avg(gap)/1e6,4) AS mean_gap, round(any_value(med)/1e6,6) AS median_gap, count_if(gap>3*med) AS long_gaps FROM l JOIN m ON l.symbol=m.symbol GROUP BY 1""",
)
def _(spark, sf):
    from tidemark.operators.quality import gap_stats
    from tidemark.sources.standins import ticks

    return rounded(gap_stats(ticks(spark, sf)), mean_gap=4)


@query(
    "rolling_win_rate",
    f"""WITH f AS (SELECT symbol, ts, ({lead('close', 12)}/close-1 > 0.01::DOUBLE)::INT AS w FROM bars)
        SELECT symbol, ts, round({mean('w', 100)},6) AS win_rate FROM f""",
)
def _(spark, sf):
    return rounded(W.future_win_rate(b1(spark, sf), 12, 0.01).drop("close"))


__all__ = ["CHUNK", "REGIME"]
