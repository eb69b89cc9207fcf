"""Splits, drift, selection and test queries."""

from pyspark.sql import functions as F

from tidemark.operators import validation as V
from tidemark.operators.joins import corr_matrix
from tidemark.operators.series import with_returns
from tidemark.operators.signals import feature_set
from tidemark.plans.registry import part, query
from tidemark.plans.report_queries import rounded
from tidemark.plans.sqltext import lead, mean, pct, std
from tidemark.plans.window_queries import b1
from tidemark.session import materialize
from tidemark.sources.scan import as_ts
from tidemark.sources.standins import round_trips, table

BAR = ("open", "high", "low", "close", "volume")
FEATURES = ["rsi", "volume_ratio", "volatility", "momentum"]

part(
    "feats",
    ("bars", "rsi14", "rets"),
    f"""SELECT symbol, ts, rsi, volume_ratio, volatility, momentum, close, {lead('close', 12)}/close-1 AS future, ({lead('close', 12)}/close-1 > 0)::INT AS label FROM
        (SELECT symbol, ts, rsi, close, volume/{mean('volume', 20)} AS volume_ratio, {std('ret', 20)} AS volatility, {pct('close', 10)} AS momentum FROM
          (SELECT b.symbol, b.ts, b.close, b.volume, r.rsi, t.ret FROM bars b JOIN rsi14 r ON b.symbol=r.symbol AND b.ts=r.ts JOIN rets t ON b.symbol=t.symbol AND b.ts=t.ts))""",
)
_LONG = "SELECT ts, label, future, unnest(['rsi','volume_ratio','volatility','momentum']) AS feature, unnest([rsi,volume_ratio,volatility,momentum]) AS value FROM feats"


def features(spark, sf):
    """Feature table with a forward return and a binary label, written once per application."""
    from tidemark.operators.labels import future_returns


    def make():
        d = future_returns(feature_set(b1(spark, sf, *BAR)).select("symbol", "ts", "close", *FEATURES), [12])
        return d.withColumn("future", F.col("ret_12")).withColumn("label", (F.col("ret_12") > 0).cast("int")).drop("ret_12")

    return materialize(spark, f"features:{sf}", make)


@query(
    "time_split",
    """WITH n AS (SELECT trade_id, symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM round_trips)
       SELECT trade_id, symbol, CASE WHEN i <= floor(n*6/10) THEN 'train' WHEN i <= floor(n*8/10) THEN 'validation' ELSE 'test' END AS split FROM n""",
)
def _(spark, sf):
    d = V.time_split(round_trips(spark, sf), order=("ts", "trade_id"))
    return d.select("trade_id", "symbol", "split")


@query(
    "purged_folds",
    """WITH n AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts)-1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), f AS (SELECT *, unnest(range(5)) AS fold FROM n),
       b AS (SELECT *, fold*(n//5) AS lo, CASE WHEN fold=4 THEN n ELSE (fold+1)*(n//5) END AS hi FROM f), r AS (SELECT symbol, ts, fold, CASE WHEN i>=lo AND i<hi THEN 'test' WHEN i<lo-10 OR i>=hi+5 THEN 'train' END AS role FROM b)
       SELECT symbol, ts, fold, role FROM r WHERE role IS NOT NULL""",
)
def _(spark, sf):
    return V.purged_folds(b1(spark, sf), 5, 10, 5).select("symbol", "ts", "fold", "role")


@query(
    "expanding_folds",
    """WITH s AS (SELECT symbol, min(epoch(ts))::BIGINT AS a, max(epoch(ts))::BIGINT AS b FROM bars GROUP BY 1), f AS (SELECT x.symbol, ts, epoch(ts)::BIGINT AS t, a, (b-a)/5.0::DOUBLE AS step, unnest(range(1,5)) AS fold FROM bars x JOIN s ON x.symbol=s.symbol),
       r AS (SELECT symbol, ts, fold, CASE WHEN t>=a+step*fold AND (t<a+step*fold+step OR fold=4) THEN 'test' WHEN t<a+step*fold-24*3600 THEN 'train' END AS role FROM f) SELECT * FROM r WHERE role IS NOT NULL""",
)
def _(spark, sf):
    return V.expanding_folds(b1(spark, sf), 4, 24).select("symbol", "ts", "fold", "role")


@query(
    "walk_forward_windows",
    """WITH f AS (SELECT pnl_pct AS r, w AS "window", epoch(ts)-epoch(TIMESTAMP '2024-01-01')-w*4*86400 AS t FROM round_trips, range(5) g(w)),
       g AS (SELECT "window", CASE WHEN t>=0 AND t<8*86400 THEN 'train' WHEN t>=8*86400 AND t<12*86400 THEN 'test' END AS role, r FROM f)
       SELECT "window", count_if(role='train') AS train_trades, count_if(role='test') AS test_trades, round(avg(r) FILTER (role='train'),6) AS train_mean, round(avg(r) FILTER (role='test'),6) AS test_mean,
       round(avg(r) FILTER (role='train')/stddev_samp(r) FILTER (role='train'),6) AS train_sharpe, round(avg(r) FILTER (role='test')/stddev_samp(r) FILTER (role='test'),6) AS test_sharpe,
       round(avg(r) FILTER (role='train')-avg(r) FILTER (role='test'),6) AS decay FROM g WHERE role IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    return rounded(V.walk_forward(round_trips(spark, sf), "2024-01-01", 8, 4, 4, 5))


_SPLIT = "TIMESTAMP '2024-01-16'"


def _edges(src, where, bins=10):
    es = ",".join(f"quantile_cont(value,{i / bins})" for i in range(bins + 1))
    return f"e AS (SELECT feature, list_sort(list_distinct([{es}])) AS e FROM {src} WHERE {where} GROUP BY 1)"


_BIN = "CASE WHEN len(e)>1 AND value>=e[1] AND value<=e[len(e)] THEN greatest(1,len(list_filter(e, lambda z: z<value))) END"


@query(
    "psi_drift",
    f"""WITH l AS (SELECT feature, value, ts < {_SPLIT} AS base FROM ({_LONG}) WHERE value IS NOT NULL), {_edges('l', 'base')},
        b AS (SELECT l.feature, base, {_BIN} AS bin FROM l JOIN e ON l.feature=e.feature), c AS (SELECT feature, bin, count_if(base) AS nb, count_if(NOT base) AS no FROM b WHERE bin IS NOT NULL GROUP BY 1,2),
        s AS (SELECT *, greatest(1e-4, nb/sum(nb) OVER (PARTITION BY feature)) AS p, greatest(1e-4, no/sum(no) OVER (PARTITION BY feature)) AS q FROM c), t AS (SELECT feature, sum((q-p)*ln(q/p)) AS psi, count(*) AS bins FROM s GROUP BY 1)
        SELECT feature, round(psi,6) AS psi, bins, CASE WHEN psi>=0.2 THEN 'major' WHEN psi>=0.1 THEN 'moderate' ELSE 'stable' END AS grade FROM t""",
)
def _(spark, sf):
    f = features(spark, sf)
    early = F.col("ts") < as_ts("2024-01-16")
    return rounded(V.psi(f.where(early), f.where(~early), FEATURES))


@query(
    "information_value",
    f"""WITH l AS (SELECT feature, value, label FROM ({_LONG}) WHERE value IS NOT NULL AND label IS NOT NULL), {_edges('l', 'true')}, b AS (SELECT l.feature, label, {_BIN} AS bin FROM l JOIN e ON l.feature=e.feature),
        c AS (SELECT feature, bin, sum(label) AS g, sum(1-label) AS b FROM b GROUP BY 1,2), s AS (SELECT *, g/sum(g) OVER (PARTITION BY feature) AS pg, b/sum(b) OVER (PARTITION BY feature) AS pb FROM c)
        SELECT feature, round(coalesce(sum(CASE WHEN g>0 AND b>0 THEN (pg-pb)*ln(pg/pb) END),0),6) AS iv FROM s GROUP BY 1""",
)
def _(spark, sf):
    return rounded(V.information_value(features(spark, sf).where("label IS NOT NULL"), FEATURES, "label").select("feature", "iv"))


@query(
    "mutual_information",
    f"""WITH l AS (SELECT feature, value, future FROM ({_LONG}) WHERE value IS NOT NULL AND future IS NOT NULL), s AS (SELECT feature, min(value) AS a, max(value) AS b, min(future) AS c, max(future) AS d FROM l GROUP BY 1),
        x AS (SELECT l.feature, least(floor((value-a)*10/(b-a)),9) AS bx, least(floor((future-c)*10/(d-c)),9) AS by_ FROM l JOIN s ON l.feature=s.feature), c AS (SELECT feature, bx, by_, count(*) AS n FROM x GROUP BY 1,2,3),
        p AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bx) AS nx, sum(n) OVER (PARTITION BY feature, by_) AS ny FROM c)
        SELECT feature, round(sum(n/t*ln((n/t)/(nx/t*(ny/t)))),6) AS mi FROM p GROUP BY 1""",
)
def _(spark, sf):
    return rounded(V.mutual_information(features(spark, sf), FEATURES, "future"))


@query(
    "feature_pair_information",
    """WITH r AS (SELECT row_number() OVER () AS id, * FROM feats), l AS (SELECT id, unnest(['rsi','volume_ratio','volatility','momentum']) AS f, unnest([rsi,volume_ratio,volatility,momentum]) AS v FROM r),
        s AS (SELECT f, min(v) AS lo, max(v) AS hi FROM l GROUP BY 1), k AS (SELECT id, l.f, least(floor((v-lo)*10/(hi-lo)),9) AS k FROM l JOIN s ON l.f=s.f WHERE v IS NOT NULL),
        c AS (SELECT a.f AS a, b.f AS b, a.k AS x, b.k AS y, count(*) AS n FROM k a JOIN k b ON a.id=b.id AND a.f<b.f GROUP BY 1,2,3,4),
        p AS (SELECT *, sum(n) OVER (PARTITION BY a,b) AS t, sum(n) OVER (PARTITION BY a,b,x) AS nx, sum(n) OVER (PARTITION BY a,b,y) AS ny FROM c)
        SELECT a, b, sum(n)::BIGINT AS n, round(sum(n/t*ln((n/t)/(nx/t*(ny/t)))),6) AS mi FROM p GROUP BY 1,2""",
)
def _(spark, sf):
    return rounded(V.pair_mutual_information(features(spark, sf), FEATURES))


@query(
    "leakage_corr_scan",
    f"""SELECT feature, round(corr(value,label),6) AS corr, count(value) AS n, abs(corr(value,label))>0.8 AS suspect FROM ({_LONG}) GROUP BY 1
        UNION ALL SELECT 'future', round(corr(future,label),6), count(future), true FROM feats""",
)
def _(spark, sf):
    return rounded(V.label_correlations(features(spark, sf), [*FEATURES, "future"], "label"))


@query(
    "information_coefficient",
    f"""WITH l AS (SELECT feature, value, future FROM ({_LONG}) WHERE value IS NOT NULL AND future IS NOT NULL),
        r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value)+(count(*) OVER (PARTITION BY feature, value)-1)/2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY future)+(count(*) OVER (PARTITION BY feature, future)-1)/2.0 AS ry FROM l)
        SELECT feature, round(corr(value,future),6) AS ic, count(*) AS n, round(corr(rx,ry),6) AS rank_ic FROM r GROUP BY 1""",
)
def _(spark, sf):
    return rounded(V.information_coefficients(features(spark, sf), FEATURES, "future"))


_HALF = "ts < TIMESTAMP '2024-01-16'"


@query(
    "ks_test",
    f"""WITH c AS (SELECT symbol, pnl, sum(({_HALF})::INT) OVER (PARTITION BY symbol ORDER BY pnl) AS a, sum((NOT {_HALF})::INT) OVER (PARTITION BY symbol ORDER BY pnl) AS b,
          sum(({_HALF})::INT) OVER (PARTITION BY symbol) AS na, sum((NOT {_HALF})::INT) OVER (PARTITION BY symbol) AS nb FROM round_trips), k AS (SELECT symbol, max(na) AS na, max(nb) AS nb, max(abs(a/na-b/nb)) AS ks FROM c GROUP BY 1)
        SELECT symbol, na::BIGINT AS n_a, nb::BIGINT AS n_b, round(ks,8) AS ks, round(least(1,greatest(0,2*(exp(-2*ks*ks*na*nb/(na+nb))-exp(-8*ks*ks*na*nb/(na+nb))))),6) AS p_value FROM k""",
)
def _(spark, sf):
    d = V.ks_statistic(round_trips(spark, sf), F.col("pnl"), F.col("ts") < as_ts("2024-01-16"), ["symbol"])
    return rounded(d, ks=8)


def _cdf(z):
    t = f"(1/(1+0.2316419*abs({z})))"
    tail = f"(exp(-({z})*({z})/2)*0.3989422804014327*{t}*({t}*({t}*({t}*({t}*1.330274429-1.821255978)+1.781477937)-0.356563782)+0.319381530))"
    return f"(CASE WHEN {z}>=0 THEN 1-{tail} ELSE {tail} END)"


@query(
    "welch_t",
    f"""WITH s AS (SELECT symbol, count(*) FILTER ({_HALF}) AS na, count(*) FILTER (NOT {_HALF}) AS nb, avg(pnl) FILTER ({_HALF}) AS ma, avg(pnl) FILTER (NOT {_HALF}) AS mb, var_samp(pnl) FILTER ({_HALF})/count(*) FILTER ({_HALF}) AS sa,
          var_samp(pnl) FILTER (NOT {_HALF})/count(*) FILTER (NOT {_HALF}) AS sb FROM round_trips GROUP BY 1), t AS (SELECT *, (ma-mb)/sqrt(sa+sb) AS t FROM s)
        SELECT symbol, na AS n_a, nb AS n_b, round(ma,6) AS mean_a, round(mb,6) AS mean_b, round(t,6) AS t, round((sa+sb)*(sa+sb)/(sa*sa/(na-1)+sb*sb/(nb-1)),4) AS dof, round(2*(1-{_cdf('abs(t)')}),6) AS p_value FROM t""",
)
def _(spark, sf):
    return rounded(V.welch_t(round_trips(spark, sf), "pnl", F.col("ts") < as_ts("2024-01-16"), ["symbol"]), dof=4)


@query("normal_cdf_pvalues", f"SELECT event_id, round({_cdf('((value-50)/25)')},6) AS cdf FROM events")
def _(spark, sf):
    from tidemark.functions.candles import normal_cdf

    return rounded(table(spark, sf, "events").select("event_id", normal_cdf((F.col("value") - 50) / 25).alias("cdf")))


@query(
    "mann_kendall",
    f"""WITH d AS (SELECT symbol, date_trunc('day',ts) AS d, sum(pnl) AS x FROM round_trips GROUP BY 1,2), p AS (SELECT a.symbol, sum(sign(b.x-a.x)) AS s FROM d a JOIN d b ON a.symbol=b.symbol AND a.d<b.d GROUP BY 1), n AS (SELECT symbol, count(*) AS n FROM d GROUP BY 1),
        z AS (SELECT p.symbol, n, s, CASE WHEN s>0 THEN (s-1)/sqrt(n*(n-1)*(2*n+5)/18) WHEN s<0 THEN (s+1)/sqrt(n*(n-1)*(2*n+5)/18) ELSE 0 END AS z FROM p JOIN n ON p.symbol=n.symbol)
        SELECT symbol, n::INT AS n, s::DOUBLE AS s, round(z,6) AS z, round(2*(1-{_cdf('abs(z)')}),6) AS p_value FROM z""",
)
def _(spark, sf):
    from tidemark.functions.core import floor_ts

    d = round_trips(spark, sf).groupBy("symbol", floor_ts("ts", 86400).alias("d")).agg(F.sum("pnl").alias("x"))
    return rounded(V.mann_kendall(d, "x", "d", ["symbol"]))


@query(
    "multiple_testing",
    f"""WITH s AS (SELECT account, avg(pnl)/(stddev_samp(pnl)/sqrt(count(*))) AS z FROM round_trips GROUP BY 1 HAVING count(*)>=20), p AS (SELECT account, round(2*(1-{_cdf('abs(z)')}),6) AS p FROM s),
        i AS (SELECT *, row_number() OVER (ORDER BY p, account) AS i, count(*) OVER () AS m FROM p), q AS (SELECT account, p, i, least(1,p*m) AS bonferroni, least(1,p*(m-i+1)) AS hp, least(1,p*m/i) AS bp FROM i)
        SELECT account, p, round(bonferroni,6) AS bonferroni, round(hp,6) AS holm_plain, round(bp,6) AS bh_plain, round(max(hp) OVER (ORDER BY i),6) AS holm, round(min(bp) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),6) AS bh FROM q""",
)
def _(spark, sf):
    from tidemark.functions.candles import two_sided_p

    z = F.avg("pnl") / (F.stddev_samp("pnl") / F.sqrt(F.count(F.lit(1))))
    d = round_trips(spark, sf).groupBy("account").agg(z.alias("z"), F.count(F.lit(1)).alias("n")).where("n >= 20")
    return rounded(V.adjust_p_values(d.select("account", F.round(two_sided_p("z"), 6).alias("p")), "p", tie=["account"]))


_WORDS = """h AS (SELECT {cols}, trade_id, pnl, k, md5(k||'|'||trade_id) AS h FROM round_trips, range(0, {quads}) g(k)),
        u AS (SELECT {cols}, trade_id, pnl, k*4+j AS word, CAST('0x'||substr(h, 1+8*j, 8) AS BIGINT) AS u FROM h, range(0, 4) g(j))"""


@query(
    "monte_carlo_null_test",
    f"""WITH {_WORDS.format(cols="symbol", quads=79)},
        x AS (SELECT symbol, word*32+bit AS sim, CASE WHEN (u >> bit) & 1 = 1 THEN -pnl ELSE pnl END AS x FROM u, range(0, 32) g(bit) WHERE word*32+bit < 10000),
        o AS (SELECT symbol, avg(pnl) AS o, count(*) AS n, sum(pnl*pnl) AS sq, avg((pnl>0)::INT) AS ow, avg(pnl)/stddev_samp(pnl) AS os FROM round_trips GROUP BY 1),
        t AS (SELECT symbol, sim, sum(x) AS t, sum((x>0)::INT) AS w FROM x GROUP BY 1,2),
        m AS (SELECT o.*, t.t/n AS m, t.w/n AS w, (t.t/n)/sqrt((sq-n*(t.t/n)*(t.t/n))/(n-1)) AS s FROM t JOIN o USING (symbol))
        SELECT symbol, round(any_value(o),6) AS observed, any_value(n) AS n, round(any_value(ow),6) AS win_rate, round(any_value(os),6) AS sharpe, count(*) AS sims,
        round(least(1,2*least(avg((m>=o)::INT),avg((m<=o)::INT))),6) AS p_value, round(100*avg((m<=o)::INT),6) AS percentile,
        round(least(1,2*least(avg((w>=ow)::INT),avg((w<=ow)::INT))),6) AS win_rate_p, round(least(1,2*least(avg((s>=os)::INT),avg((s<=os)::INT))),6) AS sharpe_p FROM m GROUP BY 1""",
)
def _(spark, sf):
    return rounded(V.sign_flip_test(round_trips(spark, sf), "pnl", "trade_id", 10_000, ["symbol"]))


_CUTS = " + ".join(f"(u/4294967296.0::DOUBLE>={c!r}::DOUBLE)::INT" for c in V.POISSON_CUTS)


@query(
    "bootstrap_ci",
    f"""WITH {_WORDS.format(cols=f"{_HALF} AS a", quads=250).replace(f"SELECT {_HALF} AS a, trade_id, pnl, k*4", "SELECT a, trade_id, pnl, k*4")}, w AS (SELECT word AS rep, pnl, a, {_CUTS} AS w FROM u),
        d AS (SELECT rep, sum(w*pnl) FILTER (a)/sum(w) FILTER (a) - sum(w*pnl) FILTER (NOT a)/sum(w) FILTER (NOT a) AS d FROM w GROUP BY 1)
        SELECT count(*) AS reps, round(avg(d),6) AS mean_difference, round(quantile_cont(d,0.025),6) AS low, round(quantile_cont(d,0.975),6) AS high FROM d""",
)
def _(spark, sf):
    return rounded(V.bootstrap_difference(round_trips(spark, sf), "pnl", "trade_id", F.col("ts") < as_ts("2024-01-16"), 1_000))


@query(
    "time_stability",
    """WITH d AS (SELECT epoch(date_trunc('day', ts))::BIGINT // 86400 AS day, symbol, pnl FROM round_trips), w AS (SELECT symbol, pnl, unnest(generate_series(CAST(floor((day-10)/3.0) AS BIGINT)+1, day//3)) AS w FROM d),
       m AS (SELECT symbol, w, sum(pnl)/count(*) AS m, count(*) AS n FROM w GROUP BY 1,2 HAVING count(*)>=10)
       SELECT symbol, count(*) AS windows, round(avg(m),6) AS mean, round(stddev_samp(m),6) AS std, round(stddev_samp(m)/abs(avg(m)),4) AS cv, round(regr_slope(m,w),6) AS slope FROM m GROUP BY 1""",
)
def _(spark, sf):
    from tidemark.functions.core import epoch_s
    from tidemark.operators.rolling import window_sums

    w = window_sums(round_trips(spark, sf), 10, 3, {"pnl": F.col("pnl"), "n": F.lit(1)}).where("n >= 10")
    w = w.select("symbol", (F.col("pnl") / F.col("n")).alias("m"), (epoch_s("window_start") / 259200.0).alias("w"))
    return rounded(
        w.groupBy("symbol").agg(
            F.count(F.lit(1)).alias("windows"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"),
            F.round(F.stddev_samp("m") / F.abs(F.avg("m")), 4).alias("cv"), F.regr_slope("m", "w").alias("slope"),
        )
    )


@query(
    "cross_asset_consistency",
    """WITH p AS (SELECT symbol, avg(pnl_pct) AS m, avg((pnl_pct>0)::INT) AS w FROM round_trips GROUP BY 1)
       SELECT count(*) AS symbols, round(avg(m),6) AS mean, round(stddev_samp(m),6) AS std, round(avg(w),6) AS win_rate, round(stddev_samp(w),6) AS win_rate_std, round(avg((m>0)::INT),6) AS positive_share, round(stddev_samp(m)/abs(avg(m)),4) AS cv, round(stddev_samp(w)/avg(w),6) AS win_rate_cv FROM p""",
)
def _(spark, sf):
    return rounded(V.cross_asset_consistency(round_trips(spark, sf)), cv=4)


@query(
    "friedman",
    """WITH d AS (SELECT date_trunc('day',ts) AS d, symbol, sum(pnl) AS x FROM round_trips GROUP BY 1,2), r AS (SELECT symbol, d, rank() OVER (PARTITION BY d ORDER BY x)+(count(*) OVER (PARTITION BY d,x)-1)/2.0 AS r, count(*) OVER (PARTITION BY d) AS c FROM d),
       k AS (SELECT count(DISTINCT symbol) AS k FROM d), s AS (SELECT symbol, sum(r) AS rs, count(*) AS b FROM r, k WHERE c=k GROUP BY 1)
       SELECT max(b) AS blocks, max(k) AS treatments, round(12*sum(rs*rs)/(max(b)*max(k)*(max(k)+1))-3*max(b)*(max(k)+1),6) AS statistic FROM s, k""",
)
def _(spark, sf):
    from tidemark.functions.core import floor_ts

    d = round_trips(spark, sf).groupBy(floor_ts("ts", 86400).alias("d"), "symbol").agg(F.sum("pnl").alias("x"))
    return rounded(V.friedman(d, "x", "d"))


@query(
    "overfit_decay",
    """WITH n AS (SELECT symbol, pnl_pct AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM round_trips),
       s AS (SELECT symbol, r, CASE WHEN i <= floor(n*6/10) THEN 1 WHEN i <= floor(n*8/10) THEN 2 ELSE 3 END AS s FROM n),
       a AS (SELECT symbol, avg((r>0)::INT) FILTER (s=1) AS w1, avg(r) FILTER (s=1)/stddev_samp(r) FILTER (s=1) AS h1, avg((r>0)::INT) FILTER (s=2) AS w2, avg(r) FILTER (s=2)/stddev_samp(r) FILTER (s=2) AS h2, avg((r>0)::INT) FILTER (s=3) AS w3, avg(r) FILTER (s=3)/stddev_samp(r) FILTER (s=3) AS h3 FROM s GROUP BY 1)
       SELECT symbol, round(w1,6) AS train_win_rate, round(h1,6) AS train_sharpe, round(w2,6) AS validation_win_rate, round(h2,6) AS validation_sharpe, round(w3,6) AS test_win_rate, round(h3,6) AS test_sharpe, round(w1-w3,6) AS win_rate_drop, round(h1-h3,6) AS sharpe_drop,
       CASE WHEN w1-w3>0.15 OR h1-h3>0.5 THEN 'severe' WHEN w1-w3>0.05 OR h1-h3>0.2 THEN 'moderate' ELSE 'ok' END AS level FROM a""",
)
def _(spark, sf):
    d = V.time_split(round_trips(spark, sf), order=("ts", "trade_id"))
    return rounded(V.split_decay(d, keys=["symbol"]))


@query(
    "param_grid_cross_join",
    """SELECT symbol, min_conf::DOUBLE AS min_conf, max_hold::DOUBLE AS max_hold, count(*) AS trades, round(avg(pnl),6) AS mean FROM round_trips, (VALUES (0.2),(0.5),(0.8)) a(min_conf), (VALUES (30),(60),(90)) b(max_hold)
       WHERE confidence>=min_conf AND holding_minutes<=max_hold GROUP BY 1,2,3""",
)
def _(spark, sf):
    d = V.param_grid(round_trips(spark, sf), {"min_conf": [0.2, 0.5, 0.8], "max_hold": [30, 60, 90]})
    d = d.where("confidence >= min_conf AND holding_minutes <= max_hold").groupBy("symbol", "min_conf", "max_hold")
    return rounded(d.agg(F.count(F.lit(1)).alias("trades"), F.avg("pnl").alias("mean")))


@query(
    "param_sensitivity",
    """WITH g AS (SELECT symbol, min_conf, max_hold, sum(pnl) AS m FROM round_trips, (VALUES (0.2),(0.5),(0.8)) a(min_conf), (VALUES (30),(60),(90)) b(max_hold) WHERE confidence>=min_conf AND holding_minutes<=max_hold GROUP BY 1,2,3)
       SELECT symbol, count(*) AS combos, round(avg(m),6) AS mean, round(stddev_samp(m)/abs(avg(m)),6) AS cv, round(avg((m>0)::INT),6) AS profitable FROM g GROUP BY 1""",
)
def _(spark, sf):
    d = V.param_grid(round_trips(spark, sf), {"min_conf": [0.2, 0.5, 0.8], "max_hold": [30, 60, 90]})
    g = d.where("confidence >= min_conf AND holding_minutes <= max_hold").groupBy("symbol", "min_conf", "max_hold").agg(F.sum("pnl").alias("m"))
    return rounded(
        g.groupBy("symbol").agg(
            F.count(F.lit(1)).alias("combos"), F.avg("m").alias("mean"), (F.stddev_samp("m") / F.abs(F.avg("m"))).alias("cv"), F.avg((F.col("m") > 0).cast("double")).alias("profitable")
        )
    )


@query(
    "ab_test",
    f"""WITH a AS (SELECT symbol, count(*) FILTER (strategy='s0') AS nt, count(*) FILTER (strategy<>'s0') AS nc, avg(pnl) FILTER (strategy='s0') AS mt, avg(pnl) FILTER (strategy<>'s0') AS mc, var_samp(pnl) FILTER (strategy='s0') AS vt, var_samp(pnl) FILTER (strategy<>'s0') AS vc FROM round_trips GROUP BY 1),
        p AS (SELECT *, sqrt(((nt-1)*vt+(nc-1)*vc)/(nt+nc-2)) AS sp FROM a), e AS (SELECT *, mt-mc AS eff, sp*sqrt(1/nt+1/nc) AS se FROM p),
        r AS (SELECT symbol, strategy='s0' AS t, rank() OVER (PARTITION BY symbol ORDER BY pnl)+(count(*) OVER (PARTITION BY symbol,pnl)-1)/2.0 AS r FROM round_trips), u AS (SELECT symbol, sum(r) FILTER (t) - count(*) FILTER (t)*(count(*) FILTER (t)+1)/2 AS u FROM r GROUP BY 1)
        SELECT e.symbol, nt AS n_t, nc AS n_c, round(mt,6) AS mean_t, round(mc,6) AS mean_c, round(eff,6) AS effect, round(eff-1.959963984540054*se,6) AS ci_low, round(eff+1.959963984540054*se,6) AS ci_high, round(eff/se,6) AS z, round(eff/sp,6) AS cohen_d, round(2*(1-{_cdf('abs(eff/se)')}),6) AS p_value, u::DOUBLE AS u,
        round(1-{_cdf('((u-nt*nc/2)/sqrt(nt*nc*(nt+nc+1)/12))')},6) AS u_p_value FROM e JOIN u ON e.symbol=u.symbol""",
)
def _(spark, sf):
    return rounded(V.ab_test(round_trips(spark, sf), "pnl", F.col("strategy") == "s0", ["symbol"]))


@query(
    "performance_drift",
    f"""WITH a AS (SELECT symbol, {_HALF} AS base, avg(pnl) AS mean_pnl, avg((pnl>0)::INT) AS win_rate, stddev_samp(pnl) AS vol FROM round_trips GROUP BY 1,2), l AS (SELECT symbol, base, unnest(['mean_pnl','win_rate','vol']) AS feature, unnest([mean_pnl,win_rate,vol]) AS v FROM a),
        j AS (SELECT a.symbol, a.feature, a.v AS b, c.v AS c, (c.v-a.v)*100/abs(a.v) AS ch FROM l a JOIN l c ON a.symbol=c.symbol AND a.feature=c.feature AND a.base AND NOT c.base)
        SELECT symbol, feature, round(b,6) AS baseline, round(c,6) AS current, round(ch,5) AS change_pct, CASE WHEN abs(ch)>=50 THEN 'critical' WHEN abs(ch)>=25 THEN 'high' WHEN abs(ch)>=10 THEN 'medium' ELSE 'low' END AS severity FROM j""",
)
def _(spark, sf):
    t = round_trips(spark, sf)
    early = F.col("ts") < as_ts("2024-01-16")
    m = {"mean_pnl": F.avg("pnl"), "win_rate": F.avg((F.col("pnl") > 0).cast("double")), "vol": F.stddev_samp("pnl")}
    return rounded(V.performance_drift(t.where(early), t.where(~early), m), change_pct=5)


@query(
    "classifier_metrics",
    """WITH d AS (SELECT symbol, confidence AS p, (pnl>0)::INT AS y FROM round_trips), m AS (SELECT symbol, count(*) AS n, avg(-(y*ln(greatest(1e-15,least(p,1-1e-15)))+(1-y)*ln(1-greatest(1e-15,least(p,1-1e-15))))) AS ll, count_if(p>=0.5 AND y=1) AS tp, count_if(p>=0.5 AND y=0) AS fp, count_if(p<0.5 AND y=1) AS fn, count_if(p<0.5 AND y=0) AS tn FROM d GROUP BY 1),
       r AS (SELECT symbol, y, rank() OVER (PARTITION BY symbol ORDER BY p)+(count(*) OVER (PARTITION BY symbol,p)-1)/2.0 AS r FROM d), a AS (SELECT symbol, (sum(r) FILTER (y=1)-count_if(y=1)*(count_if(y=1)+1)/2)/(count_if(y=1)*count_if(y=0)) AS auc FROM r GROUP BY 1)
       SELECT m.symbol, n, round(ll,6) AS log_loss, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp+tn)/n,6) AS accuracy, round(tp/(tp+fp),6) AS precision, round(tp/(tp+fn),6) AS recall, round(2*tp/(2*tp+fp+fn),6) AS f1, round(auc,6) AS auc FROM m JOIN a ON m.symbol=a.symbol""",
)
def _(spark, sf):
    t = round_trips(spark, sf).withColumn("y", (F.col("pnl") > 0).cast("int"))
    return rounded(V.classifier_metrics(t, "confidence", "y", keys=["symbol"]))


@query(
    "feature_selection",
    f"""WITH l AS (SELECT feature, value, label FROM ({_LONG}) WHERE value IS NOT NULL AND label IS NOT NULL), g AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM l GROUP BY 1,2),
        t AS (SELECT feature, sum(n) AS nn, count(*) AS k, sum(n*m)/sum(n) AS gm, sum(n*v) AS ssw, sum(n*m*m) AS q FROM g GROUP BY 1)
        SELECT feature, round(((q-nn*gm*gm)/(k-1))/(ssw/(nn-k)),5) AS f, round((ssw+q-nn*gm*gm)/(nn-1),8) AS variance, (ssw+q-nn*gm*gm)/(nn-1) < 0.01 AS low_variance FROM t""",
)
def _(spark, sf):
    d = V.anova_f(features(spark, sf).where("label IS NOT NULL"), FEATURES, "label")
    return rounded(d.withColumn("low_variance", F.col("variance") < 0.01), f=5, variance=8)


@query(
    "correlated_feature_pairs",
    f"""WITH l AS (SELECT symbol||ts AS k, feature, value FROM (SELECT symbol, ts, unnest(['rsi','volume_ratio','volatility','momentum']) AS feature, unnest([rsi,volume_ratio,volatility,momentum]) AS value FROM feats) WHERE value IS NOT NULL),
        v AS (SELECT feature, var_samp(value) AS v FROM l GROUP BY 1), c AS (SELECT a.feature AS a, b.feature AS b, corr(a.value,b.value) AS corr FROM l a JOIN l b ON a.k=b.k AND a.feature<b.feature GROUP BY 1,2)
        SELECT a, b, round(corr,6) AS corr, CASE WHEN abs(corr)>0.5 THEN CASE WHEN x.v<=y.v THEN a ELSE b END END AS dropped FROM c JOIN v x ON a=x.feature JOIN v y ON b=y.feature""",
)
def _(spark, sf):
    from tidemark.operators.quality import long_form

    d = long_form(features(spark, sf), FEATURES, ["symbol", "ts"]).where("value IS NOT NULL")
    c = corr_matrix(d, "value", ["symbol", "ts"], "feature")
    v = d.groupBy("feature").agg(F.var_samp("value").alias("v"))
    j = c.join(v.select(F.col("feature").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("feature").alias("b"), F.col("v").alias("vb")), "b")
    weaker = F.when(F.col("va") <= F.col("vb"), F.col("a")).otherwise(F.col("b"))
    return rounded(j.select("a", "b", "corr", F.when(F.abs("corr") > 0.5, weaker).alias("dropped")))


_CUT_LIST = [round(0.1 + 0.8 * i / 49, 6) for i in range(50)]


@query(
    "threshold_optimization",
    f"""WITH c AS (SELECT unnest({_CUT_LIST}::DOUBLE[]) AS cut), s AS (SELECT symbol, cut, count(*) AS signals, avg((pnl_pct>0)::INT) AS wr, avg(pnl_pct) AS m, sqrt(greatest(0,avg(pnl_pct*pnl_pct)-avg(pnl_pct)*avg(pnl_pct))) AS sd FROM round_trips, c WHERE confidence>=cut GROUP BY 1,2 HAVING count(*)>=10),
        x AS (SELECT *, 0.4*wr+0.4*coalesce(m/nullif(sd,0),0)+CASE WHEN m>0 THEN 0.2 ELSE 0 END AS score FROM s)
        SELECT symbol, cut, signals::BIGINT AS signals, round(score,6) AS score FROM x QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(score,9) DESC, cut)=1""",
)
def _(spark, sf):
    scan = V.threshold_scan(round_trips(spark, sf), "confidence", "pnl_pct", _CUT_LIST, ["symbol"])
    return rounded(V.best_threshold(scan, ["symbol"]))


@query(
    "signal_dedupe_spacing",
    """WITH h AS (SELECT symbol, ts AS hts FROM round_trips WHERE confidence>=0.9 AND ts < TIMESTAMP '2024-01-25'), n AS (SELECT * FROM round_trips WHERE confidence>=0.6 AND ts >= TIMESTAMP '2024-01-20'),
       j AS (SELECT n.trade_id, n.symbol, n.ts, n.confidence, h.hts FROM n ASOF LEFT JOIN h ON n.symbol=h.symbol AND n.ts > h.hts), k AS (SELECT * FROM j WHERE hts IS NULL OR (epoch_us(ts)-epoch_us(hts))/3.6e9 >= 2)
       SELECT trade_id, symbol, ts, confidence FROM k QUALIFY row_number() OVER (PARTITION BY date_trunc('day',ts) ORDER BY confidence DESC, ts, trade_id) <= 20""",
)
def _(spark, sf):
    t = round_trips(spark, sf)
    history = t.where((F.col("confidence") >= 0.9) & (F.col("ts") < as_ts("2024-01-25")))
    fresh = t.where((F.col("confidence") >= 0.6) & (F.col("ts") >= as_ts("2024-01-20")))
    d = V.suppress_recent(fresh, history, 2.0)
    return V.daily_limit(d, 20, [F.col("confidence").desc(), F.col("ts"), F.col("trade_id")]).select("trade_id", "symbol", "ts", "confidence")


@query(
    "selection_bias_score",
    """WITH p AS (SELECT symbol, sum(pnl_pct) AS p, avg((pnl_pct>0)::INT) AS w FROM round_trips GROUP BY 1), a AS (SELECT count(*) AS n, avg(p) AS mp, stddev_pop(p) AS sp, avg(w) AS mw, stddev_pop(w) AS sw FROM p),
       s AS (SELECT any_value(n) AS symbols, avg(pow((p-mp)/sp,3)) AS ps, avg(pow((w-mw)/sw,3)) AS ws, avg((p>0)::INT) AS pos, any_value(sp)/abs(any_value(mp)) AS cv FROM p, a)
       SELECT symbols, round(ps,6) AS pnl_skew, round(ws,6) AS win_rate_skew, round(pos,6) AS positive_share, round(cv,6) AS cv,
       CAST(least(1,CASE WHEN abs(ps)>1 THEN 0.3 ELSE 0 END+CASE WHEN abs(ws)>1 THEN 0.2 ELSE 0 END+CASE WHEN pos>0.8 OR pos<0.2 THEN 0.3 ELSE 0 END+CASE WHEN cv>1 THEN 0.2 ELSE 0 END) AS DOUBLE) AS score FROM s""",
)
def _(spark, sf):
    return rounded(V.selection_bias(round_trips(spark, sf)))


@query(
    "parameter_boundary",
    """WITH g AS (SELECT 'min_conf' AS param, c AS value, avg(pnl) AS perf FROM round_trips, (SELECT unnest([0.1,0.3,0.5,0.7,0.9]::DOUBLE[]) AS c) WHERE confidence>=c GROUP BY 2
         UNION ALL SELECT 'max_hold', c, avg(pnl) FROM round_trips, (SELECT unnest([10,30,50,70,90]::DOUBLE[]) AS c) WHERE holding_minutes<=c GROUP BY 2),
       a AS (SELECT param, arg_max(value,(perf,value)) AS best, min(value) AS low, max(value) AS high, stddev_samp(value)/abs(avg(value)) AS cv, corr(value,perf) AS cp FROM g GROUP BY 1)
       SELECT param, best, low, high, round(cv,6) AS cv, round(cp,6) AS corr_perf, best=low OR best=high AS at_edge FROM a""",
)
def _(spark, sf):
    t = round_trips(spark, sf)
    a = V.param_grid(t, {"value": [0.1, 0.3, 0.5, 0.7, 0.9]}).where("confidence >= value").withColumn("param", F.lit("min_conf"))
    b = V.param_grid(t, {"value": [10, 30, 50, 70, 90]}).where("holding_minutes <= value").withColumn("param", F.lit("max_hold"))
    h = a.unionByName(b).groupBy("param", "value").agg(F.avg("pnl").alias("perf"))
    return rounded(V.parameter_boundary(h))


@query(
    "two_proportion_z",
    f"""WITH a AS (SELECT count(*) FILTER (strategy='s0') AS na, count(*) FILTER (strategy<>'s0') AS nb, avg((pnl_pct>0)::INT) FILTER (strategy='s0') AS wa, avg((pnl_pct>0)::INT) FILTER (strategy<>'s0') AS wb FROM round_trips),
        p AS (SELECT *, (wa*na+wb*nb)/(na+nb) AS pool FROM a), z AS (SELECT *, (wa-wb)/sqrt(pool*(1-pool)*(1/na+1/nb)) AS z FROM p) SELECT na AS n_a, nb AS n_b, round(wa,6) AS win_a, round(wb,6) AS win_b, round(z,6) AS z, round(2*(1-{_cdf('abs(z)')}),6) AS p_value FROM z""",
)
def _(spark, sf):
    return rounded(V.two_proportions(round_trips(spark, sf), F.col("strategy") == "s0"))


@query(
    "qcut_codes",
    """WITH q AS (SELECT symbol, list_sort(list_distinct([quantile_cont(volume,0.0),quantile_cont(volume,0.2),quantile_cont(volume,0.4),quantile_cont(volume,0.6),quantile_cont(volume,0.8),quantile_cont(volume,1.0)])) AS e FROM bars GROUP BY 1)
       SELECT b.symbol, b.ts, (greatest(1,len(list_filter(e, lambda z: z<volume)))-1)::INT AS code FROM bars b JOIN q ON b.symbol=q.symbol""",
)
def _(spark, sf):
    from tidemark.operators.order_stats import join_stats

    b = b1(spark, sf, "volume").withColumn("value", F.col("volume"))
    e = V.quantile_edges(b, 5, "symbol")
    return join_stats(b, e, ["symbol"]).select("symbol", "ts", (V.bin_index(F.col("_edges"), F.col("value")) - 1).alias("code"))


__all__ = ["features", "with_returns"]
