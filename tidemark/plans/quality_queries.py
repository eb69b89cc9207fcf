"""Data-quality queries on bars derived from the events."""

from pyspark.sql import functions as F

from tidemark.functions.core import EPS
from tidemark.operators import fills as N
from tidemark.operators import quality as Q
from tidemark.operators.indicators import rsi
from tidemark.operators.series import with_returns
from tidemark.plans.registry import part, query
from tidemark.plans.report_queries import rounded
from tidemark.plans.sqltext import mean, pct, std
from tidemark.plans.window_queries import b1
from tidemark.sources.standins import bars, table

BAR = ("open", "high", "low", "close", "volume")

# bars with planted faults: the same rule on both sides
part(
    "dirty",
    ("bars",),
    """SELECT symbol, ts, open, CASE WHEN hour(ts)=5 AND day(ts) % 7 = 0 THEN close*0.99 ELSE high END AS high, low,
       CASE WHEN hour(ts)=9 AND day(ts) % 11 = 0 THEN NULL ELSE close END AS close, CASE WHEN hour(ts)=13 AND day(ts) % 5 = 0 THEN 0 ELSE volume END AS volume FROM bars""",
)


def dirty(spark, sf):
    h, d = F.hour("ts"), F.dayofmonth("ts")
    return bars(spark, sf).select(
        "symbol", "ts", "open",
        F.when((h == 5) & (d % 7 == 0), F.col("close") * 0.99).otherwise(F.col("high")).alias("high"),
        "low",
        F.when((h == 9) & (d % 11 == 0), None).otherwise(F.col("close")).alias("close"),
        F.when((h == 13) & (d % 5 == 0), 0.0).otherwise(F.col("volume")).alias("volume"),
    )


@query(
    "completeness",
    """WITH a AS (SELECT symbol, count(*) AS rows, (epoch(max(ts))::BIGINT-epoch(min(ts))::BIGINT)//3600+1 AS expected, count(close)/count(*) AS cs, count(volume)/count(*) AS vs FROM dirty GROUP BY 1)
       SELECT symbol, rows, expected, round(rows/expected,6) AS density, round(cs,6) AS close_share, round(vs,6) AS volume_share FROM a""",
)
def _(spark, sf):
    return rounded(Q.completeness(dirty(spark, sf), 3600, ["close", "volume"]))


_RULES = """r AS (SELECT symbol, ts, coalesce(high>=greatest(open,close,low),true) AS h, coalesce(low<=least(open,close),true) AS l, coalesce(least(open,high,low,close)>0,true) AS p, coalesce(volume>=0,true) AS v FROM dirty)"""


@query(
    "ohlc_consistency",
    f"""WITH {_RULES} SELECT symbol, count(*) AS rows, round(avg(h::INT),6) AS high_ok, round(avg(l::INT),6) AS low_ok, round(avg(p::INT),6) AS positive_ok, round(avg(v::INT),6) AS volume_ok,
        round(avg((h AND l AND p AND v)::INT),6) AS valid_share FROM r GROUP BY 1""",
)
def _(spark, sf):
    return rounded(Q.ohlc_consistency(dirty(spark, sf)))


@query("ohlc_violations", f"WITH {_RULES} SELECT symbol, ts, concat_ws(',', CASE WHEN NOT h THEN 'high_ok' END, CASE WHEN NOT l THEN 'low_ok' END, CASE WHEN NOT p THEN 'positive_ok' END, CASE WHEN NOT v THEN 'volume_ok' END) AS broken FROM r WHERE NOT (h AND l AND p AND v)")
def _(spark, sf):
    return Q.ohlc_violations(dirty(spark, sf)).select("symbol", "ts", F.concat_ws(",", "broken").alias("broken"))


@query(
    "time_gaps",
    """WITH g AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars15)
       SELECT symbol, p AS gap_start, ts AS gap_end, (epoch(ts)::BIGINT-epoch(p)::BIGINT)//900-1 AS missing FROM g WHERE epoch(ts)-epoch(p) > 900""",
)
def _(spark, sf):
    return Q.time_gaps(bars(spark, sf, 900), 900)


@query(
    "price_outliers",
    f"""WITH z AS (SELECT symbol, ts, ret, (close-{mean('close', 20)})/nullif({std('close', 20)},0) AS z FROM rets),
        a AS (SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS s, quantile_cont(abs(ret),0.99) AS q, quantile_cont(ret,0.5) AS md FROM rets GROUP BY 1),
        d AS (SELECT r.symbol, quantile_cont(abs(ret-md),0.5) AS mad FROM rets r JOIN a ON r.symbol=a.symbol GROUP BY 1),
        f AS (SELECT z.symbol, z.ts, z.ret, coalesce(abs(ret)>0.5,false) AS jump, coalesce(abs(ret-m)>3*s,false) AS sigma3, coalesce(abs(z)>4,false) AS rolling_z, coalesce(abs(ret)>q,false) AS spike,
          coalesce(abs(ret-md)/nullif(mad*1.4826,0)>5,false) AS robust FROM z JOIN a ON z.symbol=a.symbol JOIN d ON z.symbol=d.symbol)
        SELECT symbol, ts, round(ret,8) AS ret, jump, sigma3, rolling_z, spike, robust FROM f WHERE jump OR sigma3 OR rolling_z OR spike OR robust""",
)
def _(spark, sf):
    return rounded(Q.price_outliers(b1(spark, sf)), 8)


@query(
    "volume_outliers",
    f"""WITH z AS (SELECT symbol, ts, volume, (volume-{mean('volume', 20)})/nullif({std('volume', 20)},0) AS z FROM dirty),
        q AS (SELECT symbol, quantile_cont(volume,0.25) AS q1, quantile_cont(volume,0.75) AS q3 FROM dirty GROUP BY 1),
        f AS (SELECT z.symbol, ts, volume, volume=0 AS zero, coalesce(z>3,false) AS rolling_z, volume>q3+3*(q3-q1) OR volume<q1-3*(q3-q1) AS fence FROM z JOIN q ON z.symbol=q.symbol)
        SELECT * FROM f WHERE zero OR rolling_z OR fence""",
)
def _(spark, sf):
    return Q.volume_outliers(dirty(spark, sf))


@query(
    "validity",
    """SELECT symbol, round(avg((open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL)::INT),6) AS finite_share,
       round(avg((coalesce(open>0,false) AND coalesce(high>0,false) AND coalesce(low>0,false) AND coalesce(close>0,false))::INT),6) AS positive_share,
       round(avg((ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-28')::INT),6) AS in_range_share FROM dirty GROUP BY 1""",
)
def _(spark, sf):
    return rounded(Q.validity(dirty(spark, sf), "2024-01-02", "2024-01-28").drop("decimals_share"))


@query(
    "consistency_ks",
    """WITH n AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) <= count(*) OVER (PARTITION BY symbol)//2 AS first FROM rets WHERE ret IS NOT NULL),
       c AS (SELECT symbol, ret, sum(first::INT) OVER (PARTITION BY symbol ORDER BY ret) AS a, sum((NOT first)::INT) OVER (PARTITION BY symbol ORDER BY ret) AS b, sum(first::INT) OVER (PARTITION BY symbol) AS na,
         sum((NOT first)::INT) OVER (PARTITION BY symbol) AS nb FROM n)
       SELECT symbol, max(na)::BIGINT AS n_a, max(nb)::BIGINT AS n_b, round(max(abs(a/na-b/nb)),8) AS ks FROM c GROUP BY 1""",
)
def _(spark, sf):
    from tidemark.operators.frames import with_row_number
    from tidemark.operators.order_stats import join_stats
    from tidemark.operators.validation import ks_statistic

    r = with_returns(b1(spark, sf)).where("ret IS NOT NULL")
    n = r.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    d = join_stats(with_row_number(r, out="_i"), n, ["symbol"])
    d = d.withColumn("first", F.col("_i") <= F.floor(F.col("_n") / 2))
    return rounded(ks_statistic(d, F.col("ret"), F.col("first"), ["symbol"]).drop("p_value"), 8)


@query(
    "shadow_extremes",
    """WITH r AS (SELECT b.*, t.ret, greatest(high-greatest(open,b.close), least(open,b.close)-low) > 10*abs(b.close-open) AS sh FROM bars b JOIN rets t ON b.symbol=t.symbol AND b.ts=t.ts),
       a AS (SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS s FROM r GROUP BY 1), x AS (SELECT r.symbol, avg(sh::INT) AS ss, avg((abs(ret-m)>3*s)::INT) AS s3 FROM r JOIN a ON r.symbol=a.symbol GROUP BY 1),
       i AS (SELECT symbol, ts, sum(ch) OVER (PARTITION BY symbol ORDER BY ts) AS isl FROM (SELECT symbol, ts, (close IS DISTINCT FROM lag(close) OVER (PARTITION BY symbol ORDER BY ts))::INT AS ch FROM bars)),
       l AS (SELECT symbol, max(n) AS longest_run FROM (SELECT symbol, isl, count(*) AS n FROM i GROUP BY 1,2) GROUP BY 1)
       SELECT x.symbol, round(ss,6) AS shadow_share, round(s3,6) AS sigma3_share, longest_run, round(greatest(0,1-ss-s3-CASE WHEN longest_run>5 THEN 0.1 ELSE 0 END),6) AS score FROM x JOIN l ON x.symbol=l.symbol""",
)
def _(spark, sf):
    return rounded(Q.shadow_extremes(bars(spark, sf)))


@query(
    "freshness_latency",
    """SELECT symbol, max(ts) AS last_ts, 1706655600-epoch(max(ts))::BIGINT AS age_seconds, round(greatest(0,1-(1706655600-epoch(max(ts))::BIGINT)/7200.0),6) AS freshness FROM bars GROUP BY 1""",
)
def _(spark, sf):
    return rounded(Q.freshness(bars(spark, sf), "2024-01-30 23:00:00", horizon_seconds=7200.0))


@query(
    "quality_score_status",
    f"""WITH {_RULES}, a AS (SELECT symbol, count(*)/((epoch(max(ts))::BIGINT-epoch(min(ts))::BIGINT)//3600+1) AS density, count(close)/count(*) AS cs FROM dirty GROUP BY 1), b AS (SELECT symbol, avg((h AND l AND p AND v)::INT) AS ok FROM r GROUP BY 1),
        s AS (SELECT a.symbol, (0.4*density+0.3*cs+0.3*ok)/(0.4+0.3+0.3) AS score FROM a JOIN b ON a.symbol=b.symbol)
        SELECT symbol, round(score,6) AS score, CASE WHEN score>=0.95 THEN 'A' WHEN score>=0.9 THEN 'B' WHEN score>=0.8 THEN 'C' WHEN score>=0.7 THEN 'D' ELSE 'F' END AS grade FROM s""",
)
def _(spark, sf):
    d = dirty(spark, sf)
    parts = Q.completeness(d, 3600, ["close"]).join(Q.ohlc_consistency(d).select("symbol", "valid_share"), "symbol")
    return rounded(Q.quality_score(parts, {"density": 0.4, "close_share": 0.3, "valid_share": 0.3}).select("symbol", "score", "grade"))


@query(
    "feature_profile",
    """WITH f AS (SELECT unnest(['close','volume','ret']) AS feature, unnest([close,volume,ret]) AS v FROM rets)
       SELECT feature, count(v) AS n, round(avg(v),6) AS mean, round(stddev_samp(v),6) AS std, round(min(v),6) AS low, round(max(v),6) AS high, round(skewness(v),6) AS skewness, round(kurtosis(v),6) AS kurtosis, round(avg((v=0)::INT),6) AS zero_share FROM f GROUP BY 1""",
)
def _(spark, sf):
    return rounded(Q.feature_profile(with_returns(b1(spark, sf, "close", "volume")), ["close", "volume", "ret"]))


@query(
    "missing_and_inf_report",
    """WITH f AS (SELECT unnest(['close','high','volume']) AS feature, unnest([close,high,volume]) AS v FROM dirty), q AS (SELECT feature, quantile_cont(v,0.25) AS q1, quantile_cont(v,0.75) AS q3 FROM f GROUP BY 1)
       SELECT f.feature, count(*) AS rows, round(count_if(v IS NULL)*100.0/count(*),6) AS missing_pct, 0::BIGINT AS infinite, round(count_if(v>q3+3*(q3-q1) OR v<q1-3*(q3-q1))*100.0/count(*),6) AS outlier_pct FROM f JOIN q ON f.feature=q.feature GROUP BY 1""",
)
def _(spark, sf):
    return rounded(Q.missing_report(dirty(spark, sf), ["close", "high", "volume"]))


@query(
    "clip_quantile",
    """WITH q AS (SELECT l_returnflag AS k, quantile_cont(l_extendedprice,0.01) AS lo, quantile_cont(l_extendedprice,0.99) AS hi FROM lineitem GROUP BY 1)
       SELECT l_orderkey, l_returnflag, round(greatest(lo,least(l_extendedprice,hi)),4) AS clipped FROM lineitem JOIN q ON l_returnflag=k""",
)
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_extendedprice").alias("clipped"))
    return rounded(Q.clip_quantile(d, ["clipped"], 0.01, 0.99, ["l_returnflag"]), 4)


@query(
    "clip_sigma",
    """WITH f AS (SELECT symbol, ts, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts),0) AS c FROM dirty), s AS (SELECT symbol, avg(c) AS m, stddev_samp(c) AS s FROM f GROUP BY 1)
       SELECT f.symbol, ts, round(greatest(m-1.5*s,least(c,m+1.5*s)),6) AS close FROM f JOIN s ON f.symbol=s.symbol""",
)
def _(spark, sf):
    return rounded(Q.clip_sigma(dirty(spark, sf).select("symbol", "ts", "close"), ["close"], 1.5))


@query(
    "null_policy",
    f"""WITH r AS (SELECT symbol, ts, rsi FROM rsi14), f AS (SELECT symbol, ts, last_value(rsi IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS f FROM r), m AS (SELECT symbol, quantile_cont(rsi,0.5) AS m FROM r GROUP BY 1)
        SELECT f.symbol, ts, round(coalesce(f,m),6) AS rsi FROM f JOIN m ON f.symbol=m.symbol""",
)
def _(spark, sf):
    return rounded(N.null_policy(rsi(b1(spark, sf)).select("symbol", "ts", "rsi"), ["rsi"]))


@query(
    "math_scalars",
    """SELECT l_orderkey, round(ln(l_extendedprice),8) AS log_price, round(sqrt(l_extendedprice),6) AS root, round(exp(-l_discount),8) AS decay, round(pow(1+l_tax,3),8) AS grown, sign(l_discount-l_tax)::DOUBLE AS sgn,
       greatest(10,least(l_quantity,40)) AS clipped, abs(l_discount-0.05)>0.03 AS far FROM lineitem""",
)
def _(spark, sf):
    d = table(spark, sf, "lineitem").select(
        "l_orderkey", F.log("l_extendedprice").alias("log_price"), F.round(F.sqrt("l_extendedprice"), 6).alias("root"),
        F.exp(-F.col("l_discount")).alias("decay"), F.pow(F.col("l_tax") + 1, F.lit(3.0)).alias("grown"),
        F.signum(F.col("l_discount") - F.col("l_tax")).alias("sgn"), F.greatest(F.lit(10.0), F.least("l_quantity", F.lit(40.0))).alias("clipped"),
        (F.abs(F.col("l_discount") - 0.05) > 0.03).alias("far"),
    )
    return rounded(d, 8)


@query(
    "safe_divide",
    """SELECT l_orderkey, round(l_discount/nullif(l_tax,0),6) AS plain, round(l_discount/(l_tax+1e-8),2) AS damped, round(CASE WHEN l_tax>0 THEN l_discount/l_tax ELSE 0 END,6) AS or_zero FROM lineitem""",
)
def _(spark, sf):
    from tidemark.functions.core import div, div_eps, div_or_zero

    d = table(spark, sf, "lineitem").select(
        "l_orderkey", div("l_discount", "l_tax").alias("plain"), F.round(div_eps("l_discount", "l_tax"), 2).alias("damped"),
        div_or_zero("l_discount", "l_tax").alias("or_zero"),
    )
    return rounded(d)


@query(
    "date_scalars",
    """SELECT event_id, date_trunc('hour',ts) AS h, date_trunc('day',ts) AS d, date_trunc('week',ts) AS w, date_trunc('month',ts) AS m, time_bucket(INTERVAL 15 MINUTE, ts) AS q, hour(ts) AS hour, minute(ts) AS minute,
       (dayofweek(ts)+6) % 7 AS dow, epoch_us(ts) AS us FROM events""",
)
def _(spark, sf):
    from tidemark.functions.core import epoch_us, floor_ts, period_start

    e = table(spark, sf, "events")
    return e.select(
        "event_id", *[period_start("ts", u).alias(u[0]) for u in ("hour", "day", "week", "month")], floor_ts("ts", 900).alias("q"),
        F.hour("ts").alias("hour"), F.minute("ts").alias("minute"), F.weekday("ts").alias("dow"), epoch_us("ts").alias("us"),
    )


@query(
    "string_scalars",
    """SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, split_part(p_brand,'#',2) AS brand_no, contains(lower(p_name),'red') AS is_red, p_brand||'_'||p_type AS joined, regexp_extract(p_name,'^(\\w+)',1) AS first_word FROM part""",
)
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand_no"),
        F.lower("p_name").contains("red").alias("is_red"), F.concat_ws("_", "p_brand", "p_type").alias("joined"), F.regexp_extract("p_name", r"^(\w+)", 1).alias("first_word"),
    )


@query(
    "json_fields",
    """SELECT event_id, CAST(json_extract_string(props,'$.k') AS INT) AS k, json_extract_string(to_json({'id': event_id, 'kind': event_type}),'$.kind') AS kind FROM events""",
)
def _(spark, sf):
    packed = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    back = F.from_json(packed, "id BIGINT, kind STRING")
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k INT").k.alias("k"), back.kind.alias("kind"))


@query(
    "array_map_scalars",
    """SELECT vec_id, label, round(list_sum(list_transform(embedding[1:10], lambda x: x::DOUBLE)),6) AS depth_10, len(embedding) AS levels, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))),6) AS top,
       len(list_filter(embedding, lambda x: x>0)) AS positive FROM embeddings""",
)
def _(spark, sf):
    v = F.col("embedding")
    d = table(spark, sf, "embeddings").select(
        "vec_id", "label", F.aggregate(F.slice(v, 1, 10), F.lit(0.0), lambda a, x: a + x.cast("double")).alias("depth_10"),
        F.size(v).alias("levels"), F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))).alias("top"), F.size(F.filter(v, lambda x: x > 0)).alias("positive"),
    )
    return rounded(d)


__all__ = ["EPS", "pct"]
