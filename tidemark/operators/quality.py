"""Data-quality rules, gaps, outliers and scores for bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import div, epoch_s, epoch_us, finite, ladder
from tidemark.operators.frames import CHUNK, framed, islands, prefix, stored_chunk, tidy
from tidemark.operators.order_stats import exact_quantiles, join_stats
from tidemark.operators.plugins import run_detectors
from tidemark.operators.series import with_returns
from tidemark.session import settle
from tidemark.sources.scan import as_ts

PRICES = ("open", "high", "low", "close")


def with_gap(df: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Add the previous timestamp and the seconds since it."""
    d = tidy(prefix(df, {"prev_ts": ("last", F.col(ts))}, keys, [ts], upto=-1), df)
    return d.withColumn("gap", (epoch_us(ts) - epoch_us("prev_ts")) / 1e6)


def gap_stats(df: DataFrame, keys: Sequence[str] = ("symbol",), factor: float = 3.0) -> DataFrame:
    """Mean and median time between rows and the number of gaps above ``factor`` medians."""
    g = with_gap(df, keys)
    med = exact_quantiles(g, F.col("gap"), {"median_gap": 0.5}, keys)
    return (
        join_stats(g, med, keys)
        .groupBy(*keys)
        .agg(
            F.avg("gap").alias("mean_gap"),
            F.max("median_gap").alias("median_gap"),
            F.count_if(F.col("gap") > F.col("median_gap") * factor).alias("long_gaps"),
        )
    )


def time_gaps(df: DataFrame, seconds: int, tolerance: float = 0.0, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Gaps longer than interval + tolerance: start, end, missing bars."""
    g = with_gap(df, keys).where(F.col("gap") > seconds + tolerance)
    missing = F.floor(F.col("gap") / seconds) - 1
    return g.select(*keys, F.col("prev_ts").alias("gap_start"), F.col("ts").alias("gap_end"), missing.alias("missing"))


def completeness(df: DataFrame, seconds: int, cols: Sequence[str] = (*PRICES, "volume"), keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Non-null share per column, and rows against the rows the time span should hold."""
    n = F.count(F.lit(1))
    expected = F.floor((F.max(epoch_s("ts")) - F.min(epoch_s("ts"))) / seconds) + 1
    return df.groupBy(*keys).agg(
        n.alias("rows"),
        expected.alias("expected"),
        (n / expected).alias("density"),
        *[(F.count(c) / n).alias(f"{c}_share") for c in cols],
    )


def ohlc_rules() -> dict[str, Column]:
    """Rules a bar must satisfy; null values fail none."""
    return {
        "high_ok": F.col("high") >= F.greatest("open", "close", "low"),
        "low_ok": F.col("low") <= F.least("open", "close"),
        "positive_ok": F.least(*PRICES) > 0,
        "volume_ok": F.col("volume") >= 0,
    }


def ohlc_consistency(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Share of rows passing each rule and all rules."""
    rules = ohlc_rules()
    d = df.withColumns({k: F.coalesce(v, F.lit(True)) for k, v in rules.items()})
    every = F.lit(True)
    for k in rules:
        every = every & F.col(k)
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(F.col(k).cast("double")).alias(k) for k in rules],
        F.avg(every.cast("double")).alias("valid_share"),
    )


def ohlc_violations(df: DataFrame) -> DataFrame:
    """Rows breaking a rule, with the names of the rules broken."""
    broken = F.array_compact(F.array(*[F.when(~v, F.lit(k)) for k, v in ohlc_rules().items()]))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def price_outliers(df: DataFrame, window: int = 20, z_limit: float = 4.0, jump: float = 0.5, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows flagged by jump size, distance from the mean return (3 deviations), rolling z of the close, or the
    99 % quantile of absolute returns; plus a robust z over return and range in place of a tree ensemble."""

    def build(d, fr):
        d = d.withColumn("ret", fr.pct("close"))
        z = (F.col("close") - fr.mean("close", window)) / F.when(fr.std("close", window) > 0, fr.std("close", window))
        return d.withColumn("z", z)

    d = settle(framed(df, build, before=window, keys=keys).select(*keys, "ts", "ret", "z"))  # read five times
    stats = d.groupBy(*keys).agg(F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"))
    q = exact_quantiles(d, F.abs("ret"), {"_q99": 0.99}, keys)
    med = settle(exact_quantiles(d, F.col("ret"), {"_med": 0.5}, keys))
    centred = F.abs(F.col("ret") - F.col("_med"))
    mad = exact_quantiles(join_stats(d, med, keys), centred, {"_mad": 0.5}, keys)
    for s in (stats, q, med, mad):
        d = join_stats(d, s, keys)
    robust = F.abs(F.col("ret") - F.col("_med")) / F.when(F.col("_mad") > 0, F.col("_mad") * 1.4826)
    flags = {
        "jump": F.abs("ret") > jump,
        "sigma3": F.abs(F.col("ret") - F.col("_m")) > F.col("_s") * 3,
        "rolling_z": F.abs("z") > z_limit,
        "spike": F.abs("ret") > F.col("_q99"),
        "robust": robust > 5.0,
    }
    d = d.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    return d.where(F.col("jump") | F.col("sigma3") | F.col("rolling_z") | F.col("spike") | F.col("robust")).select(
        *keys, "ts", "ret", *flags
    )


def volume_outliers(df: DataFrame, window: int = 20, z_limit: float = 3.0, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows with zero volume, rolling z above the limit, or outside 3 interquartile ranges."""

    def build(d, fr):
        s = fr.std("volume", window)
        return d.withColumn("z", (F.col("volume") - fr.mean("volume", window)) / F.when(s > 0, s))

    d = framed(df, build, before=window, keys=keys)
    q = exact_quantiles(d, F.col("volume"), {"_q1": 0.25, "_q3": 0.75}, keys)
    d = join_stats(d, q, keys)
    iqr = F.col("_q3") - F.col("_q1")
    flags = {
        "zero": F.col("volume") == 0,
        "rolling_z": F.col("z") > z_limit,
        "fence": (F.col("volume") > F.col("_q3") + iqr * 3) | (F.col("volume") < F.col("_q1") - iqr * 3),
    }
    d = d.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    return d.where(F.col("zero") | F.col("rolling_z") | F.col("fence")).select(*keys, "ts", "volume", *flags)


def validity(df: DataFrame, start: str, end: str, cols: Sequence[str] = (*PRICES, "volume"), max_decimals: int = 8, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Shares of finite and positive values, timestamps in range, and prices with few decimals."""
    finite_all = F.lit(1.0)
    positive = F.lit(1.0)
    for c in cols:
        finite_all = finite_all * finite(c).isNotNull().cast("double")
        if c != "volume":
            positive = positive * F.coalesce(F.col(c) > 0, F.lit(False)).cast("double")
    scaled = F.col("close") * 10**max_decimals
    return df.groupBy(*keys).agg(
        F.avg(finite_all).alias("finite_share"),
        F.avg(positive).alias("positive_share"),
        F.avg(F.col("ts").between(as_ts(start), as_ts(end)).cast("double")).alias("in_range_share"),
        F.avg((F.abs(scaled - F.round(scaled)) < 1e-3).cast("double")).alias("decimals_share"),
    )


def freshness(df: DataFrame, as_of: str, keys: Sequence[str] = ("symbol",), horizon_seconds: float = 3600.0) -> DataFrame:
    """Age of the newest row in seconds and freshness = 1 - age / horizon, not below 0."""
    age = epoch_s(as_ts(as_of)) - F.max(epoch_s("ts"))
    return df.groupBy(*keys).agg(
        F.max("ts").alias("last_ts"),
        age.alias("age_seconds"),
        F.greatest(F.lit(0.0), 1.0 - age / horizon_seconds).alias("freshness"),
    )


def longest_runs(df: DataFrame, x: str = "close", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Length of the longest run of an unchanged value."""
    runs = islands(df.select(*keys, "ts", x, *stored_chunk(df)), x, keys).groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest_run"))


def shadow_extremes(df: DataFrame, ratio: float = 10.0, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Share of bars with a shadow above ``ratio`` bodies, longest frozen run, share of 3-sigma returns, score."""
    d = framed(df, lambda x, fr: x.withColumn("ret", fr.pct("close")), before=1, keys=keys)
    body = F.abs(F.col("close") - F.col("open"))
    shadow = F.greatest(
        F.col("high") - F.greatest("open", "close"), F.least("open", "close") - F.col("low")
    )
    stats = d.groupBy(*keys).agg(F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"))
    out = (
        join_stats(d, stats, keys)
        .groupBy(*keys)
        .agg(
            F.avg((shadow > body * ratio).cast("double")).alias("shadow_share"),
            F.avg((F.abs(F.col("ret") - F.col("_m")) > F.col("_s") * 3).cast("double")).alias("sigma3_share"),
        )
    )
    out = join_stats(out, longest_runs(df, keys=keys), keys)
    frozen = F.when(F.col("longest_run") > 5, 0.1).otherwise(0.0)
    score = F.greatest(F.lit(0.0), 1.0 - F.col("shadow_share") - F.col("sigma3_share") - frozen)
    return out.withColumn("score", score)


def frozen_rows(df: DataFrame, x: str = "close", rows: int = 5, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """Rows at which ``x`` has not changed for ``rows`` rows."""

    def build(d, fr):
        d = d.withColumn("_still", (F.col(x) == fr.lag(x)).cast("int"))
        return d.withColumn("_still", F.sum("_still").over(fr.back(rows)))

    return framed(df, build, before=rows, keys=keys, order=order).where(F.col("_still") == rows).drop("_still")


def anomalies(df: DataFrame, floor: float = 0.10, window: int = 20, z_limit: float = 3.0, factor: float = 3.0, frozen: int = 5, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Findings on bars: price spikes, volumes far from the trailing mean on either side, time gaps, frozen prices.

    There is no least number of rows a symbol must have.
    """
    keys = list(keys)
    b = settle(with_returns(df, keys=keys))

    def spike(d):
        s = exact_quantiles(d, F.abs("ret"), {"_q": 0.99}, keys)
        return join_stats(d, s, keys).where(F.abs("ret") > F.greatest("_q", F.lit(floor)))

    def volume(d):
        def build(x, fr):
            s = fr.std("volume", window)
            return x.withColumn("_z", (F.col("volume") - fr.mean("volume", window)) / F.when(s > 0, s))

        return framed(d, build, before=window, keys=keys).where(F.abs("_z") > z_limit)

    def gap(d):
        g = with_gap(d, keys)
        m = exact_quantiles(g, F.col("gap"), {"_m": 0.5}, keys)
        return join_stats(g, m, keys).where(F.col("gap") > F.col("_m") * factor)

    return run_detectors(b, {"spike": spike, "volume": volume, "gap": gap, "frozen": lambda d: frozen_rows(d, rows=frozen, keys=keys)}, [*keys, "ts"])


def trailing_anomalies(
    df: DataFrame, n: int = 100, floor: float = 0.10, window: int = 20, z_limit: float = 3.0, factor: float = 3.0, frozen: int = 5, min_rows: int = 20,
    keys: Sequence[str] = ("name",), order: Sequence[str] = ("ts", "event_id"), chunk=None,
) -> DataFrame:
    """The four detectors on the last n rows of each key (``price``, ``volume``), row by row; twin of the keyed stream form.

    One row per finding, ``detector`` 0 to 3: spike, volume, gap, frozen price.
    """

    def build(d, fr):
        at = F.unix_micros(F.col(order[0]).cast("timestamp"))
        d = d.withColumns({"_ret": F.abs(fr.pct("price")), "_gap": (at - F.lag(at).over(fr.seq)) / 1e6, "_same": (F.col("price") == fr.lag("price")).cast("int")})
        spread = fr.std("volume", window)
        spike = (F.col("_rn") >= min_rows) & (F.col("_ret") > F.greatest(F.percentile("_ret", F.lit(0.99)).over(fr.back(n)), F.lit(floor)))
        odd = F.abs((F.col("volume") - fr.mean("volume", window)) / F.when(spread > 0, spread)) > z_limit
        hole = (F.col("_rn") >= frozen) & (F.col("_gap") > F.percentile("_gap", F.lit(0.5)).over(fr.back(n)) * factor)
        still = F.sum("_same").over(fr.back(frozen)) >= frozen
        hits = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate((spike, odd, hole, still))]))
        return d.withColumn("_hits", hits).drop("_ret", "_gap", "_same")

    d = framed(df, build, before=n + 1, keys=keys, order=order, chunk=chunk)
    return d.select(*keys, *order, F.explode("_hits").alias("detector"))


def quality_score(parts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted score of share columns (0..1) and a grade."""
    total = sum(weights.values())
    score = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)) / total
    grade = ladder("score", [(0.95, "A"), (0.9, "B"), (0.8, "C"), (0.7, "D")], "F")
    return parts.withColumn("score", score).withColumn("grade", grade)


def long_form(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, column): keep columns, ``feature``, ``value``."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(*keep, F.inline(cells))


def feature_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Moments and zero share of every feature column in one pass."""
    from tidemark.functions.core import sample_kurtosis, sample_skewness

    v = F.col("value")
    return long_form(df, cols).groupBy("feature").agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        sample_skewness("value").alias("skewness"),
        sample_kurtosis("value").alias("kurtosis"),
        F.avg((v == 0).cast("double")).alias("zero_share"),
    )


def missing_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls, infinities and values outside 3 interquartile ranges by column."""
    long = long_form(df, cols)
    q = exact_quantiles(long.withColumn("value", finite("value")), F.col("value"), {"_q1": 0.25, "_q3": 0.75}, ["feature"])
    d = join_stats(long, q, ["feature"])
    iqr = F.col("_q3") - F.col("_q1")
    out_of = (F.col("value") > F.col("_q3") + iqr * 3) | (F.col("value") < F.col("_q1") - iqr * 3)
    n = F.count(F.lit(1))
    return d.groupBy("feature").agg(
        n.alias("rows"),
        (F.count_if(F.col("value").isNull() | F.isnan("value")) * 100.0 / n).alias("missing_pct"),
        F.count_if(F.abs("value") == float("inf")).alias("infinite"),
        (F.count_if(out_of) * 100.0 / n).alias("outlier_pct"),
    )


def clip_quantile(df: DataFrame, cols: Sequence[str], lo: float, hi: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Clip each column to its own global quantiles (of the whole history, so it looks ahead); one pass for all columns."""
    keys = list(keys)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v")) for c in cols]))
    long = df.select(*keys, each.alias("_x")).select(*keys, F.col("_x.f").alias("_f"), F.col("_x.v").alias("_v"))
    q = exact_quantiles(long, F.col("_v"), {"_lo": lo, "_hi": hi}, [*keys, "_f"])
    wide = [F.max(F.when(F.col("_f") == c, F.col(side))).alias(f"{side}_{c}") for c in cols for side in ("_lo", "_hi")]
    d = join_stats(df, q.groupBy(*keys).agg(*wide), keys)
    return d.withColumns({c: F.greatest(f"_lo_{c}", F.least(c, f"_hi_{c}")) for c in cols}).select(*df.columns)


def clip_sigma(df: DataFrame, cols: Sequence[str], sigmas: float = 5.0, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """Infinite to null, forward fill, 0 for what is left, then clip to mean +- sigmas deviations."""
    d = df.withColumns({c: finite(c) for c in cols})
    d = prefix(d, {f"_f_{c}": ("last", F.col(c)) for c in cols}, keys, order).drop(CHUNK)
    d = d.withColumns({c: F.coalesce(F.col(f"_f_{c}"), F.lit(0.0)) for c in cols}).drop(*[f"_f_{c}" for c in cols])
    aggs = [f(c).alias(n + c) for c in cols for f, n in ((F.avg, "_m_"), (F.stddev_samp, "_s_"))]
    d = join_stats(d, d.groupBy(*keys).agg(*aggs), keys)
    clipped = {
        c: F.greatest(
            F.col(f"_m_{c}") - F.col(f"_s_{c}") * sigmas, F.least(c, F.col(f"_m_{c}") + F.col(f"_s_{c}") * sigmas)
        )
        for c in cols
    }
    return d.withColumns(clipped).drop(*[n + c for c in cols for n in ("_m_", "_s_")])
