"""Generic window operators on one series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import EPS, div
from tidemark.operators.frames import CHUNK, framed, islands, prefix, tidy, with_row_number
from tidemark.operators.indicators import percent_of_frame
from tidemark.operators.order_stats import exact_quantiles, join_stats
from tidemark.session import settle

KEYS = ("symbol",)


def rolling_basic(df: DataFrame, x: str, n: int, min_rows: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    def build(d, fr):
        return d.withColumns(
            {
                "mean": fr.mean(x, n, min_rows),
                "std": fr.std(x, n, min_rows),
                "total": fr.sum(x, n, min_rows),
                "low": fr.min(x, n, min_rows),
                "high": fr.max(x, n, min_rows),
            }
        )

    return framed(df, build, before=n, keys=keys)


def rolling_quantiles(df: DataFrame, x: str, n: int, probs: dict[str, float], keys: Sequence[str] = KEYS) -> DataFrame:
    return framed(
        df, lambda d, fr: d.withColumns({name: fr.quantile(x, q, n) for name, q in probs.items()}), before=n, keys=keys
    )


def rolling_pair(df: DataFrame, x: str, y: str, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rolling correlation, covariance and beta of x on y; rows where either is null do not count."""

    def build(d, fr):
        both = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)
        w = fr.back(n)
        enough = F.count(both).over(w) >= n
        var = F.var_samp(F.when(both == 1, F.col(y))).over(w)
        cov = F.covar_samp(x, y).over(w)
        return d.withColumns(
            {
                "corr": F.when(enough, F.corr(x, y).over(w)),
                "cov": F.when(enough, cov),
                "beta": F.when(enough, cov / F.when(var != 0, var)),
            }
        )

    return framed(df, build, before=n, keys=keys)


def rolling_shape(df: DataFrame, x: str, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rolling bias-corrected skewness and biased (population) excess kurtosis."""

    def build(d, fr):
        skew = fr.full(F.skewness(x), n, x) * (n * (n - 1.0)) ** 0.5 / (n - 2.0)
        return d.withColumns({"skewness": skew, "kurtosis": fr.full(F.kurtosis(x), n, x)})

    return framed(df, build, before=n, keys=keys)


def rolling_trend(df: DataFrame, x: str, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rolling slope on the row number, correlation with it, lag-1 autocorrelation and its half-life in rows."""

    def build(d, fr):
        d = d.withColumns({"_i": F.col("_rn").cast("double"), "_p": fr.lag(x)})
        w = fr.back(n)
        d = d.withColumns(
            {
                "slope": fr.full(F.regr_slope(F.col(x), F.col("_i")), n, x),
                "trend_corr": fr.full(F.corr(x, "_i"), n, x),
                "autocorr": F.when(F.count("_p").over(w) >= n, F.corr(x, "_p").over(w)),
            }
        )
        a = F.col("autocorr")
        return d.withColumn("half_life", F.when((a > 0) & (a < 1), F.lit(-0.6931471805599453) / F.log(a))).drop("_i", "_p")

    return framed(df, build, before=n + 1, keys=keys)


def rolling_levels(df: DataFrame, n: int, near: float = 0.01, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rolling support and resistance and whether the close is near them."""

    def build(d, fr):
        d = d.withColumns({"support": fr.min("low", n), "resistance": fr.max("high", n)})
        return d.withColumns(
            {
                "near_support": F.col("close") <= F.col("support") * (1 + near),
                "near_resistance": F.col("close") >= F.col("resistance") * (1 - near),
            }
        )

    return framed(df, build, before=n, keys=keys)


def lag_changes(df: DataFrame, x: str, lags: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """Shifted values, relative changes and the second difference."""

    def build(d, fr):
        d = d.withColumns({f"lag_{k}": fr.lag(x, k) for k in lags})
        d = d.withColumns({f"chg_{k}": div(F.col(x), f"lag_{k}") - 1 for k in lags})
        return d.withColumn("diff2", F.col(x) - fr.lag(x) * 2 + fr.lag(x, 2))

    return framed(df, build, before=max([*lags, 2]), keys=keys)


def forward_values(df: DataFrame, x: str, leads: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    return framed(
        df, lambda d, fr: d.withColumns({f"lead_{k}": fr.lead(x, k) for k in leads}), before=0, after=max(leads), keys=keys
    )


def running_totals(df: DataFrame, aggs: dict[str, Column], keys: Sequence[str] = KEYS, order: Sequence[str] = ("ts",), chunk: Column | None = None) -> DataFrame:
    return tidy(prefix(df, {k: ("sum", v) for k, v in aggs.items()}, keys, order, chunk), df)


def drawdowns(df: DataFrame, x: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ("ts",), floor_zero: bool = False, chunk: Column | None = None) -> DataFrame:
    """Running peak and distance below it, absolute and relative; ``floor_zero`` starts the peak at 0."""
    d = tidy(prefix(df, {"peak": ("max", F.col(x))}, keys, order, chunk), df)
    if floor_zero:
        d = d.withColumn("peak", F.greatest(F.lit(0.0), "peak"))
    return d.withColumns({"drawdown": F.col(x) - F.col("peak"), "drawdown_pct": div(F.col(x) - F.col("peak"), "peak")})


def drawdown_episodes(df: DataFrame, x: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ("ts",), chunk: Column | None = None) -> DataFrame:
    """One row per spell below the running peak: start, end, deepest point, rows, recovered or not."""
    d = prefix(df, {"peak": ("max", F.col(x))}, keys, order, chunk)
    below = F.col(x) < F.col("peak")
    d = d.withColumns({"_at_peak": (~below).cast("int"), "_below": below})
    d = prefix(d, {"episode": ("sum", F.col("_at_peak"))}, keys, order)
    e = (
        d.where("_below")
        .groupBy(*keys, "episode")
        .agg(
            F.min(order[0]).alias("start_ts"),
            F.max(order[0]).alias("end_ts"),
            F.min(F.col(x) - F.col("peak")).alias("depth"),
            F.count(F.lit(1)).alias("rows"),
        )
    )
    last = df.groupBy(*keys).agg(F.max(order[0]).alias("_last"))
    return join_stats(e, last, keys).withColumn("recovered", F.col("end_ts") < F.col("_last")).drop("_last")


def runs(df: DataFrame, state: str | Column, keys: Sequence[str] = KEYS, order: Sequence[str] = ("ts",), chunk: Column | None = None) -> DataFrame:
    """Run number and position in the run for every row."""
    d = islands(df, state, keys, order, chunk, keep_chunk=True)
    return tidy(prefix(d, {"run_position": ("count", F.lit(1))}, [*keys, "island"], order), df)


def regimes_ma_vol(df: DataFrame, fast: int = 20, slow: int = 50, q: float = 0.7, keys: Sequence[str] = KEYS) -> DataFrame:
    """Four regimes: moving-average cross by volatility above its whole-history quantile (looks ahead)."""

    def build(d, fr):
        d = d.withColumns({"_f": fr.mean("close", fast), "_s": fr.mean("close", slow), "_ret": fr.pct("close")})
        return d.withColumn("vol", fr.std("_ret", fast))

    d = settle(framed(df, build, before=max(slow, fast + 1), keys=keys))  # read for the quantile and for the rows
    d = join_stats(d, exact_quantiles(d, F.col("vol"), {"_q": q}, keys), keys)
    up, high = F.col("_f") > F.col("_s"), F.col("vol") > F.col("_q") * (1 + 1e-12)  # equal up to rounding is not above
    regime = F.when(
        F.col("_s").isNotNull() & F.col("vol").isNotNull(),
        F.concat(F.when(up, "up").otherwise("down"), F.when(high, "_volatile").otherwise("_calm")),
    )
    return d.withColumn("regime", regime).drop("_f", "_s", "_ret", "_q")


def regime_changes(df: DataFrame, state: str = "regime", keys: Sequence[str] = KEYS, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Rows where the state differs from the row before, with both states."""
    d = prefix(df.where(F.col(state).isNotNull()), {"previous": ("last", F.col(state))}, keys, order, upto=-1).drop(CHUNK)
    return d.where(F.col(state) != F.col("previous")).select(*keys, *order, "previous", state)


def frame_share(df: DataFrame, state: str, n: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of the last n rows in the current state, distinct states there, and whether the last three differ pairwise."""

    def build(d, fr):
        cur = F.col(state)
        seen = F.collect_list(state).over(fr.back(n))
        a, b = fr.lag(state), fr.lag(state, 2)
        return d.withColumns(
            {
                "share": F.size(F.filter(seen, lambda s: s == cur)) / F.size(seen),
                "distinct_states": F.size(F.array_distinct(seen)),
                "back_and_forth": F.coalesce((cur == b) & (cur != a), F.lit(False)),
            }
        )

    return framed(df, build, before=n, keys=keys)


def rolling_zscore(df: DataFrame, x: str, n: int = 200, min_rows: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    """(x - rolling mean) / (rolling deviation + 1e-8)."""

    def build(d, fr):
        return d.withColumn("z", (F.col(x) - fr.mean(x, n, min_rows)) / (fr.std(x, n, min_rows) + F.lit(EPS)))

    return framed(df, build, before=n, keys=keys)


def rolling_percent_rank(df: DataFrame, x: str, n: int = 100, keys: Sequence[str] = KEYS) -> DataFrame:
    def build(d, fr):
        return d.withColumn("pct_rank", F.when(F.count(x).over(fr.back(n)) >= n, percent_of_frame(fr, x, n)))

    return framed(df, build, before=n, keys=keys)


def history_counts(df: DataFrame, x: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ("ts",), block: int = 512) -> DataFrame:
    """Rows with a value, their number from 0 (``_row``), and how many values up to here are smaller (``_below``) and not larger (``_upto``, itself included).

    Smaller and equal earlier values are counted in blocks that double: inside
    a block of ``block`` rows directly, then for the right half of each pair of
    blocks by ranks in the left half. Each doubling is one pass over
    distributed counts, so no task holds a key's history.
    """
    from tidemark.operators.order_stats import ordered_counts

    keys = list(keys)
    known = df.where(F.col(x).isNotNull())
    rows = settle(with_row_number(known, keys, order, None, "_row").withColumn("_row", F.col("_row") - 1))
    last = rows.agg(F.max("_row")).first()[0] or 0
    here = Window.partitionBy(*keys, F.floor(F.col("_row") / block)).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.collect_list(x).over(here)
    now = F.col(x)
    below, upto = F.size(F.filter(seen, lambda v: v < now)), F.size(F.filter(seen, lambda v: v <= now))
    out = rows.withColumns({"_below": below.cast("bigint"), "_upto": upto.cast("bigint")})
    size = block
    while size <= last:
        right = F.floor(F.col("_row") / size) % 2
        halves = rows.select(*keys, x, F.floor(F.col("_row") / (2 * size)).alias("_pair"), right.alias("_right"), "_row")
        left = ordered_counts(halves, F.col(x), [*keys, "_pair"], {"n": F.when(F.col("_right") == 0, 1).otherwise(0)})
        more = halves.where("_right = 1").join(left.withColumnRenamed("value", x), [*keys, "_pair", x])
        more = more.select(*keys, "_row", F.col("n_before").alias("_b"), (F.col("n_before") + F.col("n")).alias("_u"))
        out = out.join(more, [*keys, "_row"], "left")
        out = out.withColumns({"_below": F.col("_below") + F.coalesce("_b", F.lit(0)), "_upto": F.col("_upto") + F.coalesce("_u", F.lit(0))})
        out = settle(out.drop("_b", "_u"))
        size *= 2
    return out


def expanding_percentile(df: DataFrame, x: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ("ts",), block: int = 512) -> DataFrame:
    """Percentile of the current value in its whole history up to here, ties counted half; null where the value is null."""
    out = history_counts(df, x, keys, order, block)
    plus = F.when(F.col("_upto") > F.col("_below"), 1).otherwise(0)
    out = out.withColumn("percentile", (F.col("_below") + F.col("_upto") + plus) * 50.0 / (F.col("_row") + 1)).drop("_row", "_below", "_upto")
    return out.unionByName(df.where(F.col(x).isNull()).withColumn("percentile", F.lit(None).cast("double")), allowMissingColumns=True)


def window_sums(df: DataFrame, days: int, step: int, sums: dict[str, Column], keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Sums over windows of ``days`` that start every ``step`` days (epoch-aligned).

    Rows are added up per day before each day is listed for the windows that
    cover it, so the overlap multiplies the daily table and not the rows.
    """
    from tidemark.functions.core import epoch_s, floor_ts

    daily = (
        df.withColumn("_day", floor_ts(ts, 86_400))
        .groupBy(*keys, "_day")
        .agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    )
    day = F.floor(epoch_s("_day") / 86_400)
    last = F.floor(day / step)
    first = F.floor((day - days) / step) + 1
    d = daily.withColumn("_w", F.explode(F.sequence(first, last)))
    start = F.col("_day") - F.make_dt_interval(days=(day - F.col("_w") * step).cast("int"))
    return d.withColumn("window_start", start).groupBy(*keys, "window_start").agg(*[F.sum(k).alias(k) for k in sums])


def block_windows(df: DataFrame, size: int, x: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ("ts",), chunk: Column | None = None) -> DataFrame:
    """Sum of ``x`` over consecutive blocks of ``size`` rows; a short last block is dropped."""
    d = prefix(df, {"_i": ("count", F.lit(1))}, keys, order, chunk)
    d = d.withColumn("block", F.floor((F.col("_i") - 1) / size))
    out = d.groupBy(*keys, "block").agg(F.sum(x).alias("total"), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") == size).drop("_n")


def future_win_rate(df: DataFrame, horizon: int, target: float, n: int = 100, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share of the last n rows whose return over the next ``horizon`` rows is above the target (a label)."""

    def build(d, fr):
        d = d.withColumn("_f", fr.lead("close", horizon) / F.col("close") - 1)
        return d.withColumn("win_rate", fr.mean((F.col("_f") > target).cast("double"), n)).drop("_f")

    return framed(df, build, before=n, after=horizon, keys=keys)


def performance_rank(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Dense rank and position by a score, on a table with one row per ranked item."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc())
    return df.withColumns({"rank": F.dense_rank().over(w)})

