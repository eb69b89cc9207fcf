"""Technical indicators on bars.

Each ``..._columns`` helper works inside a ``framed`` build and returns the
frame with columns added; the public functions wrap one of them and state how
many rows back they reach. Standard deviations are sample ones unless a
parameter says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import EPS, div
from tidemark.operators.frames import CHUNK, Frames, framed, prefix
from tidemark.operators.scans import Mean, exponential_means

KEYS = ("symbol",)


def _nz(x: Column) -> Column:
    return F.when(x != 0, x)


def rsi_columns(d: DataFrame, fr: Frames, n: int = 14, out: str = "rsi", x: str = "close") -> DataFrame:
    """Simple-mean RSI; 100 when there is no loss, null when nothing moved."""
    d = d.withColumn("_d", F.col(x) - fr.lag(x))
    gain = F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0)))
    loss = F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0)))
    d = d.withColumns({"_g": gain, "_l": loss})
    d = d.withColumns({"_ag": fr.mean("_g", n), "_al": fr.mean("_l", n)})
    value = F.lit(100.0) * F.col("_ag") / _nz(F.col("_ag") + F.col("_al"))
    return d.withColumn(out, value).drop("_d", "_g", "_l", "_ag", "_al")


def rsi(df: DataFrame, n: int = 14, keys: Sequence[str] = KEYS) -> DataFrame:
    return framed(df, lambda d, fr: rsi_columns(d, fr, n), before=n + 1, keys=keys)


def rsi_wilder(df: DataFrame, n: int = 14, seed: str = "sma", keys: Sequence[str] = KEYS) -> DataFrame:
    """RSI with Wilder smoothing, seeded by the first n-row mean or by the first value."""

    def build(d, fr):
        d = d.withColumn("_d", F.col("close") - fr.lag("close"))
        gain = F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0)))
        loss = F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0)))
        return d.withColumns({"_g": gain, "_l": loss})

    d = framed(df, build, before=1, keys=keys)
    d = exponential_means(d, {"_ag": Mean("_g", 1.0 / n, seed, n), "_al": Mean("_l", 1.0 / n, seed, n)}, keys)
    value = F.lit(100.0) * F.col("_ag") / _nz(F.col("_ag") + F.col("_al"))
    return d.withColumn("rsi", value).drop("_d", "_g", "_l", "_ag", "_al")


def moving_averages(df: DataFrame, periods: Sequence[int] = (5, 20, 50), keys: Sequence[str] = KEYS) -> DataFrame:
    """Simple mean per period, distance of the close from it, and its one-row change."""

    def build(d, fr):
        d = d.withColumns({f"sma_{n}": fr.mean("close", n) for n in periods})
        return d.withColumns(
            {
                **{f"dist_{n}": F.col("close") / _nz(F.col(f"sma_{n}")) - 1 for n in periods},
                **{f"slope_{n}": fr.pct(f"sma_{n}") for n in periods},
            }
        )

    return framed(df, build, before=max(periods) + 1, keys=keys)


def ema(df: DataFrame, span: int, x: str = "close", out: str = "ema", adjust: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Exponential mean with alpha = 2 / (span + 1)."""
    return exponential_means(df, {out: Mean(x, 2.0 / (span + 1), "adjust" if adjust else "first")}, keys)


def bollinger_columns(d: DataFrame, fr: Frames, n: int = 20, k: float = 2.0, population: bool = False) -> DataFrame:
    std = fr.std_pop("close", n) if population else fr.std("close", n)
    d = d.withColumns({"bb_mid": fr.mean("close", n), "_s": std})
    d = d.withColumns({"bb_upper": F.col("bb_mid") + F.col("_s") * k, "bb_lower": F.col("bb_mid") - F.col("_s") * k})
    width = F.col("bb_upper") - F.col("bb_lower")
    return d.withColumns(
        {"bb_width": width / _nz(F.col("bb_mid")), "bb_pct": (F.col("close") - F.col("bb_lower")) / _nz(width)}
    ).drop("_s")


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, population: bool = False, squeeze: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bands, width, position in the band; squeeze = width below its own 20 % quantile of ``squeeze`` rows."""

    def build(d, fr):
        d = bollinger_columns(d, fr, n, k, population)
        return d.withColumn("squeeze", F.col("bb_width") < fr.quantile("bb_width", 0.2, squeeze))

    return framed(df, build, before=n + squeeze, keys=keys)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, keys: Sequence[str] = KEYS) -> DataFrame:
    """Difference of two exponential means, its own exponential mean, histogram and crossing flag."""
    alphas = [2.0 / (n + 1) for n in (fast, slow, signal)]
    d = exponential_means(df, {"_f": Mean("close", alphas[0]), "_s": Mean("close", alphas[1])}, keys)
    d = exponential_means(d.withColumn("macd", F.col("_f") - F.col("_s")), {"signal": Mean("macd", alphas[2])}, keys)

    def build(d, fr):
        d = d.withColumn("hist", F.col("macd") - F.col("signal"))
        before = fr.lag("hist")
        cross = F.when((F.col("hist") > 0) & (before <= 0), 1).when((F.col("hist") < 0) & (before >= 0), -1)
        return d.withColumn("cross", F.coalesce(cross, F.lit(0)))

    return framed(d.drop("_f", "_s"), build, before=1, keys=keys)


def stochastic(df: DataFrame, n: int = 14, smooth: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """%K, %D = mean of %K, J = 3K - 2D, Williams %R."""

    def build(d, fr):
        d = d.withColumns({"_h": fr.max("high", n), "_l": fr.min("low", n)})
        span = _nz(F.col("_h") - F.col("_l"))
        d = d.withColumns(
            {
                "k": (F.col("close") - F.col("_l")) * 100 / span,
                "williams_r": (F.col("_h") - F.col("close")) * -100 / span,
            }
        )
        d = d.withColumn("d", fr.mean("k", smooth))
        return d.withColumn("j", F.col("k") * 3 - F.col("d") * 2).drop("_h", "_l")

    return framed(df, build, before=n + smooth, keys=keys)


def cci(df: DataFrame, n: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """(typical price - mean) / (0.015 * mean absolute deviation over the frame)."""

    def build(d, fr):
        d = d.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
        d = d.withColumns({"_m": fr.mean("_tp", n), "_all": F.collect_list("_tp").over(fr.back(n))})
        mad = F.aggregate("_all", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m"))) / n
        value = (F.col("_tp") - F.col("_m")) / _nz(mad * 0.015)
        return d.withColumn("cci", value).drop("_tp", "_m", "_all")

    return framed(df, build, before=n, keys=keys)


def true_range(fr: Frames) -> Column:
    prev = fr.lag("close")
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )  # greatest skips the null of the first row


def atr(df: DataFrame, n: int = 14, keys: Sequence[str] = KEYS) -> DataFrame:
    """True range, its simple mean, and that mean as a share of the close."""

    def build(d, fr):
        d = d.withColumn("tr", true_range(fr))
        d = d.withColumn("atr", fr.mean("tr", n))
        return d.withColumn("atr_pct", F.col("atr") / _nz(F.col("close")))

    return framed(df, build, before=n + 1, keys=keys)


def adx(df: DataFrame, n: int = 14, keys: Sequence[str] = KEYS) -> DataFrame:
    """+DI, -DI and ADX with Wilder smoothing started at the first value."""
    alpha = 1.0 / n

    def build(d, fr):
        up = F.col("high") - fr.lag("high")
        down = fr.lag("low") - F.col("low")
        d = d.withColumns({"_up": up, "_dn": down, "_tr": true_range(fr)})
        some = F.col("_up").isNotNull()
        return d.withColumns(
            {
                "_pdm": F.when(some, F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0)),
                "_mdm": F.when(some, F.when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn")).otherwise(0.0)),
                "_tr": F.when(some, F.col("_tr")),
            }
        )

    d = exponential_means(framed(df, build, before=1, keys=keys), {f"{x}s": Mean(x, alpha) for x in ("_pdm", "_mdm", "_tr")}, keys)
    d = d.withColumns({"plus_di": div(F.col("_pdms") * 100, "_trs"), "minus_di": div(F.col("_mdms") * 100, "_trs")})
    dx = F.abs(F.col("plus_di") - F.col("minus_di")) * 100 / _nz(F.col("plus_di") + F.col("minus_di"))
    d = d.withColumn("_dx", F.when(F.col("_up").isNotNull(), F.coalesce(dx, F.lit(0.0))))
    d = exponential_means(d, {"adx": Mean("_dx", alpha)}, keys)
    return d.drop("_up", "_dn", "_tr", "_pdm", "_mdm", "_pdms", "_mdms", "_trs", "_dx")


def ichimoku(df: DataFrame, a: int = 9, b: int = 26, c: int = 52, keys: Sequence[str] = KEYS) -> DataFrame:
    """Conversion, base and span lines (no forward shift) and whether the close is above both spans."""

    def build(d, fr):
        def mid(n):
            return (fr.max("high", n) + fr.min("low", n)) / 2

        d = d.withColumns({"conversion": mid(a), "base": mid(b), "span_b": mid(c)})
        d = d.withColumn("span_a", (F.col("conversion") + F.col("base")) / 2)
        return d.withColumn("above_cloud", F.col("close") > F.greatest("span_a", "span_b"))

    return framed(df, build, before=c, keys=keys)


def volume_flow(df: DataFrame, n: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """On-balance volume, volume-price trend, accumulation/distribution (running sums) and Chaikin money flow."""

    def build(d, fr):
        d = d.withColumn("_ret", fr.pct("close"))
        signed = F.col("volume") * F.signum(F.coalesce("_ret", F.lit(0.0)))
        mult = F.coalesce(
            div((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low")),
            F.lit(0.0),
        )
        d = d.withColumns(
            {"_obv": signed, "_vpt": F.col("volume") * F.coalesce("_ret", F.lit(0.0)), "_ad": mult * F.col("volume")}
        )
        return d.withColumn("cmf", fr.sum("_ad", n) / _nz(fr.sum("volume", n)))

    d = framed(df, build, before=n + 1, keys=keys)
    d = prefix(d, {"obv": ("sum", F.col("_obv")), "vpt": ("sum", F.col("_vpt")), "adl": ("sum", F.col("_ad"))}, keys)
    return d.drop("_ret", "_obv", "_vpt", "_ad", CHUNK)


def vwap_rolling(df: DataFrame, n: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Volume-weighted typical price over n rows, deviation of the close, weighted deviation and z."""

    def build(d, fr):
        d = d.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
        d = d.withColumns({"_pv": F.col("_tp") * F.col("volume"), "_ppv": F.col("_tp") * F.col("_tp") * F.col("volume")})
        v = _nz(fr.sum("volume", n))
        d = d.withColumn("vwap", fr.sum("_pv", n) / v)
        d = d.withColumn("_var", F.greatest(fr.sum("_ppv", n) / v - F.col("vwap") * F.col("vwap"), F.lit(0.0)))
        d = d.withColumns({"vwap_dev": F.col("close") / _nz(F.col("vwap")) - 1, "vwap_std": F.sqrt("_var")})
        return d.withColumn("vwap_z", (F.col("close") - F.col("vwap")) / (F.col("vwap_std") + F.lit(EPS))).drop(
            "_tp", "_pv", "_ppv", "_var"
        )

    return framed(df, build, before=n, keys=keys)


# fixed values: retracement levels
FIB_LEVELS = (0.236, 0.382, 0.5, 0.618, 0.786)


def pivots_fib(df: DataFrame, n: int = 50, near: float = 0.005, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pivot lines from the bar before, retracement levels of the n-row range, and whether the close is near one."""

    def build(d, fr):
        ph, pl, pc = fr.lag("high"), fr.lag("low"), fr.lag("close")
        d = d.withColumns({"_ph": ph, "_pl": pl, "pivot": (ph + pl + pc) / 3, "_hi": fr.max("high", n), "_lo": fr.min("low", n)})
        span = F.col("_ph") - F.col("_pl")
        d = d.withColumns(
            {
                "r1": F.col("pivot") * 2 - F.col("_pl"),
                "s1": F.col("pivot") * 2 - F.col("_ph"),
                "r2": F.col("pivot") + span,
                "s2": F.col("pivot") - span,
                **{
                    f"fib_{int(f * 1000)}": F.col("_hi") - (F.col("_hi") - F.col("_lo")) * f
                    for f in FIB_LEVELS
                },
            }
        )
        gaps = [F.abs(F.col("close") / F.col(f"fib_{int(f * 1000)}") - 1) for f in FIB_LEVELS]
        return d.withColumn("near_fib", F.least(*gaps) < near).drop("_ph", "_pl", "_hi", "_lo")

    return framed(df, build, before=n + 1, keys=keys)


def order_flow(df: DataFrame, n: int = 20, q: float = 0.8, keys: Sequence[str] = KEYS) -> DataFrame:
    """Buy and sell volume by candle sign, imbalance, price impact per volume and its mean over 10 and ``n`` rows, large-volume flag,
    spread estimated from high and low and its 10-row mean, money-flow ratio and net flow (rising against falling typical prices)."""

    def build(d, fr):
        up = F.col("close") > F.col("open")
        d = d.withColumns(
            {
                "buy_volume": F.when(up, F.col("volume")).otherwise(0.0),
                "sell_volume": F.when(F.col("close") < F.col("open"), F.col("volume")).otherwise(0.0),
                "_ret": fr.pct("close"),
            }
        )
        b, s = fr.sum("buy_volume", n), fr.sum("sell_volume", n)
        d = d.withColumns(
            {
                "imbalance": (b - s) / (b + s + F.lit(EPS)),
                "impact": F.abs("_ret") / (F.col("volume") + F.lit(EPS)),
                "large_volume": F.col("volume") > fr.quantile("volume", q, n),
                "spread": (F.col("high") - F.col("low")) / _nz(F.col("close")),
                "_tp": (F.col("high") + F.col("low") + F.col("close")) / 3,
            }
        )
        before = fr.lag("_tp")
        flow = F.col("_tp") * F.col("volume")
        d = d.withColumns({"_in": F.when(F.col("_tp") > before, flow).otherwise(0.0), "_out": F.when(F.col("_tp") < before, flow).otherwise(0.0)})
        into, out = fr.sum("_in", n), fr.sum("_out", n)
        return d.withColumns(
            {
                "illiquidity_10": fr.mean("impact", 10), f"illiquidity_{n}": fr.mean("impact", n), "spread_10": fr.mean("spread", 10),
                "money_flow": into / (out + F.lit(EPS)), "net_flow": (into - out) / (into + out + F.lit(EPS)),
            }
        ).drop("_ret", "_tp", "_in", "_out")

    return framed(df, build, before=n + 1, keys=keys)


def momentum_divergence(df: DataFrame, n: int = 10, rsi_n: int = 14, keys: Sequence[str] = KEYS) -> DataFrame:
    """Momentum, acceleration, share of rising rows, and price extremes that the RSI does not confirm."""

    def build(d, fr):
        d = rsi_columns(d, fr, rsi_n)
        d = d.withColumns({"momentum": fr.pct("close", n), "_up": (F.col("close") > fr.lag("close")).cast("double")})
        d = d.withColumns(
            {
                "acceleration": F.col("momentum") - fr.lag("momentum"),
                "consistency": fr.mean("_up", n),
                "_new_low": F.col("low") <= fr.min("low", n),
                "_new_high": F.col("high") >= fr.max("high", n),
            }
        )
        return d.withColumns(
            {
                "bullish_divergence": F.col("_new_low") & (F.col("rsi") > fr.min("rsi", n)),
                "bearish_divergence": F.col("_new_high") & (F.col("rsi") < fr.max("rsi", n)),
            }
        ).drop("_up", "_new_low", "_new_high")

    return framed(df, build, before=n + rsi_n + 2, keys=keys)


def volatility_regime(df: DataFrame, n: int = 20, history: int = 100, keys: Sequence[str] = KEYS) -> DataFrame:
    """Volatility regime by its own trailing 20 % and 80 % quantiles, clustering ratio, drawdown stress level."""

    def build(d, fr):
        d = d.withColumn("_ret", fr.pct("close"))
        d = d.withColumn("vol", fr.std("_ret", n))
        d = d.withColumns({"_q2": fr.quantile("vol", 0.2, history), "_q8": fr.quantile("vol", 0.8, history)})
        regime = (
            F.when(F.col("_q2").isNull(), None)
            .when(F.col("vol") < F.col("_q2"), "low")
            .when(F.col("vol") > F.col("_q8"), "high")
            .otherwise("normal")
        )
        dd = F.col("close") / fr.max("close", history) - 1
        stress = F.when(dd < -0.2, "extreme").when(dd < -0.1, "high").when(dd < -0.05, "medium").when(dd.isNotNull(), "low")
        return d.withColumns(
            {
                "regime": regime,
                "clustering": F.col("vol") / _nz(fr.mean("vol", history)),
                "drawdown": dd,
                "stress": stress,
            }
        ).drop("_ret", "_q2", "_q8")

    return framed(df, build, before=n + history + 2, keys=keys)


def fractal_swings(df: DataFrame, side: int = 2, delay: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """Swing highs and lows above or below ``side`` neighbours on both sides.

    A swing is known only ``side`` rows later; with ``delay`` (default) the flag appears there,
    without it on the swing itself, which looks ahead.
    """

    def build(d, fr):
        hi, lo = F.lit(True), F.lit(True)
        for k in range(1, side + 1):
            hi = hi & (F.col("high") > fr.lag("high", k)) & (F.col("high") > fr.lead("high", k))
            lo = lo & (F.col("low") < fr.lag("low", k)) & (F.col("low") < fr.lead("low", k))
        d = d.withColumns({"_h": F.coalesce(hi, F.lit(False)), "_l": F.coalesce(lo, F.lit(False))})
        if delay:
            pick = {"swing_high": F.coalesce(fr.lag("_h", side), F.lit(False)), "swing_low": F.coalesce(fr.lag("_l", side), F.lit(False))}
        else:
            pick = {"swing_high": F.col("_h"), "swing_low": F.col("_l")}
        d = d.withColumns(pick)
        return d.withColumns(
            {
                "swing_highs_20": F.sum(F.col("swing_high").cast("int")).over(fr.back(20)),
                "swing_lows_20": F.sum(F.col("swing_low").cast("int")).over(fr.back(20)),
            }
        ).drop("_h", "_l")

    return framed(df, build, before=20 + 2 * side, after=side, keys=keys)


def levels_volume_score(df: DataFrame, n: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Support, resistance and distances over n rows, volume ratio / 3 capped at 1, dip quality."""

    def build(d, fr):
        d = d.withColumns({"support": fr.min("low", n), "resistance": fr.max("high", n), "_v": fr.mean("volume", n), "_ret": fr.pct("close")})
        d = d.withColumns(
            {
                "to_support": F.col("close") / _nz(F.col("support")) - 1,
                "to_resistance": F.col("resistance") / _nz(F.col("close")) - 1,
                "volume_score": F.least(F.col("volume") / _nz(F.col("_v")) / 3, F.lit(1.0)),
            }
        )
        span = _nz(F.col("resistance") - F.col("support"))
        quality = (F.lit(1.0) - (F.col("close") - F.col("support")) / span) * F.col("volume_score")
        return d.withColumn("dip_quality", F.when(F.col("_ret") < 0, quality).otherwise(0.0)).drop("_v", "_ret")

    return framed(df, build, before=n + 1, keys=keys)


def regime_scores(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Five regime scores per row, the best one, its confidence and the chance of a change.

    Fixed weights: trend 0.3 / 0.2 / 0.2 / 0.1, volatility 0.4 / 0.3 / 0.3; range is what is left, with 0.2 more
    for a weak trend. Trend strength is the share of rows moving with the 24-row
    move, its direction the sign of that move.
    """

    def build(d, fr):
        d = rsi_columns(d, fr, 14)
        d = bollinger_columns(d, fr, 20)
        d = d.withColumns({"_tr": true_range(fr), "_ret": fr.pct("close"), "_i": F.col("_rn").cast("double")})
        d = d.withColumns(
            {
                "_move": fr.pct("close", 24),
                "_up": fr.mean(F.when(F.col("_ret").isNotNull(), (F.col("_ret") > 0).cast("double")), 24),
                "_slope": fr.full(F.regr_slope(F.col("close"), F.col("_i")), 20) / _nz(fr.mean("close", 20)),
                "_vol": fr.std("_ret", 20),
                "_atr": fr.mean("_tr", 14) / F.col("close"),
            }
        )
        d = d.withColumn("_strength", F.abs(F.col("_up") * 2 - 1))
        enough = F.count("_vol").over(fr.back(100)) >= 100
        d = d.withColumn("_volrank", F.when(enough, percent_of_frame(fr, "_vol", 100)))

        def pts(cond, w):
            return F.when(cond, w).otherwise(0.0)

        strong = pts(F.col("_strength") > 0.6, 0.3)
        up = strong + pts(F.col("_move") > 0, 0.2) + pts(F.col("_slope") > 0.001, 0.2) + pts(F.col("rsi") > 50, 0.1)
        down = strong + pts(F.col("_move") < 0, 0.2) + pts(F.col("_slope") < -0.001, 0.2) + pts(F.col("rsi") < 50, 0.1)
        high = pts(F.col("_volrank") > 75, 0.4) + pts(F.col("bb_width") > 0.15, 0.3) + pts(F.col("_atr") > 0.03, 0.3)
        low = pts(F.col("_volrank") < 25, 0.4) + pts(F.col("bb_width") < 0.05, 0.3) + pts(F.col("_atr") < 0.01, 0.3)
        d = d.withColumns({"strong_uptrend": up, "strong_downtrend": down, "high_volatility": high, "low_volatility": low})
        rng = 1 - F.greatest("strong_uptrend", "strong_downtrend", "high_volatility", "low_volatility")
        d = d.withColumn("range_bound", rng + pts(F.col("_strength") < 0.3, 0.2))
        names = ["strong_uptrend", "strong_downtrend", "high_volatility", "low_volatility", "range_bound"]
        best = F.array_max(F.array(*[F.struct(F.round(F.col(n), 6).alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, n in enumerate(names)]))
        ranked = F.sort_array(F.array(*[F.round(F.col(n), 6) for n in names]), asc=False)
        d = d.withColumns({"_best": best, "_ranked": ranked})
        d = d.withColumns(
            {
                "regime": F.col("_best.n"),
                "confidence": F.col("_best.s"),
                "transition": 1 - (F.col("_ranked")[0] - F.col("_ranked")[1]),
            }
        )
        return d.drop("_tr", "_ret", "_i", "_move", "_up", "_slope", "_vol", "_atr", "_strength", "_volrank", "_best", "_ranked")

    return framed(df, build, before=140, keys=keys)


def percent_of_frame(fr: Frames, x: str, n: int) -> Column:
    """Percentile rank (0..100) of the current value in its trailing n rows, ties counted half."""
    seen = F.collect_list(F.col(x)).over(fr.back(n))
    cur = F.col(x)
    below = F.size(F.filter(seen, lambda v: v < cur))
    upto = F.size(F.filter(seen, lambda v: v <= cur))
    plus = F.when(upto > below, 1).otherwise(0)
    return (below + upto + plus) * 50.0 / F.when(F.size(seen) > 0, F.size(seen))


def cross_section_rank(df: DataFrame, x: str, ts: str = "ts", out: str = "rank") -> DataFrame:
    """Rank of ``x`` among symbols at the same time as a share of their number, ties averaged.

    A window holds the symbols of one timestamp, one row each.
    """
    w = Window.partitionBy(ts).orderBy(x)
    same = Window.partitionBy(ts, x)
    n = F.count(F.col(x)).over(Window.partitionBy(ts))
    value = (F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2) / n
    return df.where(F.col(x).isNotNull()).withColumn(out, value)


def cross_asset(df: DataFrame, reference: str, n: int = 50, lags: Sequence[int] = (12, 48), keys: Sequence[str] = KEYS) -> DataFrame:
    """Strength against the market over several horizons, rolling correlation and beta to a reference symbol."""
    from tidemark.operators.joins import with_market_returns

    def returns(d, fr):
        return d.withColumns({"ret": fr.pct("close"), **{f"ret_{k}": fr.pct("close", k) for k in lags}})

    d = framed(df, returns, before=max(lags), keys=keys)
    m = d.groupBy("ts").agg(F.avg("volume").alias("_mv"), *[F.avg(f"ret_{k}").alias(f"_m{k}") for k in lags])
    d = with_market_returns(d, reference=reference).join(m, "ts")

    def rolling(d, fr):
        both = F.when(F.col("ret").isNotNull() & F.col("ref_ret").isNotNull(), 1)
        seen = F.count(both).over(fr.back(n))
        full = seen >= n
        return d.withColumns(
            {
                **{f"strength_{k}": F.col(f"ret_{k}") - F.col(f"_m{k}") for k in lags},
                "volume_vs_market": F.col("volume") / _nz(F.col("_mv")),
                "corr_ref": F.when(full, F.corr("ret", "ref_ret").over(fr.back(n))),
                "beta_ref": F.when(full, F.covar_samp("ret", "ref_ret").over(fr.back(n)) / _nz(F.var_samp("ref_ret").over(fr.back(n)))),
            }
        )

    out = framed(d, rolling, before=n, keys=keys)
    return out.drop("_mv", *[f"_m{k}" for k in lags])
