"""Entry rules on bars: weighted predicates, layered filters, composite scores, dip features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.candles import weighted_conditions
from tidemark.functions.core import div, ladder
from tidemark.operators.frames import framed
from tidemark.operators.scans import Mean, exponential_means
from tidemark.operators.indicators import bollinger_columns, rsi_columns

KEYS = ("symbol",)


def signal_inputs(d, fr, rsi_n: int = 14, n: int = 20):
    d = bollinger_columns(rsi_columns(d, fr, rsi_n), fr, n)
    return d.withColumns(
        {
            "volume_ratio": div("volume", fr.mean("volume", n)),
            "dip": div(F.col("close") - F.col("open"), "open"),
        }
    )


def entry_signals(df: DataFrame, dip: float = 0.002, min_confidence: float = 0.6, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows whose weighted conditions reach the confidence limit, with the reasons met.

    Fixed weights: RSI in 30..50 0.3, dip against the open 0.4, below the 20-row
    mean 0.2, below the lower band 0.1, volume above 1.5 means 0.1.
    """
    d = framed(df, signal_inputs, before=22, keys=keys)
    conf, reasons = weighted_conditions(
        [
            ("rsi", F.col("rsi").between(30, 50), 0.3),
            ("dip", F.col("dip") < -dip, 0.4),
            ("below_ma20", F.col("close") < F.col("bb_mid"), 0.2),
            ("below_bb_lower", F.col("close") < F.col("bb_lower"), 0.1),
            ("volume_spike", F.col("volume_ratio") > 1.5, 0.1),
        ]
    )
    d = d.withColumns({"confidence": F.round(conf, 6), "reasons": reasons})
    return d.where(F.col("confidence") >= min_confidence).select(*keys, "ts", "close", "rsi", "confidence", "reasons")


def signal_scores(df: DataFrame, dip: float = 0.002, surge: float = 1.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Number of dip conditions met and their weighted strength (0.3, 0.25, 0.25, 0.2), in three classes."""
    d = framed(df, signal_inputs, before=22, keys=keys)
    conditions = [
        (F.col("rsi").between(30, 50), 0.3),
        (F.col("close") < F.col("bb_mid"), 0.25),
        (F.col("dip") < -dip, 0.25),
        (F.col("volume_ratio") > surge, 0.2),
    ]
    count = sum((F.when(c, 1).otherwise(0) for c, _ in conditions), F.lit(0))
    strength = sum((F.when(c, w).otherwise(0.0) for c, w in conditions), F.lit(0.0))
    d = d.withColumns({"met": count, "strength": F.round(strength, 6)})
    grade = F.when(F.col("strength") > 0.7, "high").when(F.col("strength") > 0.5, "medium").otherwise("low")
    return d.select(*keys, "ts", "met", "strength", grade.alias("grade"))


def layered_signals(
    df: DataFrame,
    rsi_range: tuple[float, float] = (30.0, 50.0),
    max_red: int = 3,
    trend_span: int = 20,
    trend_floor: float = -0.02,
    volume_floor: float = 1.0,
    surge: float = 2.0,
    bb_zone: float = 0.4,
    min_score: float = 0.5,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Every row with the pass flag and score of five layers (RSI, trend, momentum, volume, band) and the total.

    A row is a signal when all layers pass and the mean score reaches ``min_score``.
    """
    df = exponential_means(df, {"_ema": Mean("close", 2.0 / (trend_span + 1), "adjust")}, keys)
    centre = sum(rsi_range) / 2
    half = (rsi_range[1] - rsi_range[0]) / 2

    def build(d, fr):
        d = signal_inputs(d, fr)
        red = F.sum(F.when(F.col("close") < F.col("open"), 1).otherwise(0)).over(fr.back(max_red + 1))
        d = d.withColumns(
            {
                "_red": red > max_red,
                "_trend": div(F.col("_ema"), fr.lag("_ema", 4)) - 1,
                "_c1": fr.pct("close"),
                "_m3": fr.pct("close", 3),
                "_m5": fr.pct("close", 5),
            }
        )
        return d.withColumn("_c0", fr.lag("_c1"))

    d = framed(df, build, before=30, keys=keys)
    zero = F.lit(0.0)
    t, m = F.col("_trend"), (F.col("_m3") + F.col("_m5")) / 2
    v, b = F.col("volume_ratio"), F.col("bb_pct")
    layers = {
        "rsi": (F.col("rsi").between(*rsi_range), F.greatest(zero, 1 - F.abs(F.col("rsi") - centre) / half)),
        "trend": (
            ~F.col("_red") & (t >= trend_floor),
            F.when((t >= -0.01) & (t <= 0), 1.0).when((t >= -0.02) & (t < -0.01), 0.7).otherwise(0.4),
        ),
        "momentum": (
            F.col("_c1") >= F.col("_c0"),
            F.when((m >= -0.02) & (m <= -0.005), 1.0).when(m < -0.02, 0.6).otherwise(0.8),
        ),
        "volume": (v >= volume_floor, F.when(v >= surge, 1.0).when(v >= volume_floor * 1.3, 0.8).otherwise(0.6)),
        "band": (b <= bb_zone, F.greatest(zero, 1 - b / bb_zone)),
    }
    d = d.withColumns({f"{k}_pass": F.coalesce(p, F.lit(False)) for k, (p, _) in layers.items()})
    d = d.withColumns({f"{k}_score": F.when(F.col(f"{k}_pass"), s).otherwise(0.0) for k, (_, s) in layers.items()})
    total = sum((F.col(f"{k}_score") for k in layers), F.lit(0.0)) / len(layers)
    passed = sum((F.col(f"{k}_pass").cast("int") for k in layers), F.lit(0))
    d = d.withColumns({"score": total, "layers_passed": passed})
    is_signal = (F.col("layers_passed") == len(layers)) & (F.col("score") >= min_score)
    grade = ladder("score", [(0.8, "A"), (0.7, "B"), (0.6, "C")], "D")
    return d.select(
        *keys, "ts", "close", *[f"{k}_pass" for k in layers], "layers_passed", "score", is_signal.alias("signal"),
        grade.alias("grade"),
    )


# fixed values: dip size that counts as a dip in each regime
REGIME_DIPS = {
    "strong_uptrend": 0.002,
    "strong_downtrend": 0.006,
    "high_volatility": 0.008,
    "low_volatility": 0.001,
    "range_bound": 0.003,
}


def adaptive_dips(df: DataFrame, thresholds: dict[str, float] = REGIME_DIPS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Dips by the threshold of the row's regime: flag, size, volume on the dip, dips in the last 3, 5 and 10 rows."""
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col("regime"))

    def build(d, fr):
        d = d.withColumns({"change": fr.pct("close"), "threshold": limit, "_vr": div("volume", fr.mean("volume", 20))})
        d = d.withColumn("is_dip", F.coalesce(F.col("change") < -F.col("threshold"), F.lit(False)))
        hit = F.col("is_dip").cast("int")
        return d.withColumns(
            {
                "dip_size": F.when(F.col("is_dip"), -F.col("change")).otherwise(0.0),
                "dip_volume": F.when(F.col("is_dip"), F.col("_vr")).otherwise(0.0),
                **{f"dips_{n}": F.sum(hit).over(fr.back(n)) for n in (3, 5, 10)},
            }
        ).drop("_vr")

    return framed(df, build, before=21, keys=keys)


def feature_set(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The base feature bundle in one pass over one set of blocks."""
    from tidemark.functions.candles import candle_geometry, interaction_features, session_flags
    from tidemark.operators.indicators import true_range

    def build(d, fr):
        d = signal_inputs(d, fr)
        d = d.withColumns({**candle_geometry(), **session_flags(), "_tr": true_range(fr), "_ret": fr.pct("close")})
        d = d.withColumns(
            {
                "atr": fr.mean("_tr", 14),
                "volatility": fr.std("_ret", 20),
                "momentum": fr.pct("close", 10),
                "sma_5": fr.mean("close", 5),
                "sma_50": fr.mean("close", 50),
            }
        )
        return d.withColumns(interaction_features()).drop("_tr", "_ret")

    return framed(df, build, before=60, keys=keys)


def timeframe_consensus(df: DataFrame, seconds: Sequence[int], base_seconds: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """RSI and trend per longer timeframe attached as of the last completed bar, and how many agree.

    A longer bar is known at its end, so its label is moved by its length before the as-of join.
    """
    from tidemark.operators.bars import resample
    from tidemark.operators.temporal_joins import asof_join

    def build(d, fr):
        d = rsi_columns(d, fr, 14)
        return d.withColumn("up", F.col("close") > fr.mean("close", 20))

    out = framed(df, build, before=22, keys=keys).withColumn("_known", F.col("ts") + F.expr(f"interval {base_seconds} seconds"))
    for s in seconds:
        h = framed(resample(df, s, keys), build, before=22, keys=keys)
        h = h.select(*keys, (F.col("ts") + F.expr(f"interval {s} seconds")).alias("_hts"), F.col("rsi").alias(f"rsi_{s}"), F.col("up").alias(f"up_{s}"))
        out = asof_join(out, h, [f"rsi_{s}", f"up_{s}"], keys, "_known", "_hts")
    ups = F.array(F.col("up"), *[F.col(f"up_{s}") for s in seconds])
    return out.withColumns(
        {
            "frames_up": F.size(F.filter(ups, lambda u: F.coalesce(u, F.lit(False)))),
            "frames_known": F.size(F.filter(ups, lambda u: u.isNotNull())),
        }
    ).drop("_known")
