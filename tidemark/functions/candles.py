"""Row-level features: candle shapes, sessions, boundaries, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.core import EPS, col, div

# fixed values: session name -> (first hour, end hour), UTC
SESSIONS = {"asian": (0, 8), "european": (8, 16), "us": (16, 24)}


def candle_geometry() -> dict[str, Column]:
    """Body, range, shadows, their shares of the range, and the usual one-bar patterns; 0 on a bar without range."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rng = h - l
    body = F.abs(c - o)
    upper = h - F.greatest(o, c)
    lower = F.least(o, c) - l

    def share(x: Column) -> Column:
        return F.coalesce(div(x, rng), F.lit(0.0))

    b, u, d = share(body), share(upper), share(lower)
    has = rng > 0
    return {
        "body": body,
        "range": rng,
        "upper_shadow": upper,
        "lower_shadow": lower,
        "body_ratio": b,
        "upper_ratio": u,
        "lower_ratio": d,
        "doji": has & (b < 0.1),
        "hammer": has & (d > 0.6) & (b < 0.3) & (u < 0.1),
        "inverted_hammer": has & (u > 0.6) & (b < 0.3) & (d < 0.1),
        "shooting_star": has & (u > 0.6) & (b < 0.3) & (c < o),
        "pin_bar": has & (F.greatest(u, d) > 0.6) & (b < 0.3),
    }


def session_flags(ts: str = "ts", sessions: dict[str, tuple[int, int]] = SESSIONS) -> dict[str, Column]:
    hour = F.hour(ts)
    weekday = F.weekday(F.col(ts))  # Monday = 0
    flags = {f"is_{n}": (hour >= a) & (hour < b) for n, (a, b) in sessions.items()}
    return {
        "hour": hour,
        "minute": F.minute(ts),
        "weekday": weekday,
        "month": F.month(ts),
        "is_weekend": weekday >= 5,
        **flags,
    }


def boundary_flags(ts: str = "ts", minutes: int = 15, tolerance: int = 1) -> dict[str, Column]:
    """Distance in minutes to the nearest ``minutes`` boundary and whether it is within the tolerance."""
    past = F.pmod(F.minute(ts), F.lit(minutes))
    distance = F.least(past, F.lit(minutes) - past)
    return {"boundary_distance": distance, "on_boundary": distance <= tolerance}


def bps(fill: str | Column, reference: str | Column, side: str | Column = "side") -> Column:
    """(fill - reference) / reference in basis points, sign flipped for sells."""
    raw = div(col(fill) - col(reference), reference) * 10_000
    return F.when(col(side) == "SELL", -raw).otherwise(raw)


def weighted_conditions(conditions: list[tuple[str, Column, float]]) -> tuple[Column, Column]:
    """(confidence, reasons): sum of the weights of the conditions met (capped at 1) and their names."""
    confidence = sum((F.when(c, w).otherwise(0.0) for _, c, w in conditions), F.lit(0.0))
    reasons = F.concat_ws(", ", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c, _ in conditions])))
    return F.least(confidence, F.lit(1.0)), reasons


def execution_flags() -> Column:
    """Names of the execution limits a row breaks (fixed limits)."""
    tests = [
        ("LOW_FILL_RATE", F.col("fill_rate") < 0.8),
        ("HIGH_SLIPPAGE", F.abs("slippage_bps") > 50),
        ("HIGH_MARKET_IMPACT", F.col("impact_bps") > 30),
        ("LONG_EXECUTION_TIME", F.col("duration_seconds") > 3600),
        ("HIGH_PARTICIPATION_RATE", F.col("participation") > 0.5),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in tests]))


def normal_cdf(z: str | Column) -> Column:
    """Standard normal distribution function, Abramowitz and Stegun 26.2.17 (error below 7.5e-8)."""
    z = col(z)
    a = F.abs(z)
    t = F.lit(1.0) / (a * 0.2316419 + 1.0)
    poly = t * (t * (t * (t * (t * 1.330274429 - 1.821255978) + 1.781477937) - 0.356563782) + 0.319381530)
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def two_sided_p(z: str | Column) -> Column:
    return (F.lit(1.0) - normal_cdf(F.abs(col(z)))) * 2


def interaction_features() -> dict[str, Column]:
    """Products, ratios, squares and roots of base features (needs rsi, volume_ratio, volatility, momentum)."""
    rsi, vr, vol, mom = (F.col(x) for x in ("rsi", "volume_ratio", "volatility", "momentum"))
    return {
        "rsi_x_volume": rsi * vr,
        "momentum_x_volume": mom * vr,
        "momentum_per_vol": mom / (vol + F.lit(EPS)),
        "rsi_squared": rsi * rsi,
        "root_abs_momentum": F.sqrt(F.abs(mom)),
        "oversold_momentum": F.when(rsi < 30, mom).otherwise(0.0),
    }
