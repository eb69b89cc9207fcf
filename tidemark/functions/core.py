"""Small Column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8  # added to denominators where results must equal x / (y + 1e-8)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def div(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is 0 or null (plain division by zero raises in ANSI mode)."""
    b = col(b)
    return col(a) / F.when(b != 0, b)


def div_eps(a: str | Column, b: str | Column) -> Column:
    """a / (b + 1e-8), the damped form several feature sets use."""
    return col(a) / (col(b) + F.lit(EPS))


def div_or_zero(a: str | Column, b: str | Column) -> Column:
    """a / b where b > 0, otherwise 0."""
    b = col(b)
    return F.when(b > 0, col(a) / F.when(b > 0, b)).otherwise(F.lit(0.0))


def epoch_s(ts: str | Column) -> Column:
    """Whole seconds since 1970 of a timestamp, with or without a time zone (UTC session)."""
    return F.unix_seconds(col(ts).cast("timestamp"))


def epoch_us(ts: str | Column) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def floor_ts(ts: str | Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket of ``seconds`` that holds ``ts``; keeps its type."""
    ts = col(ts)
    past = F.pmod(epoch_us(ts), F.lit(seconds * 1_000_000))
    return ts - F.make_dt_interval(secs=(past / F.lit(1_000_000)).cast("decimal(18,6)"))


def time_chunk(ts: str | Column, seconds: int) -> Column:
    """Number of the time slice of ``seconds`` a row falls in (monotone in ts)."""
    return F.floor(epoch_s(ts) / F.lit(seconds))


def finite(x: str | Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def all_of(predicates: Iterable[Column]) -> Column:
    out = F.lit(True)
    for p in predicates:
        out = out & p
    return out


def ladder(x: str | Column, steps: list[tuple[float, object]], other: object) -> Column:
    """Label of the first step whose bound ``x`` reaches (steps high to low, x >= bound)."""
    x = col(x)
    out = None
    for bound, label in steps:
        out = F.when(x >= bound, F.lit(label)) if out is None else out.when(x >= bound, F.lit(label))
    return out.otherwise(F.lit(other))


def r6(x: str | Column, digits: int = 6) -> Column:
    return F.round(col(x).cast("double"), digits)


def period_start(ts: str | Column, unit: str) -> Column:
    """Start of the hour, day, week (Monday) or month that holds ``ts``; keeps its type."""
    ts = col(ts)
    if unit == "hour":
        return floor_ts(ts, 3600)
    day = floor_ts(ts, 86_400)
    if unit == "day":
        return day
    if unit == "week":
        return day - F.make_dt_interval(days=F.weekday(ts))
    if unit == "month":
        return day - F.make_dt_interval(days=F.dayofmonth(ts) - 1)
    raise ValueError(f"unknown unit {unit}")


def sample_skewness(x: str | Column) -> Column:
    """Bias-corrected skewness (pandas ``skew``); null below 3 rows."""
    n = F.count(col(x)).cast("double")
    return F.when(n > 2, F.skewness(col(x)) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def sample_kurtosis(x: str | Column) -> Column:
    """Bias-corrected excess kurtosis (pandas ``kurt``); null below 4 rows."""
    n = F.count(col(x)).cast("double")
    g2 = F.kurtosis(col(x))
    return F.when(n > 3, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
