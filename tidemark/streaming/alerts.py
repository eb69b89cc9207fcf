"""Alert rules on streams and tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.frames import framed

# fixed values: rule name, column, limit
RISK_LIMITS = [("VAR_LIMIT", "var", 200_000.0), ("DRAWDOWN_LIMIT", "drawdown", 0.20), ("LEVERAGE_LIMIT", "leverage", 3.0)]


def limit_alerts(metrics: DataFrame, keep: Sequence[str], limits: Sequence[tuple[str, str, float]] = RISK_LIMITS) -> DataFrame:
    """One row per limit exceeded."""
    rows = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(c) > limit,
                    F.struct(F.lit(n).alias("type"), F.col(c).cast("double").alias("value"), F.lit(limit).alias("limit")),
                )
                for n, c, limit in limits
            ]
        )
    )
    return metrics.select(*keep, F.inline(rows))


def dynamic_thresholds(metrics: DataFrame, n: int = 100, q: float = 0.95, k: float = 3.0, min_rows: int = 20, keys: Sequence[str] = ("name",), order: Sequence[str] = ("ts",), chunk: Column | None = None) -> DataFrame:
    """Rows above the trailing percentile or mean + k deviations of the n rows before them."""

    def build(d, fr):
        w = fr.span(-n, -1)
        seen = F.count("value").over(w) >= min_rows
        return d.withColumns(
            {
                "limit_pct": F.when(seen, F.percentile("value", F.lit(q)).over(w)),
                "limit_sigma": F.when(seen, F.avg("value").over(w) + F.stddev_samp("value").over(w) * k),
            }
        )

    d = framed(metrics, build, before=n, keys=keys, order=order, chunk=chunk)
    d = d.withColumns({"above_pct": F.col("value") > F.col("limit_pct"), "above_sigma": F.col("value") > F.col("limit_sigma")})
    return d.where(F.col("above_pct") | F.col("above_sigma"))


COOLDOWN_SCHEMA = "name STRING, ts TIMESTAMP, value DOUBLE"


def cooldown_step(rows, since, last, limit: float, duration: float, cooldown: float):
    """Walk rows in time order: raise when above the limit for ``duration`` and not within ``cooldown`` of the last alert.

    Returns the alerts and the state (start of the violation, last alert time).
    """
    raised = []
    for at, value in rows:
        if value <= limit:
            since = None
            continue
        if since is None:
            since = at
        if at - since >= duration and (last is None or at - last >= cooldown):
            raised.append((at, value))
            last = at
    return raised, since, last


def cooldown_alerts(metrics: DataFrame, limit: float, duration: float, cooldown: float, key: str = "name") -> DataFrame:
    """Stateful alerts per key on a stream with ``key``, ``ts``, ``value``.

    The state of a key is three numbers. Rows of one batch are taken in time order;
    a row older than the state's last time is late and dropped. The rows a key has in
    one batch are held together, so set the source's rate limit
    (``maxOffsetsPerTrigger``, ``maxFilesPerTrigger``); over a whole table use
    ``spell_alerts``, which has no such group.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, last, seen = state.get if state.exists else (None, None, None)
        parts = list(frames)
        if not parts:
            return
        d = pd.concat(parts).sort_values("ts")
        stamps = d["ts"].dt.tz_localize(None) if d["ts"].dt.tz is not None else d["ts"]
        micros = stamps.astype("datetime64[us]").astype("int64")
        rows = [(int(t), v) for t, v in zip(micros, d["value"]) if seen is None or t >= seen]
        raised, since, last = cooldown_step(rows, since, last, limit, duration * 1e6, cooldown * 1e6)
        if rows:
            seen = rows[-1][0]
        state.update((since, last, seen))
        out = pd.DataFrame(raised, columns=["us", "value"])
        stamps = pd.to_datetime(out["us"].astype("int64"), unit="us").astype("datetime64[us]")
        yield pd.DataFrame({"name": [k[0]] * len(out), "ts": stamps, "value": out["value"].astype("float64")})

    return metrics.groupBy(key).applyInPandasWithState(
        step, COOLDOWN_SCHEMA, "since BIGINT, last BIGINT, seen BIGINT", "append", GroupStateTimeout.NoTimeout
    )


def spell_alerts(metrics: DataFrame, limit: float, duration: float, cooldown: float, keys: Sequence[str] = ("name",), order: Sequence[str] = ("ts",), chunk: Column | None = None) -> DataFrame:
    """Batch form of ``cooldown_alerts``: rows at least ``duration`` seconds into a spell, spaced by the cooldown."""
    from tidemark.operators.frames import CHUNK, islands, prefix
    from tidemark.operators.sequences import space_out

    d = islands(metrics.withColumn("_above", F.col("value") > limit), "_above", keys, order, chunk, keep_chunk=True)
    d = prefix(d.where("_above"), {"_since": ("min", F.col(order[0]))}, [*keys, "island"], order).drop(CHUNK)
    held = (F.unix_micros(F.col(order[0]).cast("timestamp")) - F.unix_micros(F.col("_since").cast("timestamp"))) / 1e6
    ready = d.where(held >= duration).select(*[c for c in metrics.columns if c != CHUNK])
    return space_out(ready, cooldown, keys, order[0], tie=order[1:])


def violation_spells(metrics: DataFrame, limit: float, duration: float, keys: Sequence[str] = ("name",), order: Sequence[str] = ("ts",), chunk: Column | None = None) -> DataFrame:
    """Batch form of the duration rule: spells above the limit that last at least ``duration`` seconds."""
    from tidemark.operators.frames import islands

    d = islands(metrics.withColumn("_above", F.col("value") > limit), "_above", keys, order, chunk).where("_above")
    d = d.groupBy(*keys, "island").agg(
        F.min(order[0]).alias("start_ts"), F.max(order[0]).alias("end_ts"), F.max("value").alias("peak"), F.count(F.lit(1)).alias("rows")
    )
    secs = (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 1e6
    return d.where(secs >= duration)
