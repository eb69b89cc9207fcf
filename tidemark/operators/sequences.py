"""Order-dependent selection without one task per key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import epoch_us
from tidemark.operators.frames import CHUNK, balanced_chunks
from tidemark.session import settle

NEVER = -(2**62)


def _leave(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Per entry: when the chain of kept intervals that begins with it ends, within these rows."""
    at = np.arange(len(start))
    nxt = _next(start, end)
    last = np.where(nxt < len(start), nxt, at)
    while True:  # jumps double until every chain has reached its last interval
        further = last[last]
        if (further == last).all():
            return end[last]
        last = further


def _next(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Per entry: the first later interval that starts at or after its end."""
    return np.maximum(np.searchsorted(start, end, side="left"), np.arange(len(start)) + 1)


def slice_steps(d: DataFrame, keys: Sequence[str], order: Sequence[str], key_schema: str) -> DataFrame:
    """Per slice, when the last interval kept in or before it ends (``leave``), for each end it can find on entering (``enter``)."""
    starts = d.groupBy(*keys, CHUNK).agg(F.min("_s").alias("_s0"))
    starts = settle(starts.withColumn("_next", F.lead("_s0").over(Window.partitionBy(*keys).orderBy(CHUNK))))
    cuts = starts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(CHUNK, "_s0"))).alias("_cuts"))  # one entry a slice
    over = d.join(starts.select(*keys, CHUNK, "_next"), [*keys, CHUNK]).where(F.col("_e") > F.col("_next"))
    over = over.groupBy(*keys, CHUNK, "_e").agg(F.lit(1)).select(*keys, F.col(CHUNK).alias("_from"), "_e")
    later = F.filter("_cuts", lambda c: (c[CHUNK] > F.col("_from")) & (c["_s0"] < F.col("_e")))
    ends = settle(over.join(cuts, list(keys)).select(*keys, "_e", F.explode(later).alias("_at")).select(*keys, F.col(f"_at.{CHUNK}").alias(CHUNK), "_e").distinct())

    def steps(pdf: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        s, e = pdf["_s"].to_numpy(), pdf["_e"].to_numpy()
        enter = np.append(NEVER, np.sort(ends["_e"].to_numpy(np.int64)))
        i = np.searchsorted(s, enter, side="left")
        leave = np.where(i < len(s), _leave(s, e)[np.minimum(i, len(s) - 1)], enter)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, CHUNK: pdf[CHUNK].iloc[0], "enter": enter, "leave": leave})

    rows = d.select(*keys, CHUNK, *order, "_e").groupBy(*keys, CHUNK)
    return rows.cogroup(ends.groupBy(*keys, CHUNK)).applyInPandas(steps, f"{key_schema}, {CHUNK} BIGINT, enter BIGINT, leave BIGINT")


def non_overlapping(
    intervals: DataFrame,
    keys: Sequence[str] = ("symbol",),
    start: str = "ts",
    end: str = "exit_ts",
    tie: Sequence[str] = (),
    rows: int = 1_000_000,
) -> DataFrame:
    """Keep the first interval of each key, then always the next that starts at or after the last kept end.

    The sorted intervals are cut into slices of about ``rows`` rows, whatever the size of a key.
    Which intervals a slice keeps depends only on when the last interval kept
    before it ends. That is before the slice starts, or it is the end of one of the intervals
    that lie over its start. Pass one finds, per slice, the end it hands on for each of
    these: as many as overlap there, however long some of them are. They are followed in
    order per key. Pass two goes through the kept rows of each slice.
    """
    keys = list(keys)
    order = ["_s", *tie]
    d = intervals.withColumns({"_s": epoch_us(start), "_e": epoch_us(end)})
    d = balanced_chunks(d, keys, order, rows)
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema if f.name in keys)
    entries = slice_steps(d, keys, order, key_schema)

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        busy, rows = NEVER, []
        for c, g in pdf.sort_values([CHUNK, "enter"]).groupby(CHUNK, sort=True):
            rows.append((c, busy))
            i = int(np.searchsorted(g["enter"].to_numpy(), busy))
            known = i < len(g) and g["enter"].iloc[i] == busy
            busy = int(g["leave"].iloc[i if known else 0])  # else it has ended before the slice starts
        out = pd.DataFrame(rows, columns=[CHUNK, "_busy"])
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})

    entry = entries.groupBy(*keys).applyInPandas(follow, f"{CHUNK} BIGINT, _busy BIGINT, {key_schema}")
    kept = [f for f in intervals.schema if f.name != CHUNK]
    cols = [f.name for f in kept]
    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        s, e = pdf["_s"].to_numpy(), pdf["_e"].to_numpy()
        nxt, keep = _next(s, e).tolist(), np.zeros(len(pdf), bool)
        i = int(np.searchsorted(s, pdf["_busy"].iloc[0], side="left"))
        while i < len(nxt):  # once for each interval kept
            keep[i] = True
            i = nxt[i]
        return pdf.loc[keep, cols]

    return d.join(entry, [*keys, CHUNK]).groupBy(*keys, CHUNK).applyInPandas(walk, out_schema)


def space_out(signals: DataFrame, seconds: float, keys: Sequence[str] = (), ts: str = "ts", tie: Sequence[str] = (), rows: int = 1_000_000) -> DataFrame:
    """Sequential spacing: keep a signal only if the last kept one is at least ``seconds`` older.

    The same walk as ``non_overlapping`` with intervals of fixed length.
    """
    d = signals.withColumn("_until", F.col(ts) + F.expr(f"interval {int(seconds * 1_000_000)} microseconds"))
    if not keys:
        d = d.withColumn("_all", F.lit(0))
    return non_overlapping(d, list(keys) or ["_all"], ts, "_until", tie, rows).drop("_until", "_all")
