"""Keyed stream state: rows of a key in order of time, with what came before them.

``in_order`` waits for the watermark, so rows that come late but within the
delay take their place and results do not depend on the batches. Rows wait in
a map state of time slots, packed, so a key's batch is held slot by slot and
never as a whole. When a timer says that a slot is complete, its rows go
through a ``Step`` together with the carry, the only thing kept of earlier rows
(the last hundred values, or the start of a violation). Rows behind the
watermark are left out and counted. A key without rows for ``keep`` of event
time loses its state, and starts anew with its next row.

Steps are numpy functions of (carry, rows) and are the same on a table cut anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

Rows = np.ndarray  # structured: us, tie and the value columns
Run = Callable[[bytes, Rows], tuple[bytes, dict[str, np.ndarray]]]


@dataclass(frozen=True)
class Step:
    """``values``: double columns it reads; ``out``: schema of its result without key, ``ts`` and tie.

    ``run`` takes the carry (empty at first) and rows in order; it gives the new carry and
    columns with ``at``, the places of the rows they belong to.
    """

    values: tuple[str, ...]
    out: str
    run: Run

    @property
    def kind(self) -> np.dtype:
        return np.dtype([("us", "<i8"), ("tie", "<i8"), *[(v, "<f8") for v in self.values]])


class _InOrder(StatefulProcessor):
    def __init__(self, step: Step, key: str, slot_us: int, keep_ms: int, columns: list[str], tie: str):
        self.step, self.key, self.slot_us, self.keep_ms, self.columns, self.tie = step, key, slot_us, keep_ms, columns, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot BIGINT", "rows BINARY")
        self.carry = handle.getValueState("carry", "data BINARY, seen BIGINT")

    def _frame(self, name, d: pd.DataFrame) -> pd.DataFrame:
        d[self.key] = pd.Series([name] * len(d), dtype=object)
        return d[self.columns]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, late, armed = timerValues.getCurrentWatermarkInMs() * 1000, 0, set()
        for d in rows:
            stamps = d["ts"].dt.tz_localize(None) if d["ts"].dt.tz is not None else d["ts"]
            packed = np.zeros(len(d), self.step.kind)
            packed["us"], packed["tie"] = stamps.astype("datetime64[us]").astype("int64"), d[self.tie]
            for v in self.step.values:
                packed[v] = d[v]
            behind = packed["us"] < mark
            late, packed = late + int(behind.sum()), packed[~behind]
            slots = packed["us"] // self.slot_us
            for slot in np.unique(slots).tolist():
                held = self.waiting.getValue((slot,))
                self.waiting.updateValue((slot,), ((held[0] if held else b"") + packed[slots == slot].tobytes(),))
                armed.add(slot)
        for slot in armed:
            self.handle.registerTimer((slot + 1) * self.slot_us // 1000)
        if late:
            yield self._frame(key[0], pd.DataFrame({c: pd.Series([late if c == "late" else None], dtype=object) for c in self.columns}))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        carry, seen = self.carry.get() if self.carry.exists() else (b"", None)
        slot = due // self.slot_us - 1
        held = self.waiting.getValue((slot,)) if due % self.slot_us == 0 else None
        if held is None:  # a timer for idle keys
            if seen is not None and due >= seen + self.keep_ms * 1000 and next(iter(self.waiting.keys()), None) is None:
                self.carry.clear()
            return
        rows = np.sort(np.frombuffer(held[0], self.step.kind), order=["us", "tie"])
        self.waiting.removeKey((slot,))
        carry, out = self.step.run(bytes(carry), rows)
        seen = int(rows["us"][-1])
        self.carry.update((carry, seen))
        self.handle.registerTimer(seen // 1000 + self.keep_ms + 1)
        at = out.pop("at")
        found = pd.DataFrame({"ts": rows["us"][at].astype("datetime64[us]"), self.tie: rows["tie"][at], **out})
        found["late"] = pd.Series([None] * len(found), dtype=object)
        yield self._frame(key[0], found)


def in_order(stream: DataFrame, step: Step, delay: str = "10 minutes", slot: str = "10 minutes", keep: str = "1 day", key: str = "name", tie: str = "event_id") -> DataFrame:
    """Results of ``step`` on a stream with ``key`` (string), ``ts``, ``tie`` (bigint) and the step's values.

    Results come when the watermark has passed the end of their ``slot`` of time. Rows that come behind
    the watermark are left out: most are dropped and counted by Spark (``late_rows`` of
    ``run.ProgressLog``), those of its last step forward show as rows with ``late``, their number, instead of results.
    Needs ``uses_rocks`` around the start of the query.
    """
    us = lambda text: int(pd.Timedelta(text).total_seconds() * 1_000_000)
    schema = f"{key} STRING, ts TIMESTAMP, {tie} BIGINT, {step.out}, late BIGINT"
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    work = _InOrder(step, key, us(slot), us(keep) // 1000, columns, tie)
    rows = stream.select(key, "ts", tie, *[F.col(v).cast("double").alias(v) for v in step.values]).withWatermark("ts", delay)
    return rows.groupBy(key).transformWithStateInPandas(work, schema, "append", "eventTime")


class uses_rocks:
    """``with uses_rocks(spark):`` queries started inside keep their state in RocksDB, as map state and timers need."""

    def __init__(self, spark):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(PROVIDER, None)
        self.conf.set(PROVIDER, ROCKS)

    def __exit__(self, *_) -> None:
        if self.before is None:
            self.conf.unset(PROVIDER)
        else:
            self.conf.set(PROVIDER, self.before)


def over_table(rows: pd.DataFrame, step: Step, cuts: Sequence[int] = ()) -> pd.DataFrame:
    """``step`` over one key's rows in order, cut at the given places: for tests and small tables."""
    packed = np.zeros(len(rows), step.kind)
    for name in step.kind.names:
        packed[name] = rows[name]
    carry, parts = b"", []
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        if hi > lo:
            carry, out = step.run(carry, packed[lo:hi])
            parts.append(pd.DataFrame({**out, "at": out["at"] + lo}))
    return pd.concat(parts, ignore_index=True)


# --- steps ---


def _with_before(carry: bytes, rows: Rows, most: int) -> tuple[bytes, Rows, int]:
    """Rows with up to ``most`` before them, how many those are, and the carry for the next rows."""
    old = np.frombuffer(carry, rows.dtype)
    both = np.concatenate((old, rows))
    return both[-most:].tobytes(), both, len(old)


def _windows(x: np.ndarray, n: int) -> np.ndarray:
    """The n values up to each place, with NaN before the first."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(n - 1, np.nan), x)), n)


_BLOCK = 20_000  # windows whose order statistics are taken at once


def _quantile(x: np.ndarray, n: int, q: float) -> np.ndarray:
    """Linear-interpolated quantile of the values among the n up to each place; exact."""
    every, out = _windows(x, n), np.full(len(x), np.nan)
    for lo in range(0, len(x), _BLOCK):
        w = np.sort(every[lo : lo + _BLOCK], axis=1)  # NaN last
        have = n - np.isnan(w).sum(axis=1)
        place = q * np.maximum(have - 1, 0)
        low, row = np.floor(place).astype(int), np.arange(len(w))
        a, b = w[row, low], w[row, np.minimum(low + 1, np.maximum(have - 1, 0))]
        out[lo : lo + _BLOCK] = a + (b - a) * (place - low)
    return out


def _mean_std(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values among the n up to each place: how many, mean, sample deviation."""
    w = _windows(x, n)
    have = n - np.isnan(w).sum(axis=1)
    some = np.maximum(have, 1)
    mean = np.nansum(w, axis=1) / some
    square = np.nansum((w - mean[:, None]) ** 2, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return have, np.where(have > 0, mean, np.nan), np.where(have > 1, np.sqrt(square / (have - 1)), np.nan)


def trailing_thresholds(n: int = 100, q: float = 0.95, k: float = 3.0, min_rows: int = 20) -> Step:
    """Rows above the percentile or mean + k deviations of the n rows before them; twin of ``alerts.dynamic_thresholds``."""

    def run(carry: bytes, rows: Rows) -> tuple[bytes, dict[str, np.ndarray]]:
        kept, both, old = _with_before(carry, rows, n)
        value = both["value"]
        before = np.concatenate(([np.nan], value[:-1]))
        pct = _quantile(before, n, q)
        have, mean, std = _mean_std(before, n)
        sigma = mean + k * std
        ready = have >= min_rows
        pct, sigma = np.where(ready, pct, np.nan), np.where(ready, sigma, np.nan)
        over = (value > pct) | (value > sigma)
        at = np.flatnonzero(over[old:])
        there = at + old
        return kept, {
            "at": at, "value": value[there], "limit_pct": pct[there], "limit_sigma": sigma[there],
            "above_pct": value[there] > pct[there], "above_sigma": value[there] > sigma[there],
        }

    return Step(("value",), "value DOUBLE, limit_pct DOUBLE, limit_sigma DOUBLE, above_pct BOOLEAN, above_sigma BOOLEAN", run)


def trailing_anomalies(n: int = 100, floor: float = 0.10, window: int = 20, z_limit: float = 3.0, factor: float = 3.0, frozen: int = 5, min_rows: int = 20) -> Step:
    """Four detectors on the last n rows of a key: spike, volume, gap, frozen price; twin of ``quality.trailing_anomalies``.

    The result has a row for each detector that finds something, numbered 0 to 3 in this order.
    """

    def run(carry: bytes, rows: Rows) -> tuple[bytes, dict[str, np.ndarray]]:
        kept, both, old = _with_before(carry, rows, n + 1)
        price, volume = both["price"], both["volume"]
        m = len(both)
        last = np.concatenate(([np.nan], price[:-1]))
        with np.errstate(invalid="ignore", divide="ignore"):
            change = np.abs(np.where(last != 0, price / last - 1, np.nan))
        gap = np.diff(both["us"], prepend=both["us"][:1]) / 1e6
        gap[0] = np.nan
        seen = np.arange(1, m + 1)
        spike = (seen >= min_rows) & (change > np.maximum(_quantile(change, n, 0.99), floor))
        have, mean, std = _mean_std(volume, window)
        with np.errstate(invalid="ignore", divide="ignore"):
            z = np.where(std > 0, (volume - mean) / std, np.nan)
        odd = (have >= window) & (np.abs(z) > z_limit)
        hole = (seen >= frozen) & (gap > factor * _quantile(gap, n, 0.5))
        same = np.concatenate(([False], price[1:] == price[:-1]))
        still = np.convolve(same, np.ones(frozen))[:m] >= frozen
        hits = np.stack((spike, odd, hole, still))[:, old:]
        which, at = np.nonzero(hits)
        order = np.lexsort((which, at))
        return kept, {"at": at[order], "detector": which[order]}

    return Step(("price", "volume"), "detector INT", run)


def trailing_flow() -> Step:
    """Momentum and slope of the mid over 10 snapshots, depth change over 5, updates per second; twin of ``book.book_flow``."""

    def run(carry: bytes, rows: Rows) -> tuple[bytes, dict[str, np.ndarray]]:
        kept, both, old = _with_before(carry, rows, 9)
        mid, depth = both["mid"], both["depth"]
        back = lambda x, k: np.concatenate((np.full(k, np.nan), x[:-k] if k < len(x) else x[:0]))[: len(x)]
        ratio = lambda a, b: np.divide(a, b, out=np.full(len(a), np.nan), where=(b != 0) & ~np.isnan(b))
        t = np.arange(10) - 4.5
        w = _windows(mid, 10)
        slope = ((w - w.mean(axis=1, keepdims=True)) * t).sum(axis=1) / (t * t).sum()
        seconds = (both["us"] - back(both["us"].astype(float), 9)) / 1e6
        out = {"momentum": ratio(mid, back(mid, 9)) - 1, "slope": slope, "depth_change": ratio(depth, back(depth, 4)) - 1, "update_rate": ratio(np.full(len(mid), 9.0), seconds)}
        return kept, {"at": np.arange(len(rows)), **{k: v[old:] for k, v in out.items()}}

    return Step(("mid", "depth"), "momentum DOUBLE, slope DOUBLE, depth_change DOUBLE, update_rate DOUBLE", run)


def cooldown(limit: float, duration: float, spacing: float) -> Step:
    """An alert where the value has been above the limit for ``duration`` seconds, ``spacing`` seconds after the last one.

    The carry is the start of the violation and the time of the last alert; twin of ``alerts.spell_alerts``.
    """
    none = np.iinfo(np.int64).min

    def run(carry: bytes, rows: Rows) -> tuple[bytes, dict[str, np.ndarray]]:
        since, last = np.frombuffer(carry, np.int64).tolist() if carry else (none, none)
        us, above = rows["us"], rows["value"] > limit
        starts = above & ~np.concatenate(([since != none], above[:-1]))
        begun = np.where(above, np.maximum.accumulate(np.where(starts, us, since)), none)  # spells begin later and later
        ready = np.flatnonzero(above & (us - begun >= duration * 1e6))
        at, k = [], 0
        while k < len(ready):  # once for each alert
            if last != none:
                k = max(k, int(np.searchsorted(us[ready], last + spacing * 1e6, "left")))
            if k < len(ready):
                at.append(ready[k])
                last = int(us[ready[k]])
                k += 1
        since = int(begun[-1]) if above[-1] else none
        return np.array([since, last], np.int64).tobytes(), {"at": np.array(at, int), "value": rows["value"][np.array(at, int)]}

    return Step(("value",), "value DOUBLE", run)
