"""Exponential means against pandas, whatever the slices, the alphas and the values."""

import numpy as np
import pandas as pd
import pytest
from helpers import T0, bars_frame, close_to, pdf, walk

from tidemark.functions.core import time_chunk
from tidemark.operators.frames import CHUNK
from tidemark.operators.scans import Mean, exponential_means

ROWS = "symbol string, ts timestamp, x double"


def series(spark, xs):
    return spark.createDataFrame([("A", T0 + pd.Timedelta(hours=i), x) for i, x in enumerate(xs)], ROWS)


def relative(got, want, tol=1e-9):
    got, want = got.to_numpy(), want.to_numpy()
    assert (np.isnan(got) == np.isnan(want)).all()
    at = ~np.isnan(got)
    assert (np.abs(got - want)[at] <= tol * np.maximum(1.0, np.abs(want[at]))).all()


@pytest.mark.parametrize("hours", [7, 300, 100_000])
def test_any_alphas_at_once(spark, hours):
    b = walk(spark, 2500, ("A", "B"))
    alphas = [0.999, 0.5, 2 / 13, 0.01, 1e-5, 1.0]
    means = {f"{s}{i}": Mean("close", a, s) for i, a in enumerate(alphas) for s in ("first", "adjust")}
    if hours == 7:
        means = dict(list(means.items())[2:6])
    got = pdf(exponential_means(b, means, chunk=time_chunk("ts", hours * 3600)), "symbol", "ts")
    assert CHUNK not in got and list(got.columns) == [*b.columns, *means]
    for name, m in means.items():
        want = got.groupby("symbol")["close"].transform(lambda x, m=m: x.ewm(alpha=m.alpha, adjust=m.seed == "adjust").mean())
        close_to(got[name], want, 1e-8)


@pytest.mark.parametrize("hours", [1, 5, 64, 100_000])
def test_nulls_age_the_mean(spark, hours):
    rnd = np.random.default_rng(hours)
    xs = [None if i < 3 or rnd.random() < 0.4 or 40 <= i < 75 else float(rnd.normal()) for i in range(160)]
    means = {f"{s}_{k}": Mean("x", a, s) for s in ("first", "adjust") for k, a in enumerate((0.2, 0.9))}
    got = pdf(exponential_means(series(spark, xs), means, chunk=time_chunk("ts", hours * 3600)), "ts")
    for name, m in means.items():
        relative(got[name], got["x"].ewm(alpha=m.alpha, adjust=m.seed == "adjust").mean())


@pytest.mark.parametrize("far", [5, 450, 3000])
def test_outlier_far_back(spark, far):
    """1e30 among values of about 1: its share is still there for hundreds of rows, and is not lost or kept too long."""
    xs = [1.0, 2.0, 1e30] + [float(1 + i % 3) for i in range(far)]
    means = {"a": Mean("x", 0.1), "b": Mean("x", 0.1, "adjust"), "c": Mean("x", 0.6), "d": Mean("x", 0.97)}
    got = pdf(exponential_means(series(spark, xs), means, chunk=time_chunk("ts", 700 * 3600)), "ts")
    for name, m in means.items():
        relative(got[name], got["x"].ewm(alpha=m.alpha, adjust=m.seed == "adjust").mean())


def test_long_gap_and_small_values(spark):
    xs = [1e-150, None, 1e150] + [None] * 900 + [1.0, 0.0, 0.0]
    got = pdf(exponential_means(series(spark, xs), {"a": Mean("x", 0.7), "b": Mean("x", 0.7, "adjust")}), "ts")
    relative(got["a"], got["x"].ewm(alpha=0.7, adjust=False).mean())
    relative(got["b"], got["x"].ewm(alpha=0.7, adjust=True).mean())


def test_sma_seed(spark):
    means = {"e": Mean("close", 0.2, "sma", 5)}
    for hours in (3, 1000):
        got = pdf(exponential_means(bars_frame(spark, range(1, 30)), means, chunk=time_chunk("ts", hours * 3600)), "ts")
        x = np.arange(1, 30, dtype=float)
        want = [np.nan] * 4 + [3.0]
        for v in x[5:]:
            want.append(want[-1] * 0.8 + v * 0.2)
        close_to(got["e"], want)


def test_nothing_and_one_row(spark):
    means = {"a": Mean("x", 0.3), "b": Mean("x", 0.3, "adjust")}
    assert exponential_means(series(spark, []).limit(0), means).count() == 0
    assert [tuple(r)[3:] for r in exponential_means(series(spark, [None]), means).collect()] == [(None, None)]
    assert [tuple(r)[3:] for r in exponential_means(series(spark, [4.0]), means).collect()] == [(4.0, 4.0)]
