"""Nothing is cut: whole histories, bins that follow the data, nulls and case in filters and hashes."""

import numpy as np
import pandas as pd
import pytest
from helpers import T0, pdf
from pyspark.sql import functions as F

from tidemark.operators import order_stats as O
from tidemark.operators.reports import dynamic_filter
from tidemark.operators.rolling import expanding_percentile
from tidemark.sources.scan import content_hash, snapshot_diff


def test_null_that_changes_column(spark):
    a = spark.createDataFrame([(1, 1, None), (2, None, None)], "k int, a int, b int")
    b = spark.createDataFrame([(1, None, 1), (2, None, None), (3, 1, 1)], "k int, a int, b int")
    assert {r.k: r.status for r in snapshot_diff(a, b, ["k"]).collect()} == {1: "changed", 2: "same", 3: "added"}
    assert content_hash(a).first() != content_hash(b.where("k < 3")).first()
    assert content_hash(a).first() == content_hash(a.orderBy(F.desc("k"))).first()


def test_filter_keeps_case_unless_named(spark):
    d = spark.createDataFrame([("click", "BUY", T0), ("CLICK", "SELL", T0)], "kind string, side string, ts timestamp")
    assert [r.kind for r in dynamic_filter(d, {"kind": "click"}).collect()] == ["click"]
    assert [r.kind for r in dynamic_filter(d, {"side": "sell"}).collect()] == ["CLICK"]


def test_bins_follow_the_data(spark):
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"k": rng.integers(0, 2, 30_000), "x": rng.integers(0, 10_000, 30_000).astype(float)})
    d = spark.createDataFrame(x)
    placed = O._binned(d, F.col("x"), ["k"], {"n": F.lit(1)}, 500)
    sizes = placed.groupBy("k", "_chunk").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 2_000 and sizes[1] > 20
    ranks = {"low": F.floor(F.col("_total") * 0.1), "mid": F.floor(F.col("_total") * 0.5)}
    for per_bin in (500, 10**9):
        got = pdf(O.order_statistics(d, F.col("x"), ranks, ["k"], per_bin), "k")
        for k, g in x.groupby("k"):
            v = np.sort(g.x.to_numpy())
            assert (got.low[k], got.mid[k]) == (v[int(len(v) * 0.1)], v[int(len(v) * 0.5)])
        c = pdf(O.ordered_counts(d, F.col("x"), ["k"], per_bin=per_bin), "k", "value")
        assert (c.n_before == c.groupby("k").n.cumsum() - c.n).all()


@pytest.mark.parametrize("block", [4, 512])
def test_percentile_of_the_whole_history(spark, block):
    rng = np.random.default_rng(5)
    x = [None if i % 17 == 3 else float(v) for i, v in enumerate(rng.integers(0, 40, 700))]
    rows = [(s, T0 + pd.Timedelta(minutes=i).to_pytimedelta(), v) for s in ("A", "B") for i, v in enumerate(x[: 700 if s == "A" else 9])]
    got = pdf(expanding_percentile(spark.createDataFrame(rows, "symbol string, ts timestamp, x double"), "x", block=block), "symbol", "ts")
    want = []
    for s in ("A", "B"):
        seen = []
        for r in rows:
            if r[0] == s:
                if r[2] is None:
                    want.append(np.nan)
                    continue
                seen.append(r[2])
                below, upto = sum(v < r[2] for v in seen), sum(v <= r[2] for v in seen)
                want.append((below + upto + 1) * 50 / len(seen))
    assert np.allclose(got.percentile.astype(float), want, equal_nan=True)


def test_regular_grid_keeps_few_steps():
    """Chains of different phase never meet on a regular grid; only steps within one interval of the slice's start stay."""
    from tidemark.operators import sequences as Q

    start = np.arange(100_000) * 300
    leave = Q._leave(start, start + 7_200)
    want = start + 7_200
    for i in range(len(start) - 25, -1, -1):
        want[i] = want[i + 24]
    assert (leave == want).all() and len(np.unique(leave)) <= 24


def test_spacing_on_a_regular_grid(spark):
    from tidemark.operators.sequences import space_out

    rows = [(s, T0 + pd.Timedelta(minutes=5 * i).to_pytimedelta()) for s in ("A", "B") for i in range(600 if s == "A" else 30)]
    d = spark.createDataFrame(rows, "symbol string, ts timestamp")
    got = sorted((r.symbol, r.ts) for r in space_out(d, 7_200, ["symbol"], rows=70).collect())
    assert got == sorted(r for i, r in enumerate(rows) if (i if r[0] == "A" else i - 600) % 24 == 0)
