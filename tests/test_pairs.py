"""Pair sums in tiles of symbols."""

import numpy as np
import pandas as pd
import pytest
from helpers import T0, pdf

from tidemark.operators.joins import pair_moments


def thin(spark, symbols, stamps, each, level=0.0, seed=3):
    """``each`` symbols at every stamp."""
    rnd = np.random.default_rng(seed)
    rows = [(T0 + pd.Timedelta(hours=t), f"s{k:05d}", float(level + rnd.normal())) for t in range(stamps) for k in rnd.choice(symbols, each, replace=False)]
    return spark.createDataFrame(rows, "ts timestamp, symbol string, x double"), pd.DataFrame(rows, columns=["ts", "symbol", "x"])


@pytest.mark.parametrize("tile", [4, 7, 256])
@pytest.mark.parametrize("diagonal", [True, False])
def test_tiles_do_not_matter(spark, tile, diagonal):
    d, p = thin(spark, 12, 40, 6, 1e5)
    wide = p.pivot(index="ts", columns="symbol", values="x")
    got = pdf(pair_moments(d, "x", diagonal=diagonal, tile=tile), "a", "b")
    pairs = [(a, b) for i, a in enumerate(wide) for b in wide.columns[i if diagonal else i + 1 :] if (wide[a].notna() & wide[b].notna()).any()]
    assert list(zip(got["a"], got["b"])) == pairs
    for r in got.itertuples():
        both = wide[[r.a, r.b]].dropna().to_numpy()
        assert r.n == len(both)
        np.testing.assert_allclose([r.sx, r.sy, r.sxy], [both[:, 0].sum(), both[:, 1].sum(), (both[:, 0] * both[:, 1]).sum()], rtol=1e-12)
        if r.n > 1:
            np.testing.assert_allclose(r.cov, np.cov((both - 1e5).T)[0, 1], rtol=1e-9, atol=1e-12)


def test_large_values_with_small_moves(spark):
    d, p = thin(spark, 3, 400, 3, 1e5)
    p["x"] = 1e5 + (p["x"] - 1e5) * 1e-4
    d = spark.createDataFrame([(t.to_pydatetime(), n, float(v)) for t, n, v in p.itertuples(index=False)], "ts timestamp, symbol string, x double")
    want = p.pivot(index="ts", columns="symbol", values="x").corr()
    for r in pair_moments(d, "x").collect():
        assert abs(r.corr - want.loc[r.a, r.b]) < 1e-7


def test_two_thousand_symbols_at_thin_stamps(spark):
    d, p = thin(spark, 2000, 60, 40)
    got = pair_moments(d, "x").selectExpr("sum(n) as n", "count(*) as pairs", "sum(sxy) as s").first()
    assert got.n == 60 * 40 * 39 // 2
    total = p.groupby("ts")["x"].agg(lambda x: (x.sum() ** 2 - (x * x).sum()) / 2).sum()
    assert abs(got.s - total) < 1e-6


def test_nothing(spark):
    d, _ = thin(spark, 3, 1, 1)
    assert pair_moments(d.limit(0), "x").count() == 0 and pair_moments(d, "x").count() == 0
