import datetime as dt

import numpy as np
import pandas as pd

T0 = dt.datetime(2024, 1, 1)


def bars_frame(spark, closes, symbol="A", minutes=60, gaps=()):
    rows = [
        (symbol, T0 + dt.timedelta(minutes=minutes * i), float(c), float(c) + 1, float(c) - 1, float(c), 10.0 + i % 3)
        for i, c in enumerate(closes)
        if i not in gaps
    ]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def walk(spark, n=500, symbols=("A", "B"), seed=1):
    """Random bars; symbol A has far more rows than the others."""
    rng = np.random.default_rng(seed)
    rows = []
    for k, s in enumerate(symbols):
        m = n if k == 0 else n // 5
        c = (100 * np.exp(np.cumsum(rng.normal(0, 0.01, m)))).tolist()
        for i in range(m):
            rows.append((s, T0 + dt.timedelta(hours=i), c[i] * 0.999, c[i] * 1.01, c[i] * 0.99, c[i], float(rng.integers(1, 50))))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def pdf(df, *order):
    d = df.toPandas()
    return d.sort_values(list(order)).reset_index(drop=True) if order else d


def close_to(a, b, tol=1e-9):
    a, b = pd.Series(a, dtype="float64"), pd.Series(b, dtype="float64")
    assert (a.isna().to_numpy() == b.isna().to_numpy()).all()
    assert np.nanmax(np.abs(a.to_numpy() - b.to_numpy()), initial=0.0) <= tol
