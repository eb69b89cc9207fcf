"""A sample of registered queries against their SQL on the smallest tables; check.py runs them all."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_module
from check import TABLES, key, norm, same

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "ticks_to_bars", "ohlcv_resample", "asof_join_backward", "rolling_mean_std", "macd", "rsi_wilder", "drawdown_episodes",
    "hit_target_stop", "pnl_by_symbol", "metric_summary", "level_distribution", "corr_matrix", "var_es", "twap_benchmark",
    "psi_drift", "ks_test", "classifier_metrics", "event_fanout", "non_overlapping_trades", "entry_win_rate",
]


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, db, name):
    df = entry_module.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    rel = db.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert len(rows) == len(want)
    assert all(same(a, b) for a, b in zip(rows, want))


def test_every_oracle_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["symbol", "entries", "wins", "win_rate"]
