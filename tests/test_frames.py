import numpy as np
import pandas as pd
import pytest
from helpers import T0, bars_frame, close_to, pdf, walk
from pyspark.sql import functions as F

from tidemark.functions.core import time_chunk
from tidemark.operators.frames import CHUNK, balanced_chunks, framed, islands, prefix, with_row_number


def test_prefix_equals_plain_running_values_for_any_slice(spark):
    b = walk(spark, 300)
    want = pdf(b, "symbol", "ts")
    g = want.groupby("symbol")
    for hours in (1, 7, 10_000):
        d = prefix(
            b,
            {"s": ("sum", F.col("volume")), "m": ("max", F.col("close")), "l": ("min", F.col("close")), "n": ("count", F.lit(1)), "f": ("first", F.col("close"))},
            chunk=time_chunk("ts", 3600 * hours),
        )
        got = pdf(d, "symbol", "ts")
        close_to(got["s"], g["volume"].cumsum())
        close_to(got["m"], g["close"].cummax())
        close_to(got["l"], g["close"].cummin())
        close_to(got["n"], g.cumcount() + 1)
        close_to(got["f"], g["close"].transform("first"))


def test_prefix_last_skips_nulls_and_upto_excludes_the_row(spark):
    b = walk(spark, 100).withColumn("x", F.when(F.hour("ts") % 5 == 0, F.col("close")))
    d = pdf(prefix(b, {"l": ("last", F.col("x"))}, chunk=time_chunk("ts", 7200), upto=-1), "symbol", "ts")
    close_to(d["l"], d.groupby("symbol")["x"].transform(lambda s: s.ffill().shift(1)))


def test_balanced_chunks_split_a_hot_key_and_keep_order(spark):
    b = balanced_chunks(walk(spark, 1000), ["symbol"], ["ts"], rows=100)
    sizes = b.groupBy(CHUNK).count().toPandas()["count"]
    assert len(sizes) >= 8 and sizes.max() < 400
    rn = pdf(with_row_number(b, out="i"), "symbol", "ts")
    close_to(rn["i"], rn.groupby("symbol").cumcount() + 1)


@pytest.mark.parametrize("block", [60, 137, 50_000])
def test_frames_do_not_depend_on_blocks(spark, block):
    b = walk(spark, 400)

    def build(d, fr):
        d = d.withColumns({"m": fr.mean("close", 20), "s": fr.std("close", 20), "p": fr.pct("close", 3), "a": F.max("high").over(fr.span(1, 5))})
        return d.withColumn("mm", fr.mean("m", 10))

    got = pdf(framed(b, build, before=31, after=5, block_rows=block), "symbol", "ts")
    g = got.groupby("symbol")
    assert len(got) == 480
    m = g["close"].transform(lambda x: x.rolling(20).mean())
    close_to(got["m"], m, 1e-8)
    close_to(got["s"], g["close"].transform(lambda x: x.rolling(20).std()), 1e-8)
    close_to(got["p"], g["close"].transform(lambda x: x / x.shift(3) - 1))
    close_to(got["mm"], m.groupby(got["symbol"]).transform(lambda x: x.rolling(10).mean()), 1e-8)
    close_to(got["a"], g["high"].transform(lambda x: x[::-1].rolling(5, min_periods=1).max()[::-1].shift(-1)))


def test_islands_with_nulls(spark):
    states = ["a", "a", None, None, "b", "a", "a", None]
    df = spark.createDataFrame([("A", T0 + pd.Timedelta(hours=i), s) for i, s in enumerate(states)], "symbol string, ts timestamp, state string")
    got = pdf(islands(df, "state", chunk=time_chunk("ts", 7200)), "ts")
    assert got["island"].tolist() == [1, 1, 2, 2, 3, 4, 4, 5]


def test_empty_and_single_row(spark):
    empty = bars_frame(spark, [])
    f = lambda d, fr: d.withColumn("m", fr.mean("close", 3))
    assert framed(empty, f, before=3).count() == 0
    one = framed(bars_frame(spark, [5.0]), f, before=3).collect()
    assert len(one) == 1 and one[0]["m"] is None
