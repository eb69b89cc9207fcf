from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import draws as D
from tidemark.operators import validation as V


def by_hashlib(ids, words):
    raw = [b"".join(md5(f"{k}|{i}".encode()).digest() for k in range(-(-words // 4))) for i in ids]
    return np.array([np.frombuffer(r, ">u4")[:words] for r in raw])


@pytest.mark.parametrize("words", [1, 7, 43, 313, 4_100])
def test_draws_are_quarters_of_md5(words, monkeypatch):
    monkeypatch.setattr(D, "ROWS", 5)
    ids = [str(i) for i in range(95, 108)] + ["", "-7", "\u00e9\0", *("x" * n for n in range(48, 58)), "z" * 200]  # one block of md5 and more
    got = np.full((len(ids), words), 2**33)
    for rows, numbers, drawn in D.draws(ids, words):
        assert (got[np.ix_(rows, numbers)] == 2**33).all()  # each once
        got[np.ix_(rows, numbers)] = drawn.T
    assert (got == by_hashlib(ids, words)).all()


def test_null_ids(spark):
    d = spark.createDataFrame([(None, 2.0), (1, -1.0), (2, 3.0)], "i bigint, x double").withColumn("a", F.col("x") > 0)
    whole = V.sign_flip_test(d, "x", "i", 64).first()
    bits = np.unpackbits(by_hashlib([1, 2], 2).astype("<u4").view(np.uint8).reshape(2, -1), axis=1, bitorder="little")
    mean = (2.0 - (1.0 - 2 * bits[0]) + 3 * (1.0 - 2 * bits[1])) / 3  # the sign of a row without id stays
    assert whole["percentile"] == pytest.approx(100 * np.mean(mean <= 4 / 3))
    assert V.bootstrap_difference(d, "x", "i", F.col("a"), 40).collect() == V.bootstrap_difference(d.where("i is not null"), "x", "i", F.col("a"), 40).collect()


def test_rows_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(V, "DRAW_ROWS", 10)
    d = spark.range(95).select("id", (F.col("id") % 7 - 3).cast("double").alias("x"), (F.col("id") % 2).alias("k")).coalesce(1)
    assert V._draw_tasks(d) == 10

    def both():
        flips = V.sign_flip_test(d, "x", "id", 100, ["k"]).orderBy("k").collect()
        return [tuple(r) for r in flips], tuple(V.bootstrap_difference(d, "x", "id", F.col("k") == 1, 50).first())

    cut = both()
    monkeypatch.setattr(V, "DRAW_ROWS", 1_000)
    whole = both()
    assert cut[0] == whole[0] and cut[1] == pytest.approx(whole[1], rel=1e-12)
