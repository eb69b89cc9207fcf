"""Covariance, portfolio returns, exposure weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import epoch_s
from tidemark.operators.frames import BAR_CHUNK, prefix
from tidemark.operators.joins import pair_moments


def recency_weights(df: DataFrame, decay: float, ts: str = "ts") -> DataFrame:
    """One row per timestamp with weight decay^k, k = number of later timestamps."""
    stamps = df.select(ts).distinct().withColumn("_neg", -epoch_s(ts))
    d = prefix(stamps, {"_k": ("count", F.lit(1))}, [], ["_neg"], F.floor(F.col("_neg") / F.lit(BAR_CHUNK)), upto=-1)
    return d.select(ts, F.pow(F.lit(decay), F.col("_k")).alias("_weight"))


def ewma_covariance(df: DataFrame, x: str, decay: float, ts: str = "ts") -> DataFrame:
    """Covariance of every symbol pair (a <= b) with weights decay^age and the reliability-weight correction.

    The newest timestamp has weight 1; correction is sum(w) - sum(w^2) / sum(w).
    """
    d = df.where(F.col(x).isNotNull())
    d = d.join(recency_weights(d, decay, ts), ts)
    m = pair_moments(d, x, [ts], weight=F.col("_weight"), diagonal=True)
    cov = F.col("mxy") / (F.col("sw") - F.col("sw2") / F.col("sw"))
    return m.select("a", "b", "n", cov.alias("cov"))


def symmetric(pairs: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Both orders of every pair a <= b."""
    other = pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), *cols)
    return pairs.select("a", "b", *cols).unionByName(other)
