"""Returns and other one-series columns that most operators start from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.frames import framed


def with_returns(
    df: DataFrame, x: str = "close", out: str = "ret", keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",)
) -> DataFrame:
    """Change against the row before, null on the first row."""
    return framed(df, lambda d, fr: d.withColumn(out, fr.pct(x)), before=1, keys=keys, order=order)
