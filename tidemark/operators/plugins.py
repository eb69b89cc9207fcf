"""Hooks for user functions: strategies, window functions, detectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.frames import BLOCK, HOME, ROW, Frames, framed


def apply_blocks(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    before: int,
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts",),
    chunk: Column | None = None,
    block_rows: int = 50_000,
) -> DataFrame:
    """Run a pandas function over ordered rows of each key, block by block.

    ``fn`` gets a block's rows in order with up to ``before`` rows of the block before it,
    must return a frame with the same index, and the extra rows are cut off again. A
    block has a bounded number of rows whatever the size of the key.
    """
    names = [f.split()[0] for f in schema.split(",")]
    keys = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ROW).reset_index(drop=True)
        home = pdf[HOME]
        out = fn(pdf.drop(columns=[HOME, ROW, BLOCK]))
        return out.loc[home.to_numpy()[out.index], names]

    def build(d: DataFrame, fr: Frames) -> DataFrame:
        out = d.drop("_pos").groupBy(*keys, BLOCK).applyInPandas(run, schema)
        return out.withColumns({HOME: F.lit(True), ROW: F.lit(0), BLOCK: F.lit(0), "_pos": F.lit(0)})

    return framed(df, build, before, keys=keys, order=order, chunk=chunk, block_rows=block_rows)


def run_strategies(
    df: DataFrame,
    strategy: Callable[[pd.DataFrame, dict], pd.DataFrame],
    params: Sequence[dict],
    schema: str,
    before: int,
    keys: Sequence[str] = ("symbol",),
    block_rows: int = 50_000,
) -> DataFrame:
    """A user strategy over every parameter set: ``param_id`` beside the columns of ``schema``."""
    sets = list(params)
    listed = df.withColumn("param_id", F.explode(F.array(*[F.lit(i) for i in range(len(sets))])))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = strategy(pdf, sets[int(pdf["param_id"].iloc[0])])
        return out.assign(param_id=pdf["param_id"])

    return apply_blocks(listed, fn, f"param_id INT, {schema}", before, ["param_id", *keys], block_rows=block_rows)


def run_detectors(df: DataFrame, detectors: dict[str, Callable[[DataFrame], DataFrame]], cols: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Findings of several detectors (table in, rows out) stacked with the detector's name."""
    found = [fn(df).select(*cols, F.lit(name).alias("detector")) for name, fn in detectors.items()]
    return reduce(DataFrame.unionByName, found)
