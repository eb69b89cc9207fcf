"""Alignment across symbols and keyed matching."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import div
from tidemark.session import settle


def common_timestamps(df: DataFrame, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Timestamps at which every symbol has a row."""
    pairs = df.select(key, ts).distinct()
    n_symbols = pairs.agg(F.count_distinct(key).alias("_n"))
    per_ts = pairs.groupBy(ts).agg(F.count(F.lit(1)).alias("_c"))
    return per_ts.join(F.broadcast(n_symbols), F.col("_c") == F.col("_n")).select(ts)


def aligned_with_market(df: DataFrame, x: str = "close", ts: str = "ts") -> DataFrame:
    """Rows at common timestamps, with the mean of ``x`` over symbols as ``market``."""
    common = common_timestamps(df, ts=ts)
    market = df.groupBy(ts).agg(F.avg(x).alias("market")).join(common, ts, "left_semi")
    return df.join(market, ts)


def with_market_returns(df: DataFrame, ret: str = "ret", reference: str | None = None, ts: str = "ts") -> DataFrame:
    """Left-join the mean return over symbols (and one reference symbol's return) by time.

    The joined table has one row per timestamp; adaptive execution broadcasts
    it when it is small and shuffles by time when it is not.
    """
    aggs = [F.avg(ret).alias("mkt_ret")]
    if reference is not None:
        aggs.append(F.max(F.when(F.col("symbol") == reference, F.col(ret))).alias("ref_ret"))
    return df.join(df.groupBy(ts).agg(*aggs), ts, "left")


def latest_snapshot(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Rows that carry the latest timestamp, of each key or of the table."""
    last = df.groupBy(*keys).agg(F.max(ts).alias("_last"))
    if keys:
        return df.join(last, list(keys)).where(F.col(ts) == F.col("_last")).drop("_last")
    return df.join(F.broadcast(last), F.col(ts) == F.col("_last"), "left_semi")


def orphans(signals: DataFrame, positions: DataFrame, executions: DataFrame, key: str = "key") -> DataFrame:
    """Signals without position, positions without execution, executions without signal or position."""
    a = signals.join(positions, key, "left_anti").select(key, F.lit("signal_without_position").alias("problem"))
    b = positions.join(executions, key, "left_anti").select(key, F.lit("position_without_execution").alias("problem"))
    parents = signals.select(key).union(positions.select(key)).distinct()
    c = executions.join(parents, key, "left_anti").select(key, F.lit("execution_without_parent").alias("problem"))
    return a.unionByName(b).unionByName(c)


def match_rates(pairs: Sequence[tuple[str, DataFrame, DataFrame]], key: str = "key") -> DataFrame:
    """Matched pairs and match rate = pairs / max(left rows, 1) for each named (left, right)."""
    out = None
    for name, left, right in pairs:
        hit = right.select(key).distinct().withColumn("_hit", F.lit(1))
        d = left.join(hit, key, "left").agg(
            F.lit(name).alias("pair"),
            F.count(F.lit(1)).alias("left_rows"),
            F.count("_hit").alias("matched"),
            (F.count("_hit") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("match_rate"),
        )
        out = d if out is None else out.unionByName(d)
    return out


SUMS = ("n", "sw", "sw2", "sx", "sy", "sxx", "syy", "sxy")
TILE = 256
_CELLS = 2_000_000  # of a time-by-symbol matrix


def _side(codes: pd.Series, values: pd.Series, width: int, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and presence of a tile's symbols, row by row."""
    sizes = codes.map(len).to_numpy()
    row, at = np.repeat(np.arange(len(codes)), sizes), np.concatenate(codes.to_list()) % tile
    x, m = np.zeros((len(codes), width)), np.zeros((len(codes), width))
    x[row, at], m[row, at] = np.concatenate(values.to_list()), 1.0
    return x, m


def _tile_sums(batches: Iterator[pd.DataFrame], width: int, diagonal: bool, tile: int) -> Iterator[pd.DataFrame]:
    """Matrix products of the rows of each pair of tiles, which come one after the other; a task holds one pair."""
    pair, acc = None, {}

    def close() -> pd.DataFrame:
        i, j = np.nonzero(acc["n"])
        a, b = pair[0] * tile + i, pair[1] * tile + j
        on = (a <= b) if diagonal else (a < b)
        return pd.DataFrame({"a": a[on], "b": b[on], **{k: v[i[on], j[on]] for k, v in acc.items()}})

    for pdf in batches:
        for key, part in pdf.groupby(["ta", "tb"], sort=False):
            if key != pair:
                if pair is not None:
                    yield close()
                pair, acc = key, {k: np.zeros((width, width)) for k in SUMS}
            for lo in range(0, len(part), max(1, _CELLS // width)):
                some = part.iloc[lo : lo + max(1, _CELLS // width)]
                (x, mx), (y, my) = _side(some["ca"], some["va"], width, tile), _side(some["cb"], some["vb"], width, tile)
                w = some["w"].to_numpy()[:, None]
                acc["n"] += mx.T @ my
                acc["sw"] += (mx * w).T @ my
                acc["sw2"] += (mx * w * w).T @ my
                acc["sx"] += (x * w).T @ my
                acc["sy"] += (mx * w).T @ y
                acc["sxx"] += (x * x * w).T @ my
                acc["syy"] += (mx * w).T @ (y * y)
                acc["sxy"] += (x * w).T @ y
    if pair is not None:
        yield close()


def pair_moments(
    df: DataFrame,
    x: str,
    at: Sequence[str] = ("ts",),
    name: str = "symbol",
    weight: Column | None = None,
    diagonal: bool = False,
    tile: int = TILE,
) -> DataFrame:
    """Weighted sums of every pair a < b (a <= b with ``diagonal``) of ``name`` over their common ``at``, one value per name there.

    Values are taken from their name's mean first, so that large values with small moves keep their
    digits; sums of such moves merge by adding. ``mxx``, ``myy``, ``mxy`` are the centred sums of squares and
    products, ``sx`` to ``sxy`` those of the values themselves.
    ``corr`` and ``cov`` are the unweighted ones and only meaningful without ``weight``.

    Names are numbered and cut into tiles of ``tile``; rows are gathered per ``at`` and tile and dealt by
    pairs of tiles, and a task multiplies the matrices of one pair of tiles at a time, however
    many names there are. One row per pair of names and task is shuffled, never one per pair and ``at``.
    """
    w = F.lit(1.0) if weight is None else weight
    known = df.where(F.col(x).isNotNull()).select(*at, F.col(name).cast("string").alias("_s"), F.col(x).cast("double").alias("_v"), w.cast("double").alias("_w"))
    names = known.groupBy("_s").agg(F.avg("_v").alias("_m"))
    names = settle(names.withColumn("_c", F.row_number().over(Window.orderBy("_s")) - 1))  # one row per name
    n_names = names.count()
    tiles = -(-n_names // tile)
    moves = known.join(names, known["_s"].eqNullSafe(names["_s"])).select(*at, "_c", (F.col("_v") - F.col("_m")).alias("_v"), "_w")
    rows = moves.groupBy(*at, F.floor(F.col("_c") / tile).alias("t")).agg(F.collect_list(F.struct("_c", "_v")).alias("_r"), F.max("_w").alias("w"))
    rows = rows.select(*at, "t", "w", F.col("_r._c").alias("c"), F.col("_r._v").alias("v"))
    sides = ["ta", "ca", "va", "tb", "cb", "vb", "w"]
    if tiles <= 1:
        dealt = rows.select("t", "c", "v", F.col("t").alias("tb"), F.col("c").alias("cb"), F.col("v").alias("vb"), "w").toDF(*sides)
    else:
        every = rows.groupBy(*at).agg(F.collect_list(F.struct("t", "c", "v")).alias("_all"), F.max("w").alias("w"))
        first = every.select(*at, "w", "_all", F.explode("_all").alias("_a"))
        both = first.select(*at, "w", "_a", F.explode(F.filter("_all", lambda b: b["t"] >= F.col("_a.t"))).alias("_b"))
        spread = F.pmod(F.xxhash64(*at), F.lit(16))
        cols = [F.col(f"_{k}.{c}").alias(f"{c}{k}") for k in "ab" for c in "tcv"]
        dealt = both.select(*cols, "w", spread.alias("_z")).repartition("ta", "tb", "_z").sortWithinPartitions("ta", "tb").select(*sides)
    width = max(1, min(tile, n_names))
    schema = "a BIGINT, b BIGINT, " + ", ".join(f"{c} DOUBLE" for c in SUMS)
    sums = dealt.mapInPandas(lambda batches: _tile_sums(batches, width, diagonal, tile), schema)
    d = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in SUMS]).withColumn("n", F.col("n").cast("bigint"))
    for k in "ab":
        d = d.join(names.select(F.col("_c").cast("bigint").alias(k), F.col("_s").alias(f"_{k}"), F.col("_m").alias(f"_m{k}")), k)
    n, sw, a, b = F.col("n"), F.col("sw"), F.col("_ma"), F.col("_mb")
    centred = {
        "mxy": F.col("sxy") - F.col("sx") * F.col("sy") / sw,
        "mxx": F.greatest(F.col("sxx") - F.col("sx") * F.col("sx") / sw, F.lit(0.0)),
        "myy": F.greatest(F.col("syy") - F.col("sy") * F.col("sy") / sw, F.lit(0.0)),
    }
    d = d.withColumns(centred).withColumns({"cov": div(F.col("mxy"), n - 1), "corr": div(F.col("mxy"), F.sqrt(F.col("mxx") * F.col("myy")))})
    whole = {
        "sxy": F.col("sxy") + a * F.col("sy") + b * F.col("sx") + sw * a * b, "sxx": F.col("sxx") + a * F.col("sx") * 2 + sw * a * a,
        "syy": F.col("syy") + b * F.col("sy") * 2 + sw * b * b, "sx": F.col("sx") + sw * a, "sy": F.col("sy") + sw * b,
    }
    d = d.withColumns(whole)
    return d.select(F.col("_a").alias("a"), F.col("_b").alias("b"), *SUMS, "mxx", "myy", "mxy", "cov", "corr")


def corr_matrix(df: DataFrame, x: str, at: Sequence[str] = ("ts",), name: str = "symbol") -> DataFrame:
    """Pearson correlation of every pair of symbols over their common timestamps."""
    return pair_moments(df, x, at, name).select("a", "b", "n", "corr")
