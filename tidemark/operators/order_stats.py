"""Exact ranks and quantiles of whole groups, without sorting a group in one task.

Everything rests on ``_binned``: rows are first counted per distinct value
(combined before the shuffle and spread by value, so a hot key does not land in
one task), and the table of distinct values, written once, is cut into ordered
bins of about ``per_bin`` values. The number of bins follows the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.frames import CHUNK, balanced_chunks, prefix
from tidemark.session import settle

PER_BIN = 200_000
VALUE = "value"


def _binned(df: DataFrame, x: Column, keys: list[str], weights: dict[str, Column], per_bin: int) -> DataFrame:
    """Distinct values with their weights and an ordered bin number in the slice column."""
    hist = (
        df.select(*keys, x.alias(VALUE), *[w.alias(f"_w_{k}") for k, w in weights.items()])
        .where(F.col(VALUE).isNotNull())
        .groupBy(*keys, VALUE)
        .agg(*[F.sum(f"_w_{k}").alias(k) for k in weights])
    )
    hist = settle(hist)
    if hist.count() <= per_bin:
        return hist.withColumn(CHUNK, F.lit(0).cast("bigint"))
    return balanced_chunks(hist, keys, [VALUE], per_bin)


def ordered_counts(
    df: DataFrame,
    x: Column,
    keys: Sequence[str] = (),
    weights: dict[str, Column] | None = None,
    per_bin: int = PER_BIN,
) -> DataFrame:
    """Distinct values of ``x`` per key with counts here and before.

    Columns: keys, ``value``, and for each weight name (default ``n`` = rows)
    ``name`` (sum at this value) and ``name_before`` (sum over smaller values).
    Null values of ``x`` are left out.
    """
    keys = list(keys)
    weights = weights or {"n": F.lit(1)}
    placed = _binned(df, x, keys, weights, per_bin)
    out = prefix(
        placed, {f"{k}_upto": ("sum", F.col(k)) for k in weights}, keys, [VALUE], F.col(CHUNK)
    ).drop(CHUNK)
    return out.withColumns({f"{k}_before": F.col(f"{k}_upto") - F.col(k) for k in weights}).drop(
        *[f"{k}_upto" for k in weights]
    )


def join_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach per-key statistics; with no keys ``stats`` is a one-row aggregate."""
    return df.join(stats, list(keys), "left") if keys else df.join(F.broadcast(stats), how="left")


def order_statistics(
    df: DataFrame, x: Column, ranks: dict[str, Column], keys: Sequence[str] = (), per_bin: int = PER_BIN
) -> DataFrame:
    """Values at 0-based ascending ranks per key: keys, ``_total`` rows, one column per entry of ``ranks``.

    A rank is a Column that may use ``_total``. Bin counts tell which bins hold the ranks; only
    the values of those bins are shuffled and ordered.
    """
    keys = list(keys)
    placed = _binned(df, x, keys, {"n": F.lit(1)}, per_bin)
    w = Window.partitionBy(*keys)  # one row per bin
    table = placed.groupBy(*keys, CHUNK).agg(F.sum("n").alias("_bn")).withColumns(
        {
            "_total": F.sum("_bn").over(w),
            "_below": F.coalesce(F.sum("_bn").over(w.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    holds = F.lit(False)
    for r in ranks.values():
        holds = holds | ((r >= F.col("_below")) & (r < F.col("_below") + F.col("_bn")))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(VALUE).rowsBetween(Window.unboundedPreceding, 0)
    near = placed.join(table.where(holds), [*keys, CHUNK]).withColumn("_upto", F.col("_below") + F.sum("n").over(inside))

    def at(r: Column) -> Column:
        return F.max(F.when((r < F.col("_upto")) & (r >= F.col("_upto") - F.col("n")), F.col(VALUE)))

    return near.groupBy(*keys).agg(F.max("_total").alias("_total"), *[at(r).alias(name) for name, r in ranks.items()])


def exact_quantiles(df: DataFrame, x: Column, probs: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles per key: keys, one column per entry of ``probs``.

    Same rule as numpy, pandas and ``percentile``: position p * (n - 1) between
    the two neighbouring order statistics.
    """
    keys = list(keys)

    def pos(p: float) -> Column:
        return F.round(F.lit(float(p)) * (F.col("_total") - 1), 9)  # 0.7 * 660 must be 462

    ranks = {}
    for name, p in probs.items():
        ranks[f"_lo_{name}"], ranks[f"_hi_{name}"] = F.floor(pos(p)), F.ceil(pos(p))
    got = order_statistics(df, x, ranks, keys)
    return got.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (pos(p) - F.floor(pos(p)))).alias(n)
            for n, p in probs.items()
        ],
    )


def exact_order_statistic(
    df: DataFrame, x: Column, index: Column, keys: Sequence[str] = (), out: str = "value_at"
) -> DataFrame:
    """The value at 0-based ``index`` in ascending order; ``index`` may use ``_total``."""
    return order_statistics(df, x, {out: index}, keys).drop("_total")


def average_rank() -> Column:
    """Average rank (1-based, ties share their mean) of a row of ``ordered_counts``."""
    return F.col("n_before") + (F.col("n") + 1) / 2
