"""Ordered windows that do not need a whole key in one task.

``Window.partitionBy("symbol")`` sends all rows of a symbol to one task, and
with few symbols that is the whole table in a handful of tasks. The helpers
here cut each key into slices that are spread over the cluster and still give
exactly the rows the uncut window would give:

* ``prefix``  - running sum, count, max, min, last value. Each time slice is
  aggregated on its own, the per-slice results are accumulated in order (one
  small row per slice), and the total before a slice is added to the running
  value inside it.
* ``framed``  - frames of a bounded number of rows. Rows are numbered per key,
  cut into blocks of equal size, and the rows a frame can reach into a
  neighbouring block are copied there.

Exponential means are in ``scans``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.core import col, time_chunk
from tidemark.session import settle

CHUNK = "_chunk"
ROW = "_rn"
BLOCK = "_block"
HOME = "_home"
POS = "_pos"

DAY = 86_400
BAR_CHUNK = 30 * DAY  # bars are unique per (symbol, ts): at most 43,200 one-minute bars
BLOCK_ROWS = 50_000



def stored_chunk(df: DataFrame) -> list[str]:
    """The slice column if the table carries one, for select lists."""
    return [CHUNK] if CHUNK in df.columns else []


def tidy(out: DataFrame, source: DataFrame) -> DataFrame:
    """Drop the slice column unless the source table came with one."""
    return out if CHUNK in source.columns else out.drop(CHUNK)


def balanced_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = 1_000_000) -> DataFrame:
    """Cut the rows, sorted by keys and order, into slices of about ``rows`` rows and write them down.

    For ticks, fills and other tables where one symbol or one hour may hold a large part
    of all rows: the cuts follow the data, so neither makes a large slice as
    long as ``order`` tells rows apart. The slice number is stored with the rows, because
    a second run of the range sampling could cut elsewhere.
    """
    n = max(1, -(-df.count() // rows))
    return settle(df.repartitionByRange(n, *keys, *order).withColumn(CHUNK, F.spark_partition_id().cast("bigint")))


def _partial(kind: str, x: Column, order: Sequence[str]) -> Column:
    # a single order column keeps this a hash aggregate where a struct would need a sort
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    if kind == "last":
        return F.max_by(x, F.when(x.isNotNull(), at))
    if kind == "first":
        return F.min_by(x, F.when(x.isNotNull(), at))
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](x)


def _running(kind: str, x: Column) -> Column:
    if kind == "last":
        return F.last(x, ignorenulls=True)
    if kind == "first":
        return F.first(x, ignorenulls=True)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[kind](x)


def _combine(kind: str, carry: Column, here: Column) -> Column:
    if kind == "sum":
        return F.when(carry.isNull(), here).otherwise(carry + F.coalesce(here, F.lit(0)))
    if kind == "count":
        return F.coalesce(carry, F.lit(0)) + here
    if kind == "max":
        return F.greatest(carry, here)
    if kind == "min":
        return F.least(carry, here)
    if kind == "last":
        return F.coalesce(here, carry)
    return F.coalesce(carry, here)


def prefix(
    df: DataFrame,
    aggs: dict[str, tuple[str, Column]],
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts",),
    chunk: Column | None = None,
    upto: int = 0,
    parts: DataFrame | None = None,
) -> DataFrame:
    """Add running aggregates over all earlier rows of the key.

    ``aggs`` maps an output name to ``(kind, value)`` with kind one of sum,
    count, max, min, last, first; null values are skipped. ``upto=0`` includes the
    current row, ``-1`` stops before it. ``chunk`` must not decrease along
    ``order``. Without it a chunk column already there (from ``balanced_chunks``
    or an earlier call) is reused, so several calls share one shuffle; failing
    that, 30-day slices of the first order column are used, which suits bars.
    ``parts`` gives the per-slice aggregates (``_p_<name>``, one row per key and slice)
    where the caller can make them from fewer rows.
    """
    keys, order = list(keys), list(order)
    if chunk is not None:
        df = df.withColumn(CHUNK, chunk)
    elif CHUNK not in df.columns:
        df = df.withColumn(CHUNK, time_chunk(order[0], BAR_CHUNK))
    if parts is None:
        parts = df.groupBy(*keys, CHUNK).agg(
            *[_partial(kind, x, order).alias(f"_p_{out}") for out, (kind, x) in aggs.items()]
        )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(
        *keys,
        CHUNK,
        *[
            _running("sum" if kind == "count" else kind, F.col(f"_p_{out}")).over(earlier).alias(f"_c_{out}")
            for out, (kind, _) in aggs.items()
        ],
    )
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    joined = df.join(carry, [*keys, CHUNK], "left")
    return joined.withColumns(
        {out: _combine(kind, F.col(f"_c_{out}"), _running(kind, x).over(inside)) for out, (kind, x) in aggs.items()}
    ).drop(*[f"_c_{out}" for out in aggs])


def with_row_number(
    df: DataFrame,
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts",),
    chunk: Column | None = None,
    out: str = ROW,
) -> DataFrame:
    """Number the rows of each key from 1 in ``order`` (a total order)."""
    return tidy(prefix(df, {out: ("count", F.lit(1))}, keys, order, chunk), df)


class Frames:
    """Window specs inside the blocks of ``framed``."""

    def __init__(self, keys: Sequence[str]):
        self.block = Window.partitionBy(*keys, BLOCK)
        self.seq = self.block.orderBy(ROW)
        self.upto = self.seq.rowsBetween(Window.unboundedPreceding, 0)

    def back(self, n: int) -> WindowSpec:
        """The current row and the n-1 before it."""
        return self.seq.rowsBetween(-(n - 1), 0)

    def span(self, a: int, b: int) -> WindowSpec:
        return self.seq.rowsBetween(a, b)

    def lag(self, x: str | Column, k: int = 1) -> Column:
        return F.lag(col(x), k).over(self.seq)

    def lead(self, x: str | Column, k: int = 1) -> Column:
        return F.lead(col(x), k).over(self.seq)

    def full(self, agg: Column, n: int, x: str | Column | None = None, min_rows: int | None = None) -> Column:
        """``agg`` over the last n rows, null until ``min_rows`` (default n) values are there."""
        w = self.back(n)
        seen = F.count(F.lit(1) if x is None else col(x)).over(w)
        return F.when(seen >= (n if min_rows is None else min_rows), agg.over(w))

    def mean(self, x: str | Column, n: int, min_rows: int | None = None) -> Column:
        return self.full(F.avg(col(x)), n, x, min_rows)

    def std(self, x: str | Column, n: int, min_rows: int | None = None) -> Column:
        return self.full(F.stddev_samp(col(x)), n, x, min_rows)

    def std_pop(self, x: str | Column, n: int, min_rows: int | None = None) -> Column:
        return self.full(F.stddev_pop(col(x)), n, x, min_rows)

    def sum(self, x: str | Column, n: int, min_rows: int | None = None) -> Column:
        return self.full(F.sum(col(x)), n, x, min_rows)

    def max(self, x: str | Column, n: int, min_rows: int | None = None) -> Column:
        return self.full(F.max(col(x)), n, x, min_rows)

    def min(self, x: str | Column, n: int, min_rows: int | None = None) -> Column:
        return self.full(F.min(col(x)), n, x, min_rows)

    def quantile(self, x: str | Column, q: float, n: int, min_rows: int | None = None) -> Column:
        """Linear-interpolated quantile; exact, for frames of up to about a thousand rows."""
        return self.full(F.percentile(col(x), F.lit(q)), n, x, min_rows)

    def pct(self, x: str | Column, k: int = 1) -> Column:
        """x / x[k rows back] - 1, null where that value is 0 or absent."""
        old = self.lag(x, k)
        return col(x) / F.when(old != 0, old) - F.lit(1.0)


def framed(
    df: DataFrame,
    build: Callable[[DataFrame, Frames], DataFrame],
    before: int,
    after: int = 0,
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts",),
    chunk: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``build(df, frames)`` on equal blocks of each key's ordered rows.

    ``before`` and ``after`` are the total numbers of rows that any value built
    may depend on, summed over nested frames. Each block gets that many rows of
    its neighbours, and they are dropped again at the end, so results do not
    depend on where the cuts fall.
    """
    keys = list(keys)
    rows = max(block_rows, 2 * (before + after) + 1)
    d = with_row_number(df, keys, order, chunk)
    own = F.floor((F.col(ROW) - 1) / rows)
    pos = F.pmod(F.col(ROW) - 1, F.lit(rows))
    homes = [own]
    if before:
        homes.append(F.when(pos >= rows - before, own + 1))
    if after:
        homes.append(F.when((pos < after) & (own > 0), own - 1))
    d = d.withColumn("_own", own).withColumn(BLOCK, F.explode(F.array_compact(F.array(*homes))))
    start = F.greatest(F.lit(0), F.col(BLOCK) * rows - before)
    d = d.withColumn(HOME, F.col(BLOCK) == F.col("_own")).withColumn(POS, F.col(ROW) - 1 - start).drop("_own")
    return build(d, Frames(keys)).where(F.col(HOME)).drop(ROW, BLOCK, HOME, POS)


def islands(
    df: DataFrame,
    state: str | Column,
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts",),
    chunk: Column | None = None,
    out: str = "island",
    keep_chunk: bool = False,
) -> DataFrame:
    """Number the runs of equal ``state`` along the order of each key from 1."""
    source = df
    df = df.withColumn("_s", F.struct(col(state).alias("v")))
    df = prefix(df, {"_prev": ("last", F.col("_s"))}, keys, order, chunk, upto=-1)
    df = df.withColumn("_new", F.when(F.col("_s").eqNullSafe(F.col("_prev")), 0).otherwise(1))
    df = prefix(df, {out: ("sum", F.col("_new"))}, keys, order).drop("_s", "_prev", "_new")
    return df if keep_chunk else tidy(df, source)
