"""As-of, nearest and interval joins on sliced time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import epoch_us, time_chunk
from tidemark.operators.frames import CHUNK, DAY, balanced_chunks, prefix


def asof_join(
    left: DataFrame,
    right: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    right_ts: str = "ts",
    direction: str = "backward",
    strict: bool = False,
    chunk_seconds: int | None = DAY,
    tie: Sequence[str] = (),
    keep_ts: str | None = None,
) -> DataFrame:
    """Attach to each left row ``cols`` of the last right row at or before its ``ts``.

    ``direction='forward'`` takes the first right row at or after. ``strict``
    leaves out equal timestamps. ``tie`` orders right rows of equal time. Both
    sides are stacked and the right row is carried along the stack; the carry
    is done per time slice and handed on from slice to slice, so neither side
    of a hot key is held in one task. ``chunk_seconds=None`` cuts the stack into slices of
    equal size instead (one more write), for tables where a single day may be
    very large. ``keep_ts`` names a column that receives the matched right timestamp.
    """
    keys = list(keys)
    payload = F.struct(F.col(right_ts).alias("_rts"), *[F.col(c) for c in cols])
    stamp = epoch_us(right_ts)
    sign = 1 if direction == "backward" else -1
    side_right, side_left = (1, 0) if strict else (0, 1)
    tie_key = F.struct(*[F.col(c) for c in tie]) if tie else F.struct(F.lit(0).alias("z"))
    if direction == "forward" and tie:
        raise ValueError("tie applies to the backward direction only")
    r = right.select(
        *keys,
        (stamp * sign).alias("_t"),
        F.lit(side_right).alias("_side"),
        tie_key.alias("_tie"),
        payload.alias("_right"),
    )
    l = left.select(
        *keys,
        (epoch_us(ts) * sign).alias("_t"),
        F.lit(side_left).alias("_side"),
        F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"),
        F.struct(*left.columns).alias("_left"),
    )
    both = l.unionByName(r, allowMissingColumns=True)
    order = ["_t", "_side", "_tie"]
    if chunk_seconds is None:
        # equal stamps may be many: the row's own hash tells them apart for the cuts
        both = both.withColumn("_h", F.xxhash64("_left", "_right"))
        order.append("_h")
        both = balanced_chunks(both, keys, order)
    else:
        both = both.withColumn(CHUNK, F.floor(F.col("_t") / F.lit(chunk_seconds * 1_000_000)))
    # only right rows can be carried on; left rows just name the slices that need a value
    last = both.where(F.col("_right").isNotNull()).groupBy(*keys, CHUNK).agg(
        F.max_by("_right", F.struct(*order)).alias("_p__hit")
    )
    parts = both.select(*keys, CHUNK).distinct().join(last, [*keys, CHUNK], "left")
    carried = prefix(both, {"_hit": ("last", F.col("_right"))}, keys, order, parts=parts)
    out = carried.where(F.col("_left").isNotNull()).select(
        "_left.*",
        *[F.col(f"_hit.{c}").alias(c) for c in cols],
        *([F.col("_hit._rts").alias(keep_ts)] if keep_ts else []),
    )
    return out


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    cols: Sequence[str],
    tolerance_seconds: float,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    right_ts: str = "ts",
    chunk_seconds: int | None = DAY,
) -> DataFrame:
    """Attach ``cols`` of the right row closest in time, either side, if nearer than the tolerance.

    Of two equally near rows the earlier wins. A row further than the tolerance leaves nulls.
    """
    back = asof_join(left, right, cols, keys, ts, right_ts, "backward", False, chunk_seconds, keep_ts="_bts")
    back = back.withColumns({f"_b_{c}": F.col(c) for c in cols}).drop(*cols)
    both = asof_join(back, right, cols, keys, ts, right_ts, "forward", False, chunk_seconds, keep_ts="_fts")
    limit = int(tolerance_seconds * 1_000_000)
    db = epoch_us(ts) - epoch_us("_bts")
    df_ = epoch_us("_fts") - epoch_us(ts)
    use_back = db.isNotNull() & (df_.isNull() | (db <= df_))
    near = F.least(db, df_) < limit
    picked = {c: F.when(near, F.when(use_back, F.col(f"_b_{c}")).otherwise(F.col(c))) for c in cols}
    return both.withColumns(picked).drop("_bts", "_fts", *[f"_b_{c}" for c in cols])


def interval_join(
    spans: DataFrame,
    points: DataFrame,
    start: str,
    end: str,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts",
    slice_seconds: int = 3600,
) -> DataFrame:
    """Points with start <= ts <= end of the same key.

    Each span is listed once per time slice it touches and points carry their slice, so
    the join is an equi-join on (key, slice) plus a range test. Pick the slice
    near the usual span length.
    """
    sliced = spans.withColumn(
        "_slice", F.explode(F.sequence(time_chunk(start, slice_seconds), time_chunk(end, slice_seconds)))
    )
    p = points.withColumn("_slice", time_chunk(ts, slice_seconds))
    inside = F.col(ts).between(F.col(start), F.col(end))
    return sliced.join(p, [*keys, "_slice"]).where(inside).drop("_slice")


def bucket_floor_join(
    df: DataFrame,
    higher: DataFrame,
    cols: Sequence[str],
    seconds: int,
    keys: Sequence[str] = ("symbol",),
    align: str = "close",
    suffix: str = "",
) -> DataFrame:
    """Attach higher-timeframe values by bucket.

    ``align='floor'`` joins the bucket a row lies in, whose final values are not
    known yet at that time; the default ``'close'`` joins the bucket completed before.
    """
    from tidemark.functions.core import floor_ts

    shift = 0 if align == "floor" else seconds
    h = higher.select(
        *keys,
        (F.col("ts") + F.expr(f"interval {shift} seconds")).alias("_bucket"),
        *[F.col(c).alias(c + suffix) for c in cols],
    )
    return df.withColumn("_bucket", floor_ts("ts", seconds)).join(h, [*keys, "_bucket"], "left").drop("_bucket")
