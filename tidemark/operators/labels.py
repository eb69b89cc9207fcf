"""Labels from future rows. Horizons count rows; frames are bounded by the horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import EPS, div
from tidemark.operators.frames import framed

KEYS = ("symbol",)


def future_returns(df: DataFrame, horizons: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """close[t + h] / close[t] - 1 per horizon, null where the horizon passes the end."""

    def build(d, fr):
        return d.withColumns({f"ret_{h}": fr.lead("close", h) / F.col("close") - 1 for h in horizons})

    return framed(df, build, before=0, after=max(horizons), keys=keys)


def hit_labels(df: DataFrame, horizon: int, target: float, stop: float, tail: str = "zero", keys: Sequence[str] = KEYS) -> DataFrame:
    """Any of the next ``horizon`` closes at or beyond target / stop. ``tail='zero'`` gives 0 to rows whose
    horizon passes the end, ``'partial'`` uses the rows there are."""

    def build(d, fr):
        w = fr.span(1, horizon)
        c = F.col("close")
        whole = F.count(F.lit(1)).over(w) >= horizon
        ready = whole if tail == "zero" else F.lit(True)
        return d.withColumns(
            {
                "hit_target": F.when(ready & (F.max("close").over(w) >= c * (1 + target)), 1).otherwise(0),
                "hit_stop": F.when(ready & (F.min("close").over(w) <= c * (1 - stop)), 1).otherwise(0),
            }
        )

    return framed(df, build, before=0, after=horizon, keys=keys)


def first_offset(prices: Column, test, none: int) -> Column:
    """1-based offset of the first future price passing ``test``, else ``none``."""
    pos = F.array_position(F.transform(prices, test), True)
    return F.when(pos > 0, pos).otherwise(F.lit(none)).cast("int")


def reaches(change: float):
    """Test of a price against close * (1 + change), upward for gains and downward for losses."""
    level = F.col("close") * (1 + change)
    if change >= 0:
        return lambda x: x >= level
    return lambda x: x <= level


def time_to_target(df: DataFrame, targets: dict[str, float], horizon: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows until the first close at or beyond each target (negative = fall), else the horizon."""

    def build(d, fr):
        d = d.withColumn("_next", F.collect_list("close").over(fr.span(1, horizon)))
        cols = {name: first_offset(F.col("_next"), reaches(t), horizon) for name, t in targets.items()}
        return d.withColumns(cols).drop("_next")

    return framed(df, build, before=0, after=horizon, keys=keys)


def optimal_exit(df: DataFrame, horizon: int, boundary_minutes: Sequence[int] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Offset and return of the best close in the horizon, the first of equal ones; optionally only at given minutes."""

    def build(d, fr):
        nxt = F.collect_list(F.struct(F.col("close").alias("c"), F.minute("ts").alias("m"))).over(fr.span(1, horizon))
        d = d.withColumn("_next", nxt)
        ranked = F.transform("_next", lambda x, i: F.struct(x["c"].alias("c"), (-i).alias("o"), x["m"].alias("m")))
        if boundary_minutes is not None:
            ranked = F.filter(ranked, lambda x: x["m"].isin(list(boundary_minutes)))
        d = d.withColumn("_best", F.array_max(ranked))
        return d.withColumns(
            {"exit_offset": (F.lit(1) - F.col("_best.o")).cast("int"), "exit_return": F.col("_best.c") / F.col("close") - 1}
        ).drop("_next", "_best")

    return framed(df, build, before=0, after=horizon, keys=keys)


def excursions(df: DataFrame, horizon: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Largest gain and loss reachable in the next rows (high and low against the close)."""

    def build(d, fr):
        w = fr.span(1, horizon)
        return d.withColumns(
            {"mfe": F.max("high").over(w) / F.col("close") - 1, "mae": F.min("low").over(w) / F.col("close") - 1}
        )

    return framed(df, build, before=0, after=horizon, keys=keys)


def triple_barrier(df: DataFrame, horizon: int, target: float, stop: float, ordered: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """1 target, -1 stop, 0 neither. Ordered: whichever comes first, the stop winning within one bar.
    Unordered: target reached and stop not reached anywhere in the horizon."""

    def build(d, fr):
        w = fr.span(1, horizon)
        c = F.col("close")
        if not ordered:
            up = F.max("high").over(w) >= c * (1 + target)
            down = F.min("low").over(w) <= c * (1 - stop)
            return d.withColumn("barrier", F.when(up & ~down, 1).when(down & ~up, -1).otherwise(0))
        d = d.withColumns({"_h": F.collect_list("high").over(w), "_l": F.collect_list("low").over(w)})
        up = first_offset(F.col("_h"), lambda x: x >= c * (1 + target), horizon + 1)
        down = first_offset(F.col("_l"), lambda x: x <= c * (1 - stop), horizon + 1)
        value = F.when((down <= up) & (down <= horizon), -1).when(up <= horizon, 1).otherwise(0)
        return d.withColumn("barrier", value).drop("_h", "_l")

    return framed(df, build, before=0, after=horizon, keys=keys)


def boundary_exit(df: DataFrame, horizon: int, minutes: Sequence[int] = (0, 15, 30, 45), keys: Sequence[str] = KEYS) -> DataFrame:
    """Return at a fixed horizon, whether it ends on a boundary, win label and five return classes.

    Fixed limits: win at 0.6 %, or 0.3 % on a boundary; classes at -0.4 %, 0, 0.6 %, 1.2 %.
    """

    def build(d, fr):
        d = d.withColumns({"ret": fr.lead("close", horizon) / F.col("close") - 1, "_m": F.minute(fr.lead("ts", horizon))})
        on = F.coalesce(F.col("_m").isin(list(minutes)), F.lit(False))
        r = F.col("ret")
        return d.withColumns(
            {
                "on_boundary": on,
                "win": F.coalesce((r >= 0.006) | ((r >= 0.003) & on), F.lit(False)).cast("int"),
                "return_class": F.when(r <= -0.004, 0).when(r <= 0, 1).when(r < 0.006, 2).when(r < 0.012, 3).when(r.isNotNull(), 4).otherwise(1),
                "bonus_return": r + F.when(on, 0.001).otherwise(0.0),
            }
        ).drop("_m")

    return framed(df, build, before=0, after=horizon, keys=keys)


# fixed values: profit target and longest holding (rows) per regime
REGIME_TARGETS = {
    "range_bound": (0.008, 180),
    "strong_uptrend": (0.012, 90),
    "strong_downtrend": (0.006, 60),
    "high_volatility": (0.015, 45),
    "low_volatility": (0.005, 240),
}


def regime_labels(
    df: DataFrame, targets: dict[str, tuple[float, int]] = REGIME_TARGETS, stop: float = 0.015, scale: int = 1, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Target of the row's regime reached within its holding limit before a fall of ``stop``; the limit is divided by ``scale``."""
    longest = max(h for _, h in targets.values()) // scale
    flat = [F.lit(x) for k, (p, _) in targets.items() for x in (k, p)]
    hold = [F.lit(x) for k, (_, h) in targets.items() for x in (k, h // scale)]
    target = F.coalesce(F.element_at(F.create_map(*flat), F.col("regime")), F.lit(targets["range_bound"][0]))
    limit = F.coalesce(F.element_at(F.create_map(*hold), F.col("regime")), F.lit(targets["range_bound"][1] // scale))

    def build(d, fr):
        d = d.withColumns({"_t": target, "_n": limit, "_next": F.collect_list("close").over(fr.span(1, longest))})
        c = F.col("close")
        up = first_offset(F.col("_next"), lambda x: x >= c * (F.col("_t") + 1), 1_000_000)
        down = first_offset(F.col("_next"), lambda x: x <= c * (1 - stop), 1_000_000)
        d = d.withColumns({"_up": up, "_down": down})
        hit = (F.col("_up") <= F.col("_n")) & (F.col("_up") < F.col("_down"))
        return d.withColumns(
            {
                "hit": hit.cast("int"),
                "hit_on_boundary": (hit & (F.pmod("_up", F.lit(3)) == 0)).cast("int"),
                "holding_return": F.when(F.size("_next") >= F.col("_n"), F.try_element_at("_next", F.col("_n").cast("int")) / c - 1),
            }
        ).drop("_t", "_n", "_next", "_up", "_down")

    return framed(df, build, before=0, after=longest, keys=keys)


def risk_adjusted(df: DataFrame, horizon: int, n: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Future return over trailing volatility (damped denominator)."""

    def build(d, fr):
        d = d.withColumns({"_r": fr.pct("close"), "ret": fr.lead("close", horizon) / F.col("close") - 1})
        return d.withColumn("risk_adjusted", F.col("ret") / (fr.std("_r", n) + F.lit(EPS))).drop("_r")

    return framed(df, build, before=n + 1, after=horizon, keys=keys)


def signal_exits(
    df: DataFrame,
    is_entry: Column,
    bar_minutes: int,
    max_minutes: int,
    boundaries: Sequence[int] = (0, 15, 30, 45),
    preferred: Sequence[tuple[int, int]] = ((15, 29), (45, 59)),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One exit for every entry row; overlapping entries are kept.

    Candidates are later bars on a boundary minute (priority 1 inside a preferred
    window, else 2) and the first bar at the holding limit (priority 3), where the
    search ends. The smallest (priority, minutes held) wins; without candidates the
    last bar there is.
    """
    horizon = -(-max_minutes // bar_minutes)

    def build(d, fr):
        nxt = F.collect_list(F.struct(F.col("ts").alias("t"), F.col("close").alias("c"))).over(fr.span(1, horizon))
        d = d.withColumn("_next", F.when(is_entry, nxt)).where(is_entry)
        held = lambda t: (F.unix_seconds(t.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))) / 60.0
        rows = F.transform("_next", lambda x: F.struct(x["t"].alias("t"), x["c"].alias("c"), held(x["t"]).alias("h"), F.minute(x["t"]).alias("m")))
        d = d.withColumn("_rows", rows)
        end = F.array_min(F.transform(F.filter("_rows", lambda x: x["h"] >= max_minutes), lambda x: x["h"]))
        d = d.withColumn("_end", F.coalesce(end, F.lit(1e18)))
        inside = F.filter("_rows", lambda x: x["h"] <= F.col("_end"))

        def in_window(m):
            out = F.lit(False)
            for a, b in preferred:
                out = out | m.between(a, b)
            return out

        def rank(x):
            on = x["m"].isin(list(boundaries))
            p = F.when(on & in_window(x["m"]), 1).when(on, 2).when(x["h"] >= max_minutes, 3)
            return F.struct(p.alias("p"), x["h"].alias("h"), x["t"].alias("t"), x["c"].alias("c"))

        ranked = F.filter(F.transform(inside, rank), lambda x: x["p"].isNotNull())
        d = d.withColumns({"_best": F.array_min(ranked), "_last": F.try_element_at("_rows", F.lit(-1))})
        return d.withColumns(
            {
                "exit_ts": F.coalesce("_best.t", "_last.t"),
                "exit_price": F.coalesce("_best.c", "_last.c"),
                "priority": F.col("_best.p"),
            }
        ).drop("_next", "_rows", "_end", "_best", "_last")

    d = framed(df, build, before=0, after=horizon, keys=keys)
    return d.withColumn("pnl_pct", div(F.col("exit_price") - F.col("close"), "close"))
