"""Exponential means as a prefix scan of affine maps.

An exponential mean moves its state by s -> a s + b from row to row, and such
maps compose to maps of the same form. Each slice of a key is scanned on its
own from its first value on; what it does to a state as a whole is one small row
(``a``, ``b``, its first value, how far that is from its edges). These rows
are folded in order per key, which gives each slice the state before it, and
the rows of the slice apply their own map to that. So no row is left out,
whatever its weight, and no key needs one task.

Maps are scanned by running sums of b over the decay so far. Over ``SPAN``
nats of decay these would leave the range of a double, so a slice is cut into
stretches of rows that decay less, and these compose to the slice in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import col, time_chunk
from tidemark.operators.frames import BAR_CHUNK, CHUNK, prefix, tidy
from tidemark.session import settle

SPAN = 600.0
STRETCH = "_sub"


@dataclass(frozen=True)
class Mean:
    """An exponential mean s = (1-alpha) s' + alpha x of ``x``.

    seed ``first``  starts at the first value (pandas adjust=False),
    seed ``adjust`` divides by the sum of weights (pandas adjust=True),
    seed ``sma``    starts at value ``seed_rows`` with the plain mean up to it.
    """

    x: str | Column
    alpha: float
    seed: str = "first"
    seed_rows: int = 0


class _Scan:
    """One mean: names of its columns, and its maps as SQL text (built once, where nested columns would be put together call by call).

    Its values are x and, for ``adjust``, the weights too.
    """

    def __init__(self, out: str, mean: Mean):
        self.out, self.sums = out, mean.seed == "adjust"
        self.alpha, self.keep = f"{mean.alpha!r}D", f"{1.0 - mean.alpha!r}D"
        self.rate = -math.log(1.0 - mean.alpha) if mean.alpha < 1 else SPAN
        self.values = [f"_{out}_x", *([f"_{out}_w"] if self.sums else [])]
        self.i1, self.il, self.a, self.j, self.c, self.step, self.into, self.maps = (f"_{out}_{p}" for p in ("i1", "il", "a", "j", "c", "step", "in", "maps"))

    def old_weight(self, gap: str) -> str:
        """Weight of a state after ``gap`` rows; rows without a value decay it too."""
        return f"(if({gap} = 1, {self.keep}, pow({self.keep}, {gap})))"

    def factor(self, gap: str) -> str:
        """A value that comes ``gap`` rows after the last one moves s to factor s + share x."""
        old = self.old_weight(gap)
        return old if self.sums else f"(if({gap} = 1, {self.keep}, {old} / ({old} + {self.alpha})))"

    def share(self, gap: str) -> str:
        return "1D" if self.sums else f"(if({gap} = 1, {self.alpha}, {self.alpha} / ({self.old_weight(gap)} + {self.alpha})))"

    def decay(self, gap: str) -> str:
        """Nats that a map takes off the state; never more than the rows it spans times the rate."""
        more = "" if self.sums else f" + if({gap} = 1, 0D, ln({self.old_weight(gap)} + {self.alpha}))"
        return f"({gap} * {self.rate!r}D{more})"

    def enter(self, state: str, gap: str, x: str) -> str:
        return f"if({state} is null, {x}, {self.factor(gap)} * {state} + {self.share(gap)} * {x})"

    @property
    def start(self) -> str:
        return "named_struct(" + ", ".join(f"'{v}', cast(null as double)" for v in self.values) + ", 'gap', 0L)"

    @property
    def summary(self) -> str:
        """A stretch: rows, places of its first and last value, map from the first value to the end, first values."""
        names = ["_n", self.i1, self.il, self.a, *[f"{v}{p}" for v in self.values for p in "1B"]]
        return "named_struct(" + ", ".join(f"'{c}', {c}" for c in names) + ")"

    def composed(self, m: str, r: str) -> str:
        """Two neighbouring summaries as one."""
        gap, a = f"({m}._n - {m}.{self.il} + {r}.{self.i1})", f"{r}.{self.a}"
        n = f"'_n', {m}._n + {r}._n"
        firsts = lambda k: "".join(f", '{v}1', {k}.{v}1, '{v}B', {k}.{v}B" for v in self.values)
        late = f"named_struct({n}, '{self.i1}', {m}._n + {r}.{self.i1}, '{self.il}', {m}._n + {r}.{self.il}, '{self.a}', {a}{firsts(r)})"
        early = f"named_struct({n}, '{self.i1}', {m}.{self.i1}, '{self.il}', {m}.{self.il}, '{self.a}', {m}.{self.a}{firsts(m)})"
        ends = "".join(f", '{v}1', {m}.{v}1, '{v}B', {a} * ({self.factor(gap)} * {m}.{v}B + {self.share(gap)} * {r}.{v}1) + {r}.{v}B" for v in self.values)
        both = f"named_struct({n}, '{self.i1}', {m}.{self.i1}, '{self.il}', {m}._n + {r}.{self.il}, '{self.a}', {a} * {self.factor(gap)} * {m}.{self.a}{ends})"
        return f"case when {m}.{self.i1} is null then {late} when {r}.{self.i1} is null then {early} else {both} end"

    def moved(self, state: str, r: str) -> str:
        """State (values, rows since the last value) after a summary's rows."""
        gap = f"({state}.gap + {r}.{self.i1})"
        ends = ", ".join(f"'{v}', {r}.{self.a} * {self.enter(f'{state}.{v}', gap, f'{r}.{v}1')} + {r}.{v}B" for v in self.values)
        same = ", ".join(f"'{v}', {state}.{v}" for v in self.values)
        return f"if({r}.{self.i1} is null, named_struct({same}, 'gap', {state}.gap + {r}._n), named_struct({ends}, 'gap', {r}._n - {r}.{self.il}))"

    def result(self) -> str:
        gap = f"({self.into}.gap + {self.i1})"
        parts = [f"if(_i >= {self.i1}, {self.a} * {self.enter(f'{self.into}.{v}', gap, f'{v}1')} + {v}r, {self.into}.{v})" for v in self.values]
        return " / ".join(f"({p})" for p in parts)


def _list(named: dict[str, str]) -> str:
    return ", ".join(f"{text} as {k}" for k, text in named.items())


def _own(keys: Sequence[str]) -> str:
    return "".join(f"`{k}`, " for k in keys) + CHUNK


def _scanned(d: DataFrame, scans: Sequence[_Scan], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Maps of all rows of a stretch from its first value on: value = a first + r."""
    rows = max(2, math.floor(SPAN / max(s.rate for s in scans)))
    seq = f"partition by {_own(keys)}, {STRETCH} order by _i rows between unbounded preceding and"
    places = {s.j: f"last(if({s.values[0]} is not null, _i, null)) ignore nulls over ({seq} 1 preceding)" for s in scans}
    steps, maps = {}, {}
    for s in scans:
        here, gap = f"{s.values[0]} is not null and {s.j} is not null", f"(_i - {s.j})"
        steps |= {s.step: f"if({here}, {s.decay(gap)}, null)", **{f"{v}b": f"if({here}, {s.share(gap)} * {v}, null)" for v in s.values}}
        up, down = f"exp({s.c} - {SPAN / 2}D)", f"exp({SPAN / 2}D - {s.c})"
        maps |= {s.a: f"exp(-{s.c})", **{f"{v}r": f"coalesce({down} * sum({v}b * {up}) over ({seq} current row), 0D)" for v in s.values}}
    decays = {s.c: f"coalesce(sum({s.step}) over ({seq} current row), 0D)" for s in scans}
    gone = ", ".join(c for s in scans for c in (s.j, s.step, s.c, *[f"{v}b" for v in s.values]))
    by = ", ".join(f"`{c}`" for c in order)
    return d.sparkSession.sql(
        f"""with numbered as (select *, row_number() over (partition by {_own(keys)} order by {by}) as _n from {{d}}),
        cut as (select * except (_n), (_n - 1) div {rows} as {STRETCH}, cast((_n - 1) % {rows} + 1 as bigint) as _i from numbered),
        last_values as (select *, {_list(places)} from cut), steps as (select *, {_list(steps)} from last_values),
        decays as (select *, {_list(decays)} from steps), maps as (select *, {_list(maps)} from decays)
        select * except ({gone}) from maps""",
        d=d,
    )


def _summaries(d: DataFrame, scans: Sequence[_Scan], keys: Sequence[str]) -> DataFrame:
    """One row per stretch."""
    aggs = {"_n": "count(1)"}
    for s in scans:
        place = f"if({s.values[0]} is not null, _i, null)"
        aggs |= {s.i1: f"min({place})", s.il: f"max({place})", s.a: f"min({s.a})"}
        for v in s.values:
            aggs |= {f"{v}1": f"min_by({v}, {place})", f"{v}B": f"max_by({v}r, _i)"}
    return d.groupBy(*keys, CHUNK, STRETCH).agg(*[F.expr(f"{text} as {k}") for k, text in aggs.items()])


def _entering(parts: DataFrame, scans: Sequence[_Scan], keys: Sequence[str]) -> DataFrame:
    """State before each stretch: slices compose their stretches, keys fold their slices, slices fold their stretches."""
    before = "rows between unbounded preceding and 1 preceding"
    key = ", ".join(f"`{k}`" for k in keys) or "1"
    lists = {s.maps: f"sort_array(collect_list(struct({STRETCH}, {s.summary} as m))).m" for s in scans}
    wholes = {s.maps: f"aggregate(slice({s.maps}, 2, size({s.maps})), {s.maps}[0], (x, y) -> {s.composed('x', 'y')})" for s in scans}
    starts = {f"{s.into}0": f"aggregate(collect_list({s.maps}) over (partition by {key} order by {CHUNK} {before}), {s.start}, (x, y) -> {s.moved('x', 'y')})" for s in scans}
    inner = f"partition by {_own(keys)} order by {STRETCH} {before}"
    states = {s.into: f"aggregate(collect_list({s.summary}) over ({inner}), {s.into}0, (x, y) -> {s.moved('x', 'y')})" for s in scans}
    kept = ", ".join([_own(keys), STRETCH, *[c for s in scans for c in (s.i1, *[f"{v}1" for v in s.values])]])
    own, parts_ = _own(keys), "{parts}"
    return parts.sparkSession.sql(
        f"""with lists as (select {own}, {_list(lists)} from {parts_} group by {own}), wholes as (select {own}, {_list(wholes)} from lists),
        starts as (select {own}, {_list(starts)} from wholes)
        select {kept}, {_list(states)} from (select * from {parts_} join starts using ({own}))""",
        parts=parts,
    )


def exponential_means(
    df: DataFrame, means: dict[str, Mean], keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), chunk: Column | None = None
) -> DataFrame:
    """Add exponential means of any alphas; rows without a value age the state and repeat its value, as in pandas."""
    keys, order, source = list(keys), list(order), df
    if chunk is not None:
        df = df.withColumn(CHUNK, chunk)
    elif CHUNK not in df.columns:
        df = df.withColumn(CHUNK, time_chunk(order[0], BAR_CHUNK))
    if still := {out: ("last", col(m.x).cast("double")) for out, m in means.items() if m.alpha == 1 and m.seed != "sma"}:
        out = exponential_means(prefix(df, still, keys, order), {k: m for k, m in means.items() if k not in still}, keys, order)
        return tidy(out.select(*[c for c in out.columns if c not in means], *means), source)
    if not means:
        return df
    scans = [_Scan(out, m) for out, m in means.items()]
    xs = {s.values[0]: col(m.x).cast("double") for s, m in zip(scans, means.values())}
    df = df.withColumns(xs)
    seeded = [(s, m.seed_rows) for s, m in zip(scans, means.values()) if m.seed == "sma"]
    if seeded:
        sums = {f"{s.values[0]}{c}": (kind, F.col(s.values[0])) for s, _ in seeded for c, kind in (("k", "count"), ("m", "sum"))}
        df = prefix(df, sums, keys, order)
        head = {x: f"case when {x}k > {n} then {x} when {x}k = {n} and {x} is not null then {x}m / {n} end" for x, n in ((s.values[0], n) for s, n in seeded)}
        df = df.withColumns({x: F.expr(text) for x, text in head.items()}).drop(*sums)
    df = df.withColumns({s.values[1]: F.when(F.col(s.values[0]).isNotNull(), F.lit(1.0)) for s in scans if s.sums})
    d = _scanned(df, scans, keys, order)
    entry = settle(_entering(settle(_summaries(d, scans, keys)), scans, keys))  # a row for each stretch
    d = d.join(entry, [*keys, CHUNK, STRETCH], "left").withColumns({s.out: F.expr(s.result()) for s in scans})
    gone = [c for s in scans for c in (s.a, s.into, s.i1, *[f"{v}{p}" for v in s.values for p in ("", "r", "1")])]
    return tidy(d.drop("_i", STRETCH, *gone), source)
