"""Registered queries: a name, the Spark callable, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
TEXTS: dict[str, str] = {}  # SQL as registered, without the parts it names

# Named parts the SQL texts share; a part may use the parts listed before it.
_ts = "epoch(ts)::BIGINT"
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "ticks": (
        (),
        """SELECT event_type AS symbol, ts, event_id, user_id,
           round(exp(sum(round((value-50)*100)::BIGINT) OVER (PARTITION BY event_type ORDER BY ts, event_id)/1e6)*(100*1048576.0::DOUBLE))/1048576.0::DOUBLE AS price,
           CAST(json_extract_string(props,'$.k') AS INT) AS qty FROM events""",
    ),
    "bars": (
        ("ticks",),
        """SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price,(ts,event_id)) AS open, max(price) AS high,
           min(price) AS low, arg_max(price,(ts,event_id)) AS close, CAST(sum(qty) AS DOUBLE) AS volume, count(*) AS trades
           FROM ticks GROUP BY 1, 2""",
    ),
    "bars15": (
        ("ticks",),
        """SELECT symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, arg_min(price,(ts,event_id)) AS open, max(price) AS high,
           min(price) AS low, arg_max(price,(ts,event_id)) AS close, CAST(sum(qty) AS DOUBLE) AS volume, count(*) AS trades
           FROM ticks GROUP BY 1, 2""",
    ),
    "bars4h": (
        ("bars",),
        """SELECT symbol, to_timestamp((epoch(ts)::BIGINT // 14400) * 14400) AT TIME ZONE 'UTC' AS ts, arg_min(open, ts) AS open,
           max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume
           FROM bars GROUP BY 1, 2""",
    ),
    "fills": (
        (),
        """SELECT l_orderkey AS order_id, 'P'||(l_partkey % 50) AS symbol, l_suppkey AS venue,
           CASE WHEN l_linestatus='F' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS quantity,
           l_extendedprice/l_quantity AS price, l_extendedprice AS notional, l_extendedprice*l_tax AS commission,
           l_discount AS discount, l_tax AS tax, l_returnflag='N' AS is_maker, l_shipdate AS ts FROM lineitem""",
    ),
    "trades": (
        (),
        """SELECT l_orderkey AS order_id, 'S'||(l_suppkey % 20) AS symbol, o_orderpriority AS strategy, o_custkey AS account,
           l_returnflag AS exit_reason, CASE WHEN l_linestatus='F' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS quantity,
           l_extendedprice AS notional, o_orderdate AS entry_ts, l_shipdate AS ts,
           l_extendedprice*(l_discount-l_tax) AS pnl, round((l_discount-l_tax)*100) AS ret_pct, l_extendedprice*l_tax AS commission,
           date_diff('day', o_orderdate, l_shipdate) AS holding_days
           FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE l_shipdate >= o_orderdate""",
    ),
    "round_trips": (
        (),
        """SELECT event_id AS trade_id, event_type AS symbol, 's'||(user_id % 3) AS strategy, user_id AS account, ts,
           CAST(json_extract_string(props,'$.k') AS INT) AS holding_minutes, round((value-50)*1048576.0::DOUBLE)/1048576.0::DOUBLE AS pnl,
           round((value-50)/25*1048576.0::DOUBLE)/1048576.0::DOUBLE AS pnl_pct, (event_id % 100)/100.0::DOUBLE AS confidence FROM events""",
    ),
    "alerts": (
        (),
        """SELECT event_id AS alert_id, ts, CASE WHEN value>=100 THEN 'CRITICAL' WHEN value>=50 THEN 'ERROR'
           WHEN value>=20 THEN 'WARNING' ELSE 'INFO' END AS severity, 'svc'||(user_id % 5) AS source,
           event_id % 2 = 0 AS resolved, value FROM events WHERE event_type='error'""",
    ),
    "logs": (
        (),
        """SELECT event_id AS log_id, ts, upper(event_type) AS level, 'c'||(user_id % 5) AS component, user_id AS category,
           props AS message, value FROM events""",
    ),
    "chain": (
        ("ticks",),
        """SELECT event_id // 3 AS key, event_id % 3 AS kind, symbol,
           CASE WHEN user_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, price, qty, ts FROM ticks""",
    ),
    "signals": (("chain",), "SELECT key, symbol, side, price, qty, ts FROM chain WHERE kind=0 AND key % 11 <> 0"),
    "positions": (("chain",), "SELECT key, symbol, side, price, qty, ts FROM chain WHERE kind=1 AND key % 7 <> 0"),
    "executions": (("chain",), "SELECT key, symbol, side, price, qty, ts FROM chain WHERE kind=2 AND key % 5 <> 0"),
    "rets": (
        ("bars",),
        """SELECT symbol, ts, close, volume, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars""",
    ),
}


def part(name: str, uses: tuple[str, ...], text: str) -> None:
    PARTS[name] = (uses, text)


def _needed(text: str, seen: list[str]) -> list[str]:
    for name, (_, body) in PARTS.items():
        if name not in seen and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text, re.I):
            _needed(body, seen)
            if name not in seen:
                seen.append(name)
    return seen


def rewrite_calls(text: str, name: str, form: str) -> str:
    """Replace every call ``name(x)`` by ``form`` with x put in, nested calls too."""
    out, start = [], 0
    for m in re.finditer(rf"(?<![\w.]){name}\(", text):
        if m.start() < start:
            continue
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        out.append(text[start : m.start()] + form.format(rewrite_calls(text[m.end() : i - 1], name, form)))
        start = i
    return "".join(out) + text[start:]


def same_results(text: str) -> str:
    """DuckDB keeps the sign of a rounded zero and counts conditions as HUGEINT; Spark does neither."""
    text = rewrite_calls(text, "round", "(round({})+0.0::DOUBLE)")
    return rewrite_calls(text, "count_if", "count(CASE WHEN {} THEN 1 END)")


def full_sql(text: str) -> str:
    """Put the shared parts a query names in front of it as common table expressions."""
    text = text.strip()
    names = _needed(text, [])
    if not names:
        return text
    head = ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in names)
    if text[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{text[15:]}"
    if text[:5].upper() == "WITH ":
        return f"WITH {head},\n{text[5:]}"
    return f"WITH {head}\n{text}"


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; without ``sql`` it is checked by rows only."""

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            TEXTS[name] = sql
        return fn

    return add


def oracle() -> dict[str, str]:
    """SQL of all registered queries. Parts are put in here, when all modules that define some are loaded."""
    return {name: same_results(full_sql(text)) for name, text in TEXTS.items()}
