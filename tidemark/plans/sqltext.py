"""Short forms for window clauses in the DuckDB texts."""


def over(n: int, key: str = "symbol", order: str = "ts") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def span(a: int, b: int) -> str:
    """Rows a..b relative to the current one (negative = before)."""

    def edge(k):
        return "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"

    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {edge(a)} AND {edge(b)})"


def full(agg: str, x: str, n: int, at_least: int | None = None) -> str:
    """agg over the last n rows, null until enough values of x are there."""
    return f"CASE WHEN count({x}) {over(n)} >= {at_least or n} THEN {agg} {over(n)} END"


def mean(x: str, n: int) -> str:
    return full(f"avg({x})", x, n)


def std(x: str, n: int) -> str:
    return full(f"stddev_samp({x})", x, n)


def hi(x: str, n: int) -> str:
    return full(f"max({x})", x, n)


def lo(x: str, n: int) -> str:
    return full(f"min({x})", x, n)


def total(x: str, n: int) -> str:
    return full(f"sum({x})", x, n)


def quant(x: str, q: float, n: int) -> str:
    return full(f"quantile_cont({x},{q})", x, n)


def lag(x: str, k: int = 1) -> str:
    return f"lag({x},{k}) OVER (PARTITION BY symbol ORDER BY ts)"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x},{k}) OVER (PARTITION BY symbol ORDER BY ts)"


def pct(x: str, k: int = 1) -> str:
    return f"({x}/nullif({lag(x, k)},0)-1)"


def ewm(x: str, alpha: float) -> str:
    """Exponential mean from the first value, over the list of all values so far."""
    return (
        f"list_reduce(list({x}) FILTER ({x} IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), "
        f"lambda a, b: a*{1 - alpha!r}::DOUBLE + b*{alpha!r}::DOUBLE)"
    )
