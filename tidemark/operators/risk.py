"""Performance, portfolio and risk measures."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.candles import normal_cdf
from tidemark.functions.core import col, div, ladder, sample_kurtosis, sample_skewness
from tidemark.operators.frames import framed, stored_chunk
from tidemark.operators.joins import pair_moments
from tidemark.operators.order_stats import exact_order_statistic, exact_quantiles, join_stats
from tidemark.operators.portfolio import symmetric
from tidemark.operators.reports import profit_factor
from tidemark.operators.rolling import block_windows, drawdowns, running_totals
from tidemark.session import settle
from tidemark.sources.scan import as_ts

# fixed values: standard normal quantiles and densities
Z = {0.90: 1.2815515655446004, 0.95: 1.6448536269514722, 0.99: 2.3263478740408408}
PHI = {0.90: 0.17549833193248687, 0.95: 0.10313564037537139, 0.99: 0.02665214220345808}


def backtest_metrics(
    trades: DataFrame,
    ret: str = "pnl_pct",
    periods_per_year: float = 365.0,
    by: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("ts", "trade_id"),
    chunk: Column | None = None,
) -> DataFrame:
    """Win rate, profit factor, expectancy, Sharpe, Sortino, VaR and CVaR at 5 %, drawdown, Calmar, moments, t."""
    x = F.col(ret)
    n = F.count(F.lit(1))
    ann = periods_per_year**0.5
    base = trades.groupBy(*by).agg(
        n.alias("trades"),
        (F.count_if(x > 0) * 1.0 / n).alias("win_rate"),
        profit_factor(ret).alias("profit_factor"),
        F.avg(x).alias("expectancy"),
        F.stddev_samp(x).alias("_s"),
        F.sqrt(F.avg(F.when(x < 0, x * x).otherwise(0.0))).alias("_down"),
        sample_skewness(ret).alias("skewness"),
        sample_kurtosis(ret).alias("kurtosis"),
        F.sum(x).alias("total"),
    )
    var = exact_quantiles(trades, x, {"var_5": 0.05}, by)
    tail = join_stats(trades, var, by).where(x <= F.col("var_5")).groupBy(*by).agg(F.avg(x).alias("cvar_5"))
    eq = running_totals(trades.select(*by, *order, ret, *stored_chunk(trades)), {"_eq": x}, by, order, chunk)
    dd = drawdowns(eq, "_eq", by, order, floor_zero=True, chunk=chunk).groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"))
    d = base
    for s in (var, tail, dd):
        d = join_stats(d, s, by)
    return d.withColumns(
        {
            "sharpe": div(F.col("expectancy"), "_s") * ann,
            "sortino": div(F.col("expectancy"), "_down") * ann,
            "calmar": div(F.col("total"), F.abs("max_drawdown")),
            "t_stat": div(F.col("expectancy"), F.col("_s") / F.sqrt("trades")),
        }
    ).drop("_s", "_down")


def live_performance(trades: DataFrame, as_of: str, by: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "trade_id"), chunk: Column | None = None) -> DataFrame:
    """All-time and last-24-hour figures, and the share of 10-trade blocks that made money."""
    at = as_ts(as_of)
    d = trades.where(F.col("ts") <= at)
    recent = F.col("ts") > at - F.expr("interval 24 hours")
    n = F.count(F.lit(1))
    base = d.groupBy(*by).agg(
        n.alias("trades"),
        F.sum("pnl").alias("pnl"),
        (F.count_if(F.col("pnl") > 0) * 1.0 / n).alias("win_rate"),
        profit_factor("pnl").alias("profit_factor"),
        F.count_if(recent).alias("trades_24h"),
        F.coalesce(F.sum(F.when(recent, F.col("pnl"))), F.lit(0.0)).alias("pnl_24h"),
    )
    blocks = block_windows(d, 10, "pnl", by, order, chunk).groupBy(*by).agg(
        F.avg((F.col("total") > 0).cast("double")).alias("consistency")
    )
    return join_stats(base, blocks, by)


def performance_by(trades: DataFrame, by: Sequence[str], ret: str = "pnl_pct") -> DataFrame:
    """Counts, win rate, mean, deviation, Sharpe and share of trades per group (regime, session)."""
    n = F.count(F.lit(1))
    d = trades.groupBy(*by).agg(
        n.alias("trades"),
        (F.count_if(F.col(ret) > 0) * 1.0 / n).alias("win_rate"),
        F.avg(ret).alias("mean"),
        F.stddev_samp(ret).alias("std"),
    )
    d = d.withColumn("sharpe", div("mean", "std"))
    return d.withColumn("trade_share", F.col("trades") / F.sum("trades").over(Window.partitionBy()))  # one row per group


def portfolio_returns(rets: DataFrame, weights: DataFrame, x: str = "ret", ts: str = "ts") -> DataFrame:
    """Weighted sum of symbol returns per timestamp; symbols without a return count as 0."""
    return (
        rets.where(F.col(x).isNotNull())
        .join(weights.select("symbol", "weight"), "symbol")
        .groupBy(ts)
        .agg(F.sum(F.col("weight") * F.col(x)).alias("port_ret"))
    )


def var_es(returns: DataFrame, x: str, confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Historical VaR at sorted index int((1 - c) * n), its expected shortfall, and the normal VaR and shortfall.

    Losses are positive. An empty tail falls back to the VaR.
    """
    returns = settle(returns.select(*by, x))  # read by every part below
    index = F.floor(F.round(F.col("_total") * (1 - confidence), 9))
    cut = exact_order_statistic(returns, F.col(x), index, by, "_cut")
    tail = join_stats(returns, cut, by).where(F.col(x) < F.col("_cut")).groupBy(*by).agg(F.avg(x).alias("_tail"))
    base = returns.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    d = join_stats(join_stats(base, cut, by), tail, by)
    z, phi = Z[confidence], PHI[confidence]
    return d.withColumns(
        {
            "var_hist": -F.col("_cut"),
            "es_hist": -F.coalesce("_tail", "_cut"),
            "var_normal": F.col("_s") * z - F.col("_m"),
            "es_normal": F.col("_s") * (phi / (1 - confidence)) - F.col("_m"),
        }
    ).drop("_cut", "_tail", "_m", "_s")


def hash_normals(*on: Column) -> Column:
    """A standard normal number for each value of the columns, the same on any cluster: two uniform numbers from a digest (Box-Muller)."""
    digest = F.md5(F.concat_ws("-", *[c.cast("string") for c in on]))
    part = lambda at: (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.sqrt(F.log(part(1)) * -2.0) * F.cos(part(9) * (2 * math.pi))


def monte_carlo_var(returns: DataFrame, x: str, confidence: float = 0.95, draws_per_row: int = 10, seed: int = 7, order: str = "ts") -> DataFrame:
    """VaR and shortfall of normal draws with the sample's mean and deviation; draws grow with the rows given.

    A draw depends on its row's ``order``, its number and the seed alone, not on partitions.
    """
    base = returns.agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    at = F.unix_micros(F.col(order).cast("timestamp"))
    sims = returns.select(at.alias("_t"), F.explode(F.sequence(F.lit(1), F.lit(draws_per_row))).alias("_i"))
    sims = sims.select(hash_normals(F.lit(seed), F.col("_t"), F.col("_i")).alias("_z"))
    sims = join_stats(sims, base, []).select((F.col("_m") + F.col("_s") * F.col("_z")).alias(x))
    # var_es writes the draws down before it reads them several times
    return var_es(sims, x, confidence).select("n", F.col("var_hist").alias("var_mc"), F.col("es_hist").alias("es_mc"))


def kupiec(violations: Column, n: Column, p: float) -> Column:
    """Likelihood ratio of the observed violation share against p; null with no or only violations."""
    rate = violations / n
    inside = (violations > 0) & (violations < n)
    x, q = F.when(inside, rate), F.when(inside, 1 - rate)
    at_null = (n - violations) * F.log(F.lit(1 - p)) + violations * F.log(F.lit(p))
    at_seen = (n - violations) * F.log(q) + violations * F.log(x)
    return -2 * (at_null - at_seen)


def rolling_var(returns: DataFrame, x: str, n: int = 252, q: float = 0.05, keys: Sequence[str] = (), order: Sequence[str] = ("ts",)) -> DataFrame:
    """VaR forecast from the n rows before each row, and whether the row's loss exceeds it."""

    def build(d, fr):
        w = fr.span(-n, -1)
        var = F.when(F.count(x).over(w) >= n, -F.percentile(x, F.lit(q)).over(w))
        d = d.withColumn("var", var)
        return d.withColumns({"violation": -F.col(x) > F.col("var"), "violation_abs": F.abs(F.col(x)) > F.abs("var")})

    return framed(returns, build, before=n, keys=keys, order=order)


def var_backtest(returns: DataFrame, x: str, n: int = 252, q: float = 0.05, keys: Sequence[str] = ()) -> DataFrame:
    """Violations of the rolling VaR, their rate and the Kupiec test (chi-square with one degree by the normal tail)."""
    d = rolling_var(returns, x, n, q, keys).where(F.col("var").isNotNull())
    out = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if("violation").alias("violations"),
        F.count_if("violation_abs").alias("violations_abs"),
    )
    out = out.withColumns(
        {"rate": F.col("violations") / F.col("days"), "kupiec": kupiec(F.col("violations"), F.col("days"), q)}
    )
    return out.withColumn("p_value", (1 - normal_cdf(F.sqrt(F.greatest("kupiec", F.lit(0.0))))) * 2)


# fixed values: name, market move, volatility factor, share of liquidity lost
SCENARIOS = [
    ("market_crash", -0.20, 3.0, 0.5),
    ("flash_crash", -0.10, 5.0, 0.7),
    ("volatility_spike", -0.05, 4.0, 0.2),
    ("liquidity_crisis", -0.08, 2.0, 0.8),
    ("mild_correction", -0.05, 1.5, 0.1),
]


def stress_losses(positions: DataFrame, base_vol: float = 0.02, scenarios: Sequence[tuple] = SCENARIOS) -> DataFrame:
    """Loss of the whole book per scenario: market move, volatility and liquidity parts, share of gross, level."""
    book = positions.agg(F.sum(F.abs("market_value")).alias("gross"), F.sum("market_value").alias("net"))
    rows = F.array(
        *[F.struct(F.lit(n).alias("scenario"), F.lit(m).alias("shock"), F.lit(v).alias("vol_factor"), F.lit(l).alias("illiquid")) for n, m, v, l in scenarios]
    )
    d = book.select("gross", "net", F.inline(rows))
    d = d.withColumns(
        {
            "market_loss": F.col("gross") * F.abs("shock"),
            "vol_loss": F.col("gross") * base_vol * F.col("vol_factor"),
            "liquidity_loss": F.col("gross") * F.col("illiquid") * 0.01,
        }
    )
    d = d.withColumn("loss", F.col("market_loss") + F.col("vol_loss") + F.col("liquidity_loss"))
    d = d.withColumn("loss_share", div("loss", "gross"))
    return d.withColumn("level", ladder("loss_share", [(0.2, "critical"), (0.1, "high"), (0.05, "medium")], "low"))


def covariance(rets: DataFrame, x: str = "ret", at: Sequence[str] = ("ts",)) -> DataFrame:
    """Sample covariance of every pair a <= b over common timestamps."""
    return pair_moments(rets, x, at, diagonal=True).select("a", "b", "cov")


def risk_attribution(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """Marginal and component risk of each symbol, its share, and the diversification ratio of the book.

    Works on one row per symbol pair; covariances come with a <= b.
    """
    full = symmetric(cov, ["cov"])
    wa = weights.select(F.col("symbol").alias("a"), F.col("weight").alias("_wa"))
    wb = weights.select(F.col("symbol").alias("b"), F.col("weight").alias("_wb"))
    d = full.join(wa, "a").join(wb, "b")
    d = d.groupBy("a").agg(
        F.max("_wa").alias("weight"),
        F.sum(F.col("cov") * F.col("_wb")).alias("_sw"),
        F.max(F.when(F.col("a") == F.col("b"), F.sqrt("cov"))).alias("vol"),
    )
    book = d.agg(
        F.sqrt(F.sum(F.col("weight") * F.col("_sw"))).alias("portfolio_vol"),
        F.sum(F.abs("weight") * F.col("vol")).alias("_wvol"),
    )
    d = join_stats(d, book, [])
    d = d.withColumn("marginal", div("_sw", "portfolio_vol"))
    d = d.withColumn("component", F.col("weight") * F.col("marginal"))
    return d.select(
        F.col("a").alias("symbol"),
        "weight",
        "vol",
        "portfolio_vol",
        "marginal",
        "component",
        div("component", "portfolio_vol").alias("share"),
        div("_wvol", "portfolio_vol").alias("diversification"),
    )


def marginal_var(rets: DataFrame, weights: DataFrame, bump: float = 0.001, q: float = 0.05, x: str = "ret") -> DataFrame:
    """Change of historical VaR per unit of weight when one weight is raised and all are rescaled.

    The bumped return is (R + bump * r_i) / (1 + bump), one row per (symbol, time) as in the input.
    """
    # each is read several times below
    rets, weights = settle(rets.where(F.col(x).isNotNull()).select("symbol", "ts", x)), settle(weights.select("symbol", "weight"))
    port = settle(portfolio_returns(rets, weights, x))
    total = weights.agg(F.sum("weight").alias("_tw"))
    d = rets.join(port, "ts").join(weights.select("symbol"), "symbol", "left_semi")
    d = join_stats(d, total, [])
    d = d.withColumn("_b", (F.col("port_ret") + F.col(x) * bump) * F.col("_tw") / (F.col("_tw") + bump))
    base = exact_quantiles(port, F.col("port_ret"), {"_q0": q})
    each = exact_quantiles(d, F.col("_b"), {"_q1": q}, ["symbol"])
    return join_stats(each, base, []).select(
        "symbol", (-F.col("_q0")).alias("var"), ((F.col("_q0") - F.col("_q1")) / bump).alias("marginal_var")
    )


def beta_concentration(rets: DataFrame, weights: DataFrame, reference: str, population: bool = False) -> DataFrame:
    """Beta of the book to a reference symbol (covariance with n-1 over variance with n if ``population``), and HHI."""
    port = portfolio_returns(rets, weights)
    ref = rets.where(F.col("symbol") == reference).select("ts", F.col("ret").alias("_ref"))
    var = F.var_pop("_ref") if population else F.var_samp("_ref")
    d = port.join(ref, "ts").where(F.col("_ref").isNotNull())
    b = d.agg((F.covar_samp("port_ret", "_ref") / var).alias("beta"), F.count(F.lit(1)).alias("n"))
    h = weights.agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.max(F.abs("weight")).alias("largest"))
    return b.join(F.broadcast(h), how="cross")  # two one-row aggregates side by side


def kelly_weights(trades: DataFrame, by: Sequence[str] = ("symbol",), low: float = 0.0, high: float = 0.25, ret: str = "pnl_pct") -> DataFrame:
    """f = (b p - q) / b from each key's own trades, times mean confidence, clipped."""
    x = F.col(ret)
    d = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"),
        (F.count_if(x > 0) * 1.0 / F.count(F.lit(1))).alias("p"),
        F.avg(F.when(x > 0, x)).alias("_w"),
        F.abs(F.avg(F.when(x < 0, x))).alias("_l"),
        F.avg("confidence").alias("confidence"),
    )
    d = d.withColumn("b", div("_w", "_l"))
    f = (F.col("b") * F.col("p") - (1 - F.col("p"))) / F.when(F.col("b") != 0, F.col("b"))
    return d.withColumns(
        {"kelly": f, "weight": F.greatest(F.lit(low), F.least(f * F.col("confidence"), F.lit(high)))}
    ).drop("_w", "_l")


def vol_target_weights(vols: DataFrame, target: float, gross_cap: float = 1.0, top: int | None = None) -> DataFrame:
    """Weights by inverse volatility (scale clipped to 0.2..2), the largest ``top`` kept, then capped to the gross limit.

    ``vols`` has one row per symbol with ``weight`` and ``vol``.
    """
    scale = F.greatest(F.lit(0.2), F.least(F.lit(2.0), F.lit(target) / F.when(F.col("vol") > 0, F.col("vol"))))
    d = vols.withColumn("scaled", F.col("weight") * scale)
    if top is not None:
        d = d.orderBy(F.abs("scaled").desc(), "symbol").limit(top)
    total = d.agg(F.sum(F.abs("scaled")).alias("_gross"))
    d = join_stats(d, total, [])
    return d.withColumns(
        {
            "normalized": div("scaled", "_gross"),
            "capped": F.col("scaled") * F.least(F.lit(1.0), div(F.lit(gross_cap), "_gross")),
        }
    ).drop("_gross")


def portfolio_summary(weights: DataFrame, cov: DataFrame, expected: DataFrame, z: float = Z[0.95]) -> DataFrame:
    """Gross, net, long, short, expected return, volatility, Sharpe and normal VaR of one book."""
    w = F.col("weight")
    d = weights.join(expected, "symbol", "left").agg(
        F.count(F.lit(1)).alias("positions"),
        F.sum(F.abs(w)).alias("gross"),
        F.sum(w).alias("net"),
        F.coalesce(F.sum(F.when(w > 0, w)), F.lit(0.0)).alias("long"),
        F.coalesce(F.sum(F.when(w < 0, -w)), F.lit(0.0)).alias("short"),
        F.sum(w * F.col("expected")).alias("expected_return"),
    )
    vol = risk_attribution(cov, weights).agg(F.max("portfolio_vol").alias("volatility"))
    d = d.join(F.broadcast(vol), how="cross")  # two one-row aggregates side by side
    return d.withColumns({"sharpe": div("expected_return", "volatility"), "var": F.col("volatility") * z})


def position_risk(positions: DataFrame, vols: DataFrame, volumes: DataFrame, confidence: float = 0.95, multiplier: float = 1.0, participation: float = 0.1) -> DataFrame:
    """VaR over 1 and 5 days, shortfall, concentration and days to liquidate per position."""
    total = positions.agg(F.sum(F.abs("market_value")).alias("_gross"))
    d = join_stats(positions.join(vols, "symbol", "left").join(volumes, "symbol", "left"), total, [])
    var = F.abs("market_value") * F.col("vol") * Z[confidence] * multiplier
    return d.withColumns(
        {
            "var_1d": var,
            "var_5d": var * 5**0.5,
            "shortfall": F.abs("market_value") * F.col("vol") * (PHI[confidence] / (1 - confidence)) * multiplier,
            "concentration": div(F.abs("market_value"), "_gross"),
            "days_to_liquidate": div(F.abs("qty"), F.col("daily_volume") * participation),
        }
    ).drop("_gross")


def correlation_limits(corr: DataFrame, positions: DataFrame, limit: float = 0.8, min_exposure: float = 10_000.0) -> DataFrame:
    """Pairs whose |correlation| is above the limit with joint exposure above the floor, and the size factor."""
    pa = positions.select(F.col("symbol").alias("a"), F.abs("market_value").alias("_ea"))
    pb = positions.select(F.col("symbol").alias("b"), F.abs("market_value").alias("_eb"))
    d = corr.join(pa, "a").join(pb, "b").withColumn("exposure", F.col("_ea") + F.col("_eb"))
    factor = F.greatest(F.lit(0.0), 1 - (F.abs("corr") - limit) * 2)
    return (
        d.where((F.abs("corr") > limit) & (F.col("exposure") > min_exposure))
        .withColumn("size_factor", factor)
        .drop("_ea", "_eb")
    )


def mark_positions(entries: DataFrame, exits: DataFrame, marks: DataFrame, key: str = "key") -> DataFrame:
    """Profit of each position: realised against its exit, else unrealised against the symbol's last mark."""
    x = exits.select(key, F.col("price").alias("exit_price"), F.col("ts").alias("exit_ts"))
    d = entries.join(x, key, "left").join(marks.select("symbol", "mark"), "symbol", "left")
    sign = F.when(F.col("side") == "SELL", -1).otherwise(1)
    price = F.coalesce("exit_price", "mark")
    pnl = (price - F.col("price")) * F.col("qty") * sign
    return d.withColumns(
        {
            "is_open": F.col("exit_ts").isNull(),
            "pnl": pnl,
            "pnl_pct": div((price - F.col("price")) * 100 * sign, "price"),
            "holding_minutes": (F.unix_micros(F.col("exit_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 6e7,
        }
    )


def var_breach_rate(daily: DataFrame, expected_pct: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """Days with profit below -VaR, their share in percent, and whether it is within 2 points of the expected."""
    d = daily.where(F.col("var").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"), F.count_if(F.col("pnl") < -F.col("var")).alias("breaches")
    )
    d = d.withColumn("breach_pct", F.col("breaches") * 100.0 / F.col("days"))
    return d.withColumn("good", F.abs(F.col("breach_pct") - expected_pct) <= 2.0)


def trade_costs(
    trades: DataFrame,
    market_volume: str | Column,
    base: float = 0.0005,
    impact: float = 0.1,
    vol_term: float = 0.0001,
    cap: float = 0.01,
    funding_8h: float = 0.0001,
    commission: float = 0.0004,
    model: str = "linear",
) -> DataFrame:
    """Slippage (linear or square-root impact, capped), funding per full 8 hours, commission, net profit."""
    size = F.abs(F.col("quantity") * F.col("price"))
    if model == "linear":
        moved = F.least(div(size, col(market_volume) * F.col("price")), F.lit(0.01)) * impact
    else:
        moved = F.sqrt(F.col("quantity") / 1_000_000.0) * 0.0001
    d = trades.withColumns(
        {
            "slippage": F.least(F.coalesce(moved, F.lit(0.0)) + base + vol_term, F.lit(cap)),
            "funding": F.floor(F.col("holding_minutes") / 480) * funding_8h * size,
            "commission": size * commission * 2,
        }
    )
    return d.withColumn("total_cost", F.col("slippage") * size + F.col("funding") + F.col("commission"))


def realized_volatility(rets: DataFrame, n: int, bars_per_day: float, x: str = "ret", low: float = 0.01, high: float = 0.5, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rolling deviation per day (clipped) and per year of 365 days."""

    def build(d, fr):
        s = fr.std(x, n)
        return d.withColumns(
            {
                "daily_vol": F.when(s.isNotNull(), F.greatest(F.lit(low), F.least(s * bars_per_day**0.5, F.lit(high)))),
                "annual_vol": s * (bars_per_day * 365) ** 0.5,
            }
        )

    return framed(rets, build, before=n, keys=keys)


def tier_weights(weights: DataFrame, tiers: DataFrame) -> DataFrame:
    """Weight share and symbols per tier."""
    d = weights.join(tiers.select("symbol", "tier"), "symbol", "left").groupBy("tier").agg(
        F.count(F.lit(1)).alias("symbols"), F.sum(F.abs("weight")).alias("weight")
    )
    return d.withColumn("share", div(F.col("weight"), F.sum("weight").over(Window.partitionBy())))  # one row per tier


# fixed values: category weights of the symbol score
SCORE_WEIGHTS = {"performance": 0.30, "liquidity": 0.20, "volatility": 0.15, "correlation": 0.15, "structure": 0.10, "momentum": 0.10}


def performance_score() -> Column:
    """0..100 from win_rate (percent), win/loss ratio and Sharpe."""
    return (
        F.least(F.col("win_rate"), F.lit(100.0)) * 0.4
        + F.least(F.col("win_loss") * 20, F.lit(35.0))
        + F.greatest(F.lit(0.0), F.least(F.col("sharpe") * 12.5, F.lit(25.0)))
    )


def liquidity_score(min_usd: float, preferred_bps: float = 5.0, max_bps: float = 20.0) -> Column:
    """0..100 from volume_usd (60 points) and spread_bps (40 points), piecewise linear."""
    r = F.col("volume_usd") / min_usd
    volume = F.when(r >= 5, 60.0).when(r >= 1, (r - 1) / 4 * 30 + 30).otherwise(r * 30)
    s = F.col("spread_bps")
    spread = (
        F.when(s <= preferred_bps, 40.0)
        .when(s <= max_bps, 40 - (s - preferred_bps) / (max_bps - preferred_bps) * 20)
        .otherwise(F.greatest(F.lit(0.0), 20 - (s - max_bps)))
    )
    return volume + spread


def volatility_score(best: tuple[float, float] = (0.03, 0.08), worst: float = 0.15) -> Column:
    """0..100 from atr_pct (70 points in the best range) and its steadiness atr_std (30 points)."""
    a = F.col("atr_pct")
    lo, hi = best
    points = (
        F.when(a < lo, a / lo * 70)
        .when(a <= hi, 70.0)
        .when(a <= worst, 70 - (a - hi) / (worst - hi) * 40)
        .otherwise(10.0)
    )
    return points + F.lit(30.0) / (F.col("atr_std") + 1)


def correlation_score(limit: float = 0.7, factor: float = 2.0) -> Column:
    """100 up to 0.3, down to 50 at the limit, falling fast beyond."""
    m = F.col("max_corr")
    s = (
        F.when(m.isNull() | (m <= 0.3), 100.0)
        .when(m <= limit, 100 - (m - 0.3) / (limit - 0.3) * 50)
        .otherwise(50 - (m - limit) * factor * 100)
    )
    return F.greatest(F.lit(0.0), s)


def symbol_scores(parts: DataFrame, min_usd: float, weights: dict[str, float] = SCORE_WEIGHTS) -> DataFrame:
    """Category scores, weighted total and rank; the structure and momentum points come ready in ``parts``."""
    d = parts.withColumns(
        {
            "performance": performance_score(),
            "liquidity": liquidity_score(min_usd),
            "volatility": volatility_score(),
            "correlation": correlation_score(),
        }
    )
    total = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    d = d.withColumn("total", total)
    return d.withColumn("rank", F.rank().over(Window.partitionBy().orderBy(F.col("total").desc())))  # one row per symbol
