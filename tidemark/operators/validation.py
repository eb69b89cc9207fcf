"""Time-aware splits, drift and selection measures, statistical tests."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.candles import normal_cdf, two_sided_p
from tidemark.functions.core import col, div, epoch_s, ladder
from tidemark.operators.draws import draws
from tidemark.operators.frames import CHUNK, balanced_chunks, prefix, with_row_number
from tidemark.operators.order_stats import VALUE, average_rank, exact_quantiles, join_stats, ordered_counts
from tidemark.operators.quality import long_form
from tidemark.session import settle
from tidemark.sources.scan import as_ts


def time_split(df: DataFrame, train: float = 0.6, valid: float = 0.2, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), chunk: Column | None = None) -> DataFrame:
    """Label rows train, validation or test by their place in time order per key."""
    d = with_row_number(df, keys, order, chunk, "_i")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = join_stats(d, n, keys)
    a, b = F.floor(F.round(F.col("_n") * train, 9)), F.floor(F.round(F.col("_n") * (train + valid), 9))
    split = F.when(F.col("_i") <= a, "train").when(F.col("_i") <= b, "validation").otherwise("test")
    return d.withColumn("split", split).drop("_i", "_n")


def purged_folds(df: DataFrame, folds: int, purge: int, embargo: int, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """(fold, role) for every row: equal test blocks; training rows keep ``purge`` rows clear before the block
    and ``embargo`` rows after it. Rows inside the gaps are left out of that fold."""
    d = with_row_number(df, keys, order, out="_i")
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = join_stats(d, n, keys).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    size = F.floor(F.col("_n") / folds)
    lo, hi = F.col("fold") * size, F.when(F.col("fold") == folds - 1, F.col("_n")).otherwise((F.col("fold") + 1) * size)
    i = F.col("_i") - 1
    role = F.when((i >= lo) & (i < hi), "test").when((i < lo - purge) | (i >= hi + embargo), "train")
    return d.withColumn("role", role).where(F.col("role").isNotNull()).drop("_i", "_n")


def expanding_folds(df: DataFrame, folds: int, gap_hours: float, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """(fold, role) by time: training grows from the start and ends ``gap_hours`` before the fold's test span."""
    span = df.groupBy(*keys).agg(F.min(epoch_s(ts)).alias("_a"), F.max(epoch_s(ts)).alias("_b"))
    d = join_stats(df, span, keys).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    step = (F.col("_b") - F.col("_a")) / (folds + 1)
    start = F.col("_a") + step * F.col("fold")
    t = epoch_s(ts)
    last = F.col("fold") == folds
    role = F.when((t >= start) & ((t < start + step) | last), "test").when(t < start - gap_hours * 3600, "train")
    return d.withColumn("role", role).where(F.col("role").isNotNull()).drop("_a", "_b")


def walk_forward(trades: DataFrame, start: str, train_days: int, test_days: int, step_days: int, windows: int, ret: str = "pnl_pct", ts: str = "ts") -> DataFrame:
    """Train and test figures of each window and the decay between them; a row is listed only for windows that cover it."""
    at = as_ts(start)
    day = 86_400
    past = (epoch_s(ts) - epoch_s(at)) / day
    last = F.least(F.floor(past / step_days), F.lit(windows - 1))
    first = F.greatest(F.floor((past - (train_days + test_days)) / step_days) + 1, F.lit(0))
    d = trades.withColumn("window", F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn("window", F.col("window").cast("int"))
    t = epoch_s(ts) - epoch_s(at) - F.col("window") * (step_days * day)
    role = F.when((t >= 0) & (t < train_days * day), "train").when((t >= train_days * day) & (t < (train_days + test_days) * day), "test")
    d = d.withColumn("role", role).where(F.col("role").isNotNull())

    def of(role_name, agg):
        return agg(F.when(F.col("role") == role_name, F.col(ret)))

    out = d.groupBy("window").agg(
        F.count_if(F.col("role") == "train").alias("train_trades"),
        F.count_if(F.col("role") == "test").alias("test_trades"),
        of("train", F.avg).alias("train_mean"),
        of("test", F.avg).alias("test_mean"),
        of("train", F.stddev_samp).alias("_s1"),
        of("test", F.stddev_samp).alias("_s2"),
    )
    return out.withColumns(
        {
            "train_sharpe": div("train_mean", "_s1"),
            "test_sharpe": div("test_mean", "_s2"),
            "decay": F.col("train_mean") - F.col("test_mean"),
        }
    ).drop("_s1", "_s2")


def quantile_edges(base: DataFrame, bins: int, key: str = "feature") -> DataFrame:
    """Distinct quantile edges of ``value`` per feature as a sorted array."""
    probs = {f"_e{i}": i / bins for i in range(bins + 1)}
    q = exact_quantiles(base, F.col("value"), probs, [key])
    return q.select(key, F.array_sort(F.array_distinct(F.array(*probs))).alias("_edges"))


def bin_index(edges: Column, x: Column) -> Column:
    """Right-closed bin (lowest value in the first), null outside the edges."""
    above = F.size(F.filter(edges, lambda e: e < x))
    n = F.size(edges)
    inside = (x >= F.try_element_at(edges, F.lit(1))) & (x <= F.try_element_at(edges, F.lit(-1))) & (n > 1)
    return F.when(inside, F.greatest(above, F.lit(1)))


def psi(base: DataFrame, other: DataFrame, cols: Sequence[str], bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability index per feature over baseline quantile bins; empty shares count as ``floor``.

    Values of ``other`` outside the baseline range are dropped. Grades: 0.1 and 0.2.
    """
    a = long_form(base, cols).where(F.col("value").isNotNull())
    b = long_form(other, cols).where(F.col("value").isNotNull())
    edges = quantile_edges(a, bins)
    both = a.withColumn("_b", F.lit(1)).unionByName(b.withColumn("_b", F.lit(0)))
    d = join_stats(both, edges, ["feature"]).withColumn("bin", bin_index(F.col("_edges"), F.col("value")))
    counts = d.where(F.col("bin").isNotNull()).groupBy("feature", "bin").agg(
        F.sum("_b").alias("_nb"), F.sum(1 - F.col("_b")).alias("_no"), F.max(F.size("_edges")).alias("_k")
    )
    # a bin that neither sample hits adds nothing: both shares equal the floor
    w = Window.partitionBy("feature")  # at most ``bins`` rows per feature
    p = F.greatest(F.lit(floor), div("_nb", F.sum("_nb").over(w)))
    q = F.greatest(F.lit(floor), div("_no", F.sum("_no").over(w)))
    terms = counts.withColumn("_t", (q - p) * F.log(q / p))
    out = terms.groupBy("feature").agg(F.sum("_t").alias("psi"), F.count(F.lit(1)).alias("bins"))
    return out.withColumn("grade", ladder("psi", [(0.2, "major"), (0.1, "moderate")], "stable"))


def information_value(df: DataFrame, cols: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Weight-of-evidence sum per feature over half-open quantile bins; bins missing a class are skipped."""
    d = long_form(df, cols, [label]).where(F.col("value").isNotNull())
    d = join_stats(d, quantile_edges(d, bins), ["feature"]).withColumn("bin", bin_index(F.col("_edges"), F.col("value")))
    c = d.groupBy("feature", "bin").agg(F.sum(label).alias("_good"), F.sum(1 - F.col(label)).alias("_bad"))
    w = Window.partitionBy("feature")  # at most ``bins`` rows per feature
    g, b = div("_good", F.sum("_good").over(w)), div("_bad", F.sum("_bad").over(w))
    c = c.withColumn("_t", F.when((F.col("_good") > 0) & (F.col("_bad") > 0), (g - b) * F.log(g / b)))
    out = c.groupBy("feature").agg(F.coalesce(F.sum("_t"), F.lit(0.0)).alias("iv"))
    return out.withColumn("strength", ladder("iv", [(0.5, "suspicious"), (0.3, "strong"), (0.1, "medium"), (0.02, "weak")], "none"))


def mutual_information(df: DataFrame, cols: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Binned mutual information (nats) of each column with the target, equal-width bins."""
    d = long_form(df, cols, [target]).where(F.col("value").isNotNull() & F.col(target).isNotNull())
    s = d.groupBy("feature").agg(
        F.min("value").alias("_a"), F.max("value").alias("_b"), F.min(target).alias("_c"), F.max(target).alias("_d")
    )
    d = join_stats(d, s, ["feature"])

    def width_bin(x, lo, hi):
        k = F.floor(div((x - lo) * bins, hi - lo))
        return F.coalesce(F.least(k, F.lit(bins - 1)), F.lit(0))

    d = d.select("feature", width_bin(F.col("value"), F.col("_a"), F.col("_b")).alias("bx"), width_bin(F.col(target), F.col("_c"), F.col("_d")).alias("by"))
    c = d.groupBy("feature", "bx", "by").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("feature")  # at most bins * bins rows per feature
    total = F.sum("_n").over(w)
    px = F.sum("_n").over(Window.partitionBy("feature", "bx")) / total
    py = F.sum("_n").over(Window.partitionBy("feature", "by")) / total
    p = F.col("_n") / total
    c = c.withColumn("_t", p * F.log(p / (px * py)))
    return c.groupBy("feature").agg(F.sum("_t").alias("mi"))


def pair_mutual_information(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Binned mutual information (nats) of every pair a < b of columns over the rows that have both, equal-width bins of each column.

    Two passes: the ranges of all columns, then the joint histograms of all pairs; a row gives one code for
    each pair, and at most bins * bins counts of a pair leave a task.
    """
    bounds = df.agg(*[f(c).cast("double").alias(f"_{n}{k}") for k, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))])
    d = df.select(*[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(cols)]).crossJoin(F.broadcast(bounds))  # one row

    def code(k: int) -> Column:
        place = F.floor(div((F.col(f"_x{k}") - F.col(f"_lo{k}")) * bins, F.col(f"_hi{k}") - F.col(f"_lo{k}")))
        return F.when(F.col(f"_x{k}").isNotNull(), F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("int")).alias(f"_k{k}")

    d = d.select(*[code(k) for k in range(len(cols))])
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    pairs = [(a, b) for i, a in enumerate(order) for b in order[i + 1 :]]
    if not pairs:
        return d.sparkSession.createDataFrame([], "a STRING, b STRING, n BIGINT, mi DOUBLE")
    cells = F.array_compact(
        F.array(*[
            F.when(F.col(f"_k{a}").isNotNull() & F.col(f"_k{b}").isNotNull(), F.struct(F.lit(p).alias("p"), F.col(f"_k{a}").alias("bx"), F.col(f"_k{b}").alias("by")))
            for p, (a, b) in enumerate(pairs)
        ])
    )
    c = d.select(F.inline(cells)).groupBy("p", "bx", "by").agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy("p"))  # at most bins * bins rows a pair
    px, py = (F.sum("_n").over(Window.partitionBy("p", k)) / total for k in ("bx", "by"))
    share = F.col("_n") / total
    c = c.withColumn("_t", share * F.log(share / (px * py))).groupBy("p").agg(F.sum("_n").alias("n"), F.sum("_t").alias("mi"))
    names = F.array(*[F.struct(F.lit(cols[a]).alias("a"), F.lit(cols[b]).alias("b")) for a, b in pairs])
    pair = names[F.col("p")]
    return c.select(pair["a"].alias("a"), pair["b"].alias("b"), "n", "mi")


def label_correlations(df: DataFrame, cols: Sequence[str], label: str, limit: float = 0.8) -> DataFrame:
    """Correlation of every column with the label in one pass; above the limit it may leak the label."""
    d = long_form(df, cols, [label])
    out = d.groupBy("feature").agg(F.corr("value", F.col(label).cast("double")).alias("corr"), F.count("value").alias("n"))
    named = F.col("feature").rlike("(?i)future|forward|target|label")
    return out.withColumn("suspect", (F.abs("corr") > limit) | named)


def information_coefficients(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Pearson and rank (average ranks) correlation of every column with the label.

    Ranks come from counts per distinct value, so no column is sorted in one task.
    """
    d = long_form(df, cols, [label]).where(F.col("value").isNotNull() & F.col(label).isNotNull())
    pearson = d.groupBy("feature").agg(F.corr("value", label).alias("ic"), F.count(F.lit(1)).alias("n"))
    rx = ordered_counts(d, F.col("value"), ["feature"]).select("feature", F.col(VALUE).alias("value"), average_rank().alias("_rx"))
    ry = ordered_counts(d, F.col(label), ["feature"]).select("feature", F.col(VALUE).alias(label), average_rank().alias("_ry"))
    ranked = d.join(rx, ["feature", "value"]).join(ry, ["feature", label])
    rank_ic = ranked.groupBy("feature").agg(F.corr("_rx", "_ry").alias("rank_ic"))
    return pearson.join(rank_ic, "feature")


def ks_statistic(df: DataFrame, x: Column, in_a: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Largest distance of the two samples' distribution functions, sizes and the asymptotic two-term p-value."""
    c = ordered_counts(df, x, keys, {"a": in_a.cast("int"), "b": (~in_a).cast("int")})
    t = join_stats(c, c.groupBy(*keys).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b")), keys)
    gap = F.abs(div(F.col("a_before") + F.col("a"), "n_a") - div(F.col("b_before") + F.col("b"), "n_b"))
    out = t.groupBy(*keys).agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.max(gap).alias("ks"))
    lam = F.col("ks") * F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    p = (F.exp(lam * lam * -2) - F.exp(lam * lam * -8)) * 2
    return out.withColumn("p_value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def welch_t(df: DataFrame, x: str, in_a: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Welch statistic, degrees of freedom and the normal-tail p-value (for large samples)."""
    a, b = F.when(in_a, F.col(x)), F.when(~in_a, F.col(x))
    d = df.groupBy(*keys).agg(
        F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.var_samp(a).alias("_va"), F.var_samp(b).alias("_vb"),
    )
    sa, sb = F.col("_va") / F.col("n_a"), F.col("_vb") / F.col("n_b")
    d = d.withColumns(
        {
            "t": div(F.col("mean_a") - F.col("mean_b"), F.sqrt(sa + sb)),
            "dof": div((sa + sb) * (sa + sb), sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1)),
        }
    )
    return d.withColumn("p_value", two_sided_p("t")).drop("_va", "_vb")


def mann_kendall(df: DataFrame, x: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Trend test of a series of one row per ``order``: S, Z without tie correction, p. Null values take no part.

    S is the number of rising pairs less that of falling ones: each value counts the smaller and the larger
    ones before it, in blocks that double, so a long series is spread over the cluster.
    """
    from tidemark.operators.rolling import history_counts

    d = df.select(*keys, order, F.col(x).cast("double").alias("_x"))
    d = history_counts(d, "_x", keys, [order])
    rising = F.col("_below") - (F.col("_row") + 1 - F.col("_upto"))
    d = d.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum(rising).cast("double").alias("s"))
    n = F.col("n").cast("double")
    var = n * (n - 1) * (n * 2 + 5) / 18
    z = F.when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt(var)).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt(var)).otherwise(0.0)
    return d.withColumn("z", z).withColumn("p_value", two_sided_p("z"))


TEST_ROWS = 50_000  # tests in a slice


def adjust_p_values(df: DataFrame, p: str, family: Sequence[str] = (), tie: Sequence[str] = (), rows: int = TEST_ROWS) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg values, with the monotone steps (``*_plain`` without them).

    One row per test; a family is a set of tests, not of data rows. Tests are cut into slices of about ``rows``
    in order of p (nulls last); places, the running maximum and the running minimum from behind are carried from slice to slice.
    """
    last = {f"_null_{k}": F.col(c).isNull() for k, c in enumerate((p, *tie))}
    order = [c for pair in zip(last, (p, *tie)) for c in pair]
    keys = ["_family"] if family else []
    d = df.withColumns(last | {k: F.struct(*family) for k in keys})  # a struct of nulls can be joined
    d = balanced_chunks(settle(d), keys, order, rows)
    d = join_stats(d, d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), keys)
    d = settle(prefix(d, {"_i": ("count", F.lit(1))}, keys, order))
    one = F.lit(1.0)
    d = d.withColumns(
        {
            "bonferroni": F.least(one, F.col(p) * F.col("_m")),
            "holm_plain": F.least(one, F.col(p) * (F.col("_m") - F.col("_i") + 1)),
            "bh_plain": F.least(one, F.col(p) * F.col("_m") / F.col("_i")),
            "_back": -F.col("_i"),
        }
    )
    # a frame that ends at unbounded following would be run through anew for each row
    d = prefix(d, {"holm": ("max", F.col("holm_plain"))}, keys, ["_i"])
    d = prefix(d, {"bh": ("min", F.col("bh_plain"))}, keys, ["_back"], chunk=-F.col(CHUNK))
    return d.drop("_m", "_i", "_back", CHUNK, *keys, *last)


def _key_groups(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    rows: dict[tuple, list[int]] = {}
    for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in keys)) if keys else [()] * batch.num_rows):
        rows.setdefault(k, []).append(i)
    for k, at in rows.items():
        yield k, np.array(at)


DRAW_ROWS = 100_000  # rows whose draws a task adds up


def _draw_tasks(df: DataFrame) -> int:
    return max(1, -(-df.count() // DRAW_ROWS))


def sign_flip_test(df: DataFrame, x: str, row_id: str, sims: int = 10_000, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, win rate and Sharpe ratio of ``x`` against their null distribution under random signs.

    The sign of row r in simulation s is bit s % 32 of a hash word of (s // 32, r), so one digest serves
    128 simulations. Tasks add up all simulations as matrix products and send one row per
    (key, simulation); rows are never listed per simulation. p = 2 * tail share, at most 1.
    """
    keys = list(keys)
    d = df.where(F.col(x).isNotNull()).select(*keys, F.col(row_id).cast("string").alias("_id"), F.col(x).cast("double").alias("_x"))
    words = -(-sims // 32)
    schema = T.StructType([d.schema[k] for k in keys] + [T.StructField("sim", T.IntegerType()), T.StructField("_sum", T.DoubleType()), T.StructField("_wins", T.LongType())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            for key, rows in _key_groups(batch, keys):
                ids, v = batch.column("_id").take(pa.array(rows)).to_pylist(), batch.column("_x").to_numpy()[rows]
                got, nonzero = sums.setdefault(key, (np.zeros((2, words, 32)), np.zeros(1)))
                up = (v > 0).astype(float) - (v < 0)
                nonzero += np.count_nonzero(up)
                both = np.stack([v, up])
                for at, numbers, drawn in draws(ids, words):
                    x = both[:, at]
                    for number, word in zip(numbers, drawn):
                        bits = np.unpackbits(word.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
                        got[:, number] += x @ (1 - 2 * bits.view(np.int8)).astype(float)
        for key, (got, nonzero) in sums.items():
            total, signs = got.reshape(2, -1)[:, :sims]
            columns = [pa.array([k] * sims, t) for k, t in zip(key, kinds)]
            columns += [pa.array(np.arange(sims), pa.int32()), pa.array(total), pa.array(((nonzero + signs) / 2).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "sim", "_sum", "_wins"])

    # cut by rows, as the work per row is large; few keys in a task, so few rows leave it
    dealt = d.repartitionByRange(_draw_tasks(d), *keys, "_id")
    null = dealt.mapInArrow(add_up, schema).groupBy(*keys, "sim").agg(F.sum("_sum").alias("_sum"), F.sum("_wins").alias("_wins"))
    seen = d.groupBy(*keys).agg(
        F.avg("_x").alias("observed"), F.count("_x").alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("_sq"),
        F.avg((F.col("_x") > 0).cast("double")).alias("win_rate"), (F.avg("_x") / F.stddev_samp("_x")).alias("sharpe"),
    )
    j = join_stats(null, seen, keys)
    mean = F.col("_sum") / F.col("n")
    deviation = F.sqrt((F.col("_sq") - F.col("n") * mean * mean) / F.when(F.col("n") > 1, F.col("n") - 1))
    j = j.withColumns({"_m": mean, "_w": F.col("_wins") / F.col("n"), "_s": mean / deviation})
    tails, drops = [], []
    for name, null_name in (("observed", "_m"), ("win_rate", "_w"), ("sharpe", "_s")):
        for sign, test in (("ge", F.col(null_name) >= F.col(name)), ("le", F.col(null_name) <= F.col(name))):
            tails.append(F.avg(test.cast("double")).alias(f"_{name}_{sign}"))
            drops.append(f"_{name}_{sign}")
    out = j.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("observed", "n", "win_rate", "sharpe")], F.count(F.lit(1)).alias("sims"), *tails)
    two = lambda name: F.least(F.lit(1.0), F.least(f"_{name}_ge", f"_{name}_le") * 2)
    return out.withColumns(
        {"p_value": two("observed"), "percentile": F.col("_observed_le") * 100, "win_rate_p": two("win_rate"), "sharpe_p": two("sharpe")}
    ).drop(*drops)


# fixed values: distribution function of a Poisson(1) count at 0..6
POISSON_CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def bootstrap_difference(df: DataFrame, x: str, row_id: str, in_a: Column, reps: int = 1_000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Interval of the difference of two means by Poisson-weighted resampling; weights come from hash words of (rep, row).

    Tasks add up all repetitions as matrix products and send one row per repetition and side. Rows without an id have no weight.
    """
    d = df.where(F.col(x).isNotNull() & F.col(row_id).isNotNull()).select(F.col(row_id).cast("string").alias("_id"), F.col(x).cast("double").alias("_x"), F.coalesce(in_a, F.lit(False)).alias("_a"))
    cuts = [np.uint32(math.ceil(c * 2**32)) for c in POISSON_CUTS]  # word / 2**32 >= c

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, reps))
        for batch in batches:
            v, a = batch.column("_x").to_numpy(), np.array(batch.column("_a").to_pylist(), bool)
            sides = np.stack([np.where(a, v, 0), a, np.where(a, 0, v), ~a])
            for at, numbers, drawn in draws(batch.column("_id").to_pylist(), reps):
                weights = sum((drawn >= cut).view(np.uint8) for cut in cuts)
                sums[:, numbers] += sides[:, at] @ weights.T.astype(float)
        yield pa.RecordBatch.from_pydict({"rep": pa.array(np.arange(reps), pa.int32()), **{n: pa.array(s) for n, s in zip(("va", "wa", "vb", "wb"), sums)}})

    per_task = d.repartition(_draw_tasks(d), "_id").mapInArrow(add_up, "rep int, va double, wa double, vb double, wb double")
    sums = per_task.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("va", "wa", "vb", "wb")])
    sums = sums.withColumn("_d", div("va", "wa") - div("vb", "wb"))
    # ``reps`` rows are left, so the built-in percentile is enough
    return sums.agg(
        F.count(F.lit(1)).alias("reps"), F.avg("_d").alias("mean_difference"),
        F.percentile("_d", F.lit(low)).alias("low"), F.percentile("_d", F.lit(high)).alias("high"),
    )


def cross_asset_consistency(trades: DataFrame, ret: str = "pnl_pct", key: str = "symbol") -> DataFrame:
    """Spread of per-symbol means and win rates: mean, deviation, CV, share positive."""
    per = trades.groupBy(key).agg(F.avg(ret).alias("_m"), F.avg((F.col(ret) > 0).cast("double")).alias("_w"))
    d = per.agg(
        F.count(F.lit(1)).alias("symbols"), F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("std"),
        F.avg("_w").alias("win_rate"), F.stddev_samp("_w").alias("win_rate_std"), F.avg((F.col("_m") > 0).cast("double")).alias("positive_share"),
    )
    return d.withColumns({"cv": div("std", F.abs("mean")), "win_rate_cv": div("win_rate_std", "win_rate")})


def friedman(per_block: DataFrame, x: str, block: str, treatment: str = "symbol") -> DataFrame:
    """Friedman statistic over complete blocks: ranks of the treatments inside each block (one row per pair)."""
    k = per_block.agg(F.count_distinct(treatment).alias("_k"))
    w = Window.partitionBy(block)
    tied = Window.partitionBy(block, x)
    rank = F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(tied) - 1) / 2
    d = per_block.withColumns({"_r": rank, "_c": F.count(F.lit(1)).over(w)}).join(F.broadcast(k)).where(F.col("_c") == F.col("_k"))
    per = d.groupBy(treatment).agg(F.sum("_r").alias("_R"), F.count(F.lit(1)).alias("_b"), F.max("_k").alias("_k"))
    out = per.agg(F.max("_b").alias("blocks"), F.max("_k").alias("treatments"), F.sum(F.col("_R") * F.col("_R")).alias("_q"))
    n, t = F.col("blocks"), F.col("treatments")
    return out.withColumn("statistic", F.col("_q") * 12 / (n * t * (t + 1)) - n * 3 * (t + 1)).drop("_q")


def split_decay(df: DataFrame, ret: str = "pnl_pct", keys: Sequence[str] = ()) -> DataFrame:
    """Win rate and Sharpe on train, validation and test rows, their drops, and a level."""

    def part(name, agg):
        return agg(F.when(F.col("split") == name, F.col(ret)))

    cols = []
    for s in ("train", "validation", "test"):
        cols += [
            part(s, lambda c: F.avg((c > 0).cast("double"))).alias(f"{s}_win_rate"),
            (part(s, F.avg) / part(s, F.stddev_samp)).alias(f"{s}_sharpe"),
        ]
    d = df.groupBy(*keys).agg(*cols)
    drop = F.col("train_win_rate") - F.col("test_win_rate")
    sharpe_drop = F.col("train_sharpe") - F.col("test_sharpe")
    level = F.when((drop > 0.15) | (sharpe_drop > 0.5), "severe").when((drop > 0.05) | (sharpe_drop > 0.2), "moderate").otherwise("ok")
    return d.withColumns({"win_rate_drop": drop, "sharpe_drop": sharpe_drop, "level": level})


def param_grid(df: DataFrame, grid: dict[str, Sequence[float]]) -> DataFrame:
    """List every row once per parameter combination; the grid is a fixed list given by the caller."""
    for name, values in grid.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return df


def threshold_scan(df: DataFrame, score: str, ret: str, cuts: Sequence[float], keys: Sequence[str] = (), min_signals: int = 10) -> DataFrame:
    """Figures of the rows at or above each cut; score = 0.4 win rate + 0.4 Sharpe + 0.2 if the mean is positive.

    Rows are first added up between neighbouring cuts, so the data is not copied per cut; the
    running totals from the top are taken over that small table.
    """
    cuts = sorted(float(c) for c in cuts)
    level = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(score)))
    r = F.col(ret)
    g = df.withColumn("_k", level).where(F.col("_k") > 0).groupBy(*keys, "_k").agg(
        F.count(F.lit(1)).alias("_n"), F.sum((r > 0).cast("int")).alias("_w"), F.sum(r).alias("_s"), F.sum(r * r).alias("_q")
    )
    cut_rows = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(c).alias("cut")) for i, c in enumerate(cuts)]))
    d = g.withColumn("_c", cut_rows).where(F.col("_k") >= F.col("_c.i")).groupBy(*keys, F.col("_c.cut").alias("cut")).agg(
        F.sum("_n").alias("signals"), F.sum("_w").alias("_w"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q")
    )
    n = F.col("signals")
    mean = F.col("_s") / n
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / n - mean * mean))
    d = d.where(n >= min_signals).withColumns({"win_rate": F.col("_w") / n, "mean": mean, "sharpe": mean / F.when(std > 0, std)})
    value = F.col("win_rate") * 0.4 + F.coalesce("sharpe", F.lit(0.0)) * 0.4 + F.when(F.col("mean") > 0, 0.2).otherwise(0.0)
    return d.withColumn("score", value).drop("_w", "_s", "_q")


def best_threshold(scan: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The cut with the best score per key, the lowest of equal ones."""
    pick = F.max_by(F.struct("cut", "signals", "score"), F.struct(F.round("score", 9), -F.col("cut")))
    return scan.groupBy(*keys).agg(pick.alias("_p")).select(*keys, "_p.*")


def rank_auc(df: DataFrame, score: Column, label: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from rank sums, ties counted half."""
    c = ordered_counts(df, score, keys, {"pos": label.cast("int"), "neg": (1 - label.cast("int"))})
    part = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    d = c.groupBy(*keys).agg(F.sum(part).alias("_u"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return d.withColumn("auc", div("_u", F.col("positives").cast("double") * F.col("negatives"))).drop("_u")


def classifier_metrics(df: DataFrame, score: str, label: str, cut: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """AUC, log loss, accuracy, precision, recall, F1 at a cut."""
    p = F.greatest(F.lit(1e-15), F.least(F.col(score), F.lit(1 - 1e-15)))
    y = F.col(label)
    hit = F.col(score) >= cut
    d = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(-(F.log(p) * y + F.log(1 - p) * (1 - y))).alias("log_loss"),
        F.sum((hit & (y == 1)).cast("int")).alias("tp"), F.sum((hit & (y == 0)).cast("int")).alias("fp"),
        F.sum((~hit & (y == 1)).cast("int")).alias("fn"), F.sum((~hit & (y == 0)).cast("int")).alias("tn"),
    )
    d = d.withColumns(
        {
            "accuracy": (F.col("tp") + F.col("tn")) / F.col("n"),
            "precision": div("tp", F.col("tp") + F.col("fp")),
            "recall": div("tp", F.col("tp") + F.col("fn")),
            "f1": div(F.col("tp") * 2.0, F.col("tp") * 2 + F.col("fp") + F.col("fn")),
        }
    )
    return join_stats(d, rank_auc(df, F.col(score), y == 1, keys).drop("positives", "negatives"), keys)


def anova_f(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """F statistic of each column between label groups, and its variance."""
    d = long_form(df, cols, [label]).where(F.col("value").isNotNull())
    g = d.groupBy("feature", label).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    t = g.groupBy("feature").agg(
        F.sum("n").alias("_N"), F.count(F.lit(1)).alias("_k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_gm"),
        F.sum(F.col("n") * F.col("v")).alias("_ssw"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_q"),
    )
    ssb = F.col("_q") - F.col("_N") * F.col("_gm") * F.col("_gm")
    f = div(ssb / (F.col("_k") - 1), F.col("_ssw") / (F.col("_N") - F.col("_k")))
    return t.withColumns({"f": f, "variance": (F.col("_ssw") + ssb) / (F.col("_N") - 1)}).select("feature", "f", "variance")


def ab_test(df: DataFrame, x: str, treated: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Effect, pooled deviation, 95 % interval, p, Cohen d, and the Mann-Whitney U with its normal p."""
    a, b = F.when(treated, F.col(x)), F.when(~treated, F.col(x))
    d = df.groupBy(*keys).agg(
        F.count(a).alias("n_t"), F.count(b).alias("n_c"), F.avg(a).alias("mean_t"), F.avg(b).alias("mean_c"),
        F.var_samp(a).alias("_vt"), F.var_samp(b).alias("_vc"),
    )
    nt, nc = F.col("n_t"), F.col("n_c")
    pooled = F.sqrt(((nt - 1) * F.col("_vt") + (nc - 1) * F.col("_vc")) / (nt + nc - 2))
    se = pooled * F.sqrt(F.lit(1.0) / nt + F.lit(1.0) / nc)
    d = d.withColumns({"effect": F.col("mean_t") - F.col("mean_c"), "_p": pooled, "_se": se})
    d = d.withColumns(
        {
            "ci_low": F.col("effect") - F.col("_se") * 1.959963984540054,
            "ci_high": F.col("effect") + F.col("_se") * 1.959963984540054,
            "z": div("effect", "_se"),
            "cohen_d": div("effect", "_p"),
        }
    )
    d = d.withColumn("p_value", two_sided_p("z"))
    c = ordered_counts(df, F.col(x), keys, {"t": treated.cast("int"), "c": (~treated).cast("int")})
    u = c.groupBy(*keys).agg(F.sum(F.col("t") * (F.col("c_before") + F.col("c") / 2)).alias("u"))
    d = join_stats(d, u, keys)
    nn = F.col("n_t").cast("double") * F.col("n_c")
    zu = (F.col("u") - nn / 2) / F.sqrt(nn * (F.col("n_t") + F.col("n_c") + 1) / 12)
    return d.withColumn("u_p_value", 1 - normal_cdf(zu)).drop("_vt", "_vc", "_p", "_se")


def performance_drift(baseline: DataFrame, current: DataFrame, metrics: dict[str, Column], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Change of each metric in percent of its baseline, with a severity, in long form."""
    a = baseline.groupBy(*keys).agg(*[v.alias(k) for k, v in metrics.items()])
    b = current.groupBy(*keys).agg(*[v.alias(k) for k, v in metrics.items()])
    la = long_form(a, list(metrics), keys).withColumnRenamed("value", "baseline")
    lb = long_form(b, list(metrics), keys).withColumnRenamed("value", "current")
    d = la.join(lb, [*keys, "feature"])
    change = div((F.col("current") - F.col("baseline")) * 100, F.abs("baseline"))
    return d.withColumn("change_pct", change).withColumn(
        "severity", ladder(F.abs("change_pct"), [(50.0, "critical"), (25.0, "high"), (10.0, "medium")], "low")
    )


def suppress_recent(signals: DataFrame, history: DataFrame, hours: float, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Signals without an earlier one in ``history`` of the same key within the last hours."""
    from tidemark.operators.temporal_joins import asof_join

    d = asof_join(signals, history.select(*keys, F.col(ts).alias("_hts")), [], keys, ts, "_hts", strict=True, keep_ts="_last", chunk_seconds=None)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_last").cast("timestamp"))) / 3.6e9
    return d.where(F.col("_last").isNull() | (gap >= hours)).drop("_last")


def daily_limit(signals: DataFrame, limit: int, order: Sequence[Column], ts: str = "ts") -> DataFrame:
    """The first ``limit`` signals of each day; ranks are cut per task before the shuffle."""
    w = Window.partitionBy(F.to_date(ts)).orderBy(*order)
    return signals.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def selection_bias(trades: DataFrame, ret: str = "pnl_pct", key: str = "symbol") -> DataFrame:
    """Skew of per-symbol profit and win rate (population), share positive, CV, and a capped score."""
    per = trades.groupBy(key).agg(F.sum(ret).alias("_p"), F.avg((F.col(ret) > 0).cast("double")).alias("_w"))
    d = per.agg(
        F.count(F.lit(1)).alias("symbols"), F.skewness("_p").alias("pnl_skew"), F.skewness("_w").alias("win_rate_skew"),
        F.avg((F.col("_p") > 0).cast("double")).alias("positive_share"), div(F.stddev_pop("_p"), F.abs(F.avg("_p"))).alias("cv"),
    )
    points = (
        F.when(F.abs("pnl_skew") > 1, 0.3).otherwise(0.0)
        + F.when(F.abs("win_rate_skew") > 1, 0.2).otherwise(0.0)
        + F.when((F.col("positive_share") > 0.8) | (F.col("positive_share") < 0.2), 0.3).otherwise(0.0)
        + F.when(F.col("cv") > 1, 0.2).otherwise(0.0)
    )
    return d.withColumn("score", F.least(F.lit(1.0), points))


def parameter_boundary(history: DataFrame, param: str = "param", value: str = "value", perf: str = "perf") -> DataFrame:
    """Is the best value tried at the edge of its range; spread of the values relative to their mean."""
    d = history.groupBy(param).agg(
        F.max_by(value, F.struct(perf, value)).alias("best"), F.min(value).alias("low"), F.max(value).alias("high"),
        div(F.stddev_samp(value), F.abs(F.avg(value))).alias("cv"), F.corr(value, perf).alias("corr_perf"),
    )
    return d.withColumn("at_edge", (F.col("best") == F.col("low")) | (F.col("best") == F.col("high")))


def two_proportions(trades: DataFrame, in_a: Column, ret: str = "pnl_pct", min_trades: int = 10) -> DataFrame:
    """Win-rate difference of two sets: pooled z and p; null when a set has too few trades."""
    r = F.col(ret)
    d = trades.agg(
        F.count(F.when(in_a, r)).alias("n_a"), F.count(F.when(~in_a, r)).alias("n_b"),
        F.avg(F.when(in_a, (r > 0).cast("double"))).alias("win_a"), F.avg(F.when(~in_a, (r > 0).cast("double"))).alias("win_b"),
    )
    pool = (F.col("win_a") * F.col("n_a") + F.col("win_b") * F.col("n_b")) / (F.col("n_a") + F.col("n_b"))
    se = F.sqrt(pool * (1 - pool) * (F.lit(1.0) / F.col("n_a") + F.lit(1.0) / F.col("n_b")))
    z = F.when((F.col("n_a") > min_trades) & (F.col("n_b") > min_trades), div(F.col("win_a") - F.col("win_b"), se))
    return d.withColumn("z", z).withColumn("p_value", two_sided_p("z"))
