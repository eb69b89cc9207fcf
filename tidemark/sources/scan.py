"""Reading and writing tables: bars, trades, JSON records, snapshots."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.core import all_of

BARS_SCHEMA = "ts TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"


def as_ts(value: str | dt.datetime) -> Column:
    """A bound time literal; compares with both timestamp types without a cast on the column."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def scan(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    symbols: Sequence[str] | None = None,
    equals: dict[str, object] | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Column list, inclusive time range, symbol list and equality filters; all reach the Parquet scan."""
    if start is not None:
        df = df.where(F.col(ts) >= as_ts(start))
    if end is not None:
        df = df.where(F.col(ts) <= as_ts(end))
    if symbols is not None:
        df = df.where(F.col("symbol").isin(list(symbols)))
    for name, value in (equals or {}).items():
        df = df.where(F.col(name) == F.lit(value))
    return df.select(*columns) if columns else df


def read_bars(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """Bars below ``root`` with symbol and timeframe as partition folders; no schema inference for CSV."""
    reader = spark.read.schema(BARS_SCHEMA + ", symbol STRING, timeframe STRING")
    return reader.csv(root, header=True) if fmt == "csv" else reader.parquet(root)


def read_trades_csv(spark: SparkSession, path: str, schema: str, ts_cols: Sequence[str]) -> DataFrame:
    """Trade or signal CSV; time columns are read as text and parsed, bad ones become null."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in ts_cols})


def read_json_records(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=multiline)


def spread(df: DataFrame, by: Sequence[str], salt: Sequence[str], files: int | None, rows_per_file: int) -> DataFrame:
    """Repartition by ``by`` and a salt ``_file``, with ``files`` salts or as many as the rows of the key need."""
    if files is None:
        counts = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
        same = [F.col(f"_k{i}").eqNullSafe(F.col(c)) for i, c in enumerate(by)]
        counts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_files")
        df = df.join(counts, all_of(same), "left").drop(*[f"_k{i}" for i in range(len(by))])
    else:
        df = df.withColumn("_files", F.lit(files))
    return df.withColumn("_file", F.pmod(F.xxhash64(*salt), F.col("_files"))).drop("_files").repartition(*by, "_file")


def write_partitioned(
    df: DataFrame,
    path: str,
    by: Sequence[str] = ("symbol", "date"),
    order: str = "ts",
    files_per_partition: int | None = None,
    compression: str = "zstd",
    mode: str = "append",
    rows_per_file: int = 5_000_000,
) -> None:
    """Parquet below one folder per partition value, rows sorted in each file.

    A folder is spread over as many tasks and files as its rows need, counted
    first; ``files_per_partition`` sets the same number for all instead.
    """
    if "date" in by and "date" not in df.columns:
        df = df.withColumn("date", F.to_date(order))
    out = spread(df, by, df.columns, files_per_partition, rows_per_file).sortWithinPartitions(*by, order).drop("_file")
    out.write.mode(mode).partitionBy(*by).option("compression", compression).parquet(path)


def write_feature_set(df: DataFrame, path: str, name: str, as_of: str) -> None:
    """Feature table as Parquet plus one metadata record as JSON beside it."""
    write_partitioned(df, f"{path}/data", ("symbol",), mode="overwrite")
    stored = df.sparkSession.read.parquet(f"{path}/data")
    meta = stored.agg(
        F.lit(name).alias("name"),
        F.lit(as_of).alias("as_of"),
        F.count(F.lit(1)).alias("rows"),
        F.min("ts").cast("string").alias("first_ts"),
        F.max("ts").cast("string").alias("last_ts"),
        F.lit(len(df.columns)).alias("columns"),
    )
    meta.write.mode("overwrite").json(f"{path}/metadata")


def content_hash(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Row count and an order-independent hash of the rows, per key or for the whole table.

    A row is hashed as its columns in name order, each as its length and text,
    or as ``n`` if null, so that (1, null) and (null, 1) differ.
    """
    texts = [F.col(c).cast("string") for c in sorted(df.columns)]
    parts = [F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("n")) for t in texts]
    row = F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(row).alias("content_hash"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys labelled added, removed, changed or same between two snapshots; null equals null."""
    rest = sorted(c for c in old.columns if c not in keys)
    a = old.select(*keys, F.struct(F.lit(True).alias("_here"), *rest).alias("_a"))
    b = new.select(*keys, F.struct(F.lit(True).alias("_here"), *rest).alias("_b"))
    status = (
        F.when(F.col("_a").isNull(), "added")
        .when(F.col("_b").isNull(), "removed")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "same")
        .otherwise("changed")
    )
    return a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"))


def retention_keep(df: DataFrame, cutoff: str, resolved: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows to keep: those at or after the cutoff, and unresolved ones of any age if a flag is named."""
    keep = F.col(ts) >= as_ts(cutoff)
    if resolved:
        keep = keep | ~F.coalesce(F.col(resolved), F.lit(False))
    return df.where(keep)
