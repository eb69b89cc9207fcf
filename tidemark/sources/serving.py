"""Serving tables as partitioned Parquet: definitions, typed appends, retention."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.scan import spread


@dataclass(frozen=True)
class ServingTable:
    columns: str
    partition: tuple[str, ...]  # beside the month of ``time``
    sort: tuple[str, ...]
    keep_months: int
    time: str = "timestamp"
    version: str | None = None  # newest row per sort key wins


# fixed values: serving table columns, partition and sort keys, months kept
TABLES: dict[str, ServingTable] = {
    "exec_reports": ServingTable(
        """event_id STRING, timestamp TIMESTAMP, strategy_id STRING, account_id STRING,
        total_realized_pnl DECIMAL(38,8), total_unrealized_pnl DECIMAL(38,8), total_commission DECIMAL(38,8),
        total_cost DECIMAL(38,8), slippage DECIMAL(38,8), market_impact DECIMAL(38,8), execution_time_ms BIGINT,
        venue STRING, order_count INT, fill_count INT, metadata STRING""",
        (), ("timestamp", "strategy_id", "account_id"), 12,
    ),
    "fills": ServingTable(
        """fill_id STRING, trade_id STRING, order_id STRING, symbol STRING, side STRING, quantity DECIMAL(38,8),
        price DECIMAL(38,8), commission DECIMAL(38,8), commission_asset STRING, timestamp TIMESTAMP,
        strategy_id STRING, account_id STRING, venue STRING""",
        ("symbol",), ("timestamp", "symbol", "fill_id"), 12,
    ),
    "orders": ServingTable(
        """order_id STRING, client_order_id STRING, symbol STRING, side STRING, type STRING, quantity DECIMAL(38,8),
        price DECIMAL(38,8), stop_price DECIMAL(38,8), status STRING, filled_quantity DECIMAL(38,8),
        remaining_quantity DECIMAL(38,8), create_time TIMESTAMP, update_time TIMESTAMP, strategy_id STRING,
        account_id STRING, venue STRING""",
        ("symbol",), ("create_time", "symbol", "order_id"), 12, "create_time", "update_time",
    ),
    "positions": ServingTable(
        """symbol STRING, quantity DECIMAL(38,8), avg_price DECIMAL(38,8), market_value DECIMAL(38,8),
        unrealized_pnl DECIMAL(38,8), realized_pnl DECIMAL(38,8), side STRING, timestamp TIMESTAMP,
        strategy_id STRING, account_id STRING, venue STRING""",
        ("symbol",), ("timestamp", "symbol", "strategy_id"), 6, version="timestamp",
    ),
    "risk_metrics": ServingTable(
        """event_id STRING, timestamp TIMESTAMP, strategy_id STRING, account_id STRING, total_exposure DECIMAL(38,8),
        max_position_size DECIMAL(38,8), var_1d DECIMAL(38,8), var_5d DECIMAL(38,8), max_drawdown DECIMAL(38,8),
        sharpe_ratio DECIMAL(38,4), volatility DECIMAL(38,4), daily_pnl DECIMAL(38,8), daily_loss_limit DECIMAL(38,8),
        max_positions INT, current_positions INT, risk_score DECIMAL(9,2), position_concentration STRING,
        risk_metrics_detail STRING, correlation_matrix STRING, metadata STRING""",
        (), ("timestamp", "strategy_id", "account_id"), 6,
    ),
    "alerts": ServingTable(
        """event_id STRING, alert_id STRING, timestamp TIMESTAMP, severity STRING, code STRING, title STRING,
        message STRING, source STRING, strategy_id STRING, account_id STRING, symbol STRING, auto_resolved BOOLEAN,
        resolution_action STRING, context STRING, metrics STRING, metadata STRING""",
        ("severity",), ("timestamp", "severity", "source"), 3,
    ),
    "system_health": ServingTable(
        """event_id STRING, timestamp TIMESTAMP, overall_status STRING, strategy_id STRING,
        total_cpu_usage DECIMAL(9,2), total_memory_usage DECIMAL(9,2), active_connections BIGINT, total_positions INT,
        daily_trades BIGINT, daily_pnl DECIMAL(38,8), market_data_delay_ms BIGINT, execution_delay_ms BIGINT,
        components STRING, websocket_connections STRING, metadata STRING""",
        (), ("timestamp", "strategy_id"), 1,
    ),
    "pnl_curve": ServingTable(
        """timestamp TIMESTAMP, time_bucket TIMESTAMP, interval_type STRING, strategy_id STRING, account_id STRING,
        symbol STRING, realized_pnl DECIMAL(38,8), unrealized_pnl DECIMAL(38,8), total_pnl DECIMAL(38,8),
        cumulative_pnl DECIMAL(38,8), trade_count BIGINT, commission DECIMAL(38,8), volume DECIMAL(38,8),
        drawdown DECIMAL(38,8), var_1d DECIMAL(38,8)""",
        ("interval_type",), ("time_bucket", "strategy_id", "account_id", "symbol"), 24, "time_bucket", "timestamp",
    ),
}


def create_tables(spark: SparkSession, root: str, database: str = "default") -> None:
    """Create the serving tables over ``root``, partitioned by month and the table's own keys."""
    for name, t in TABLES.items():
        parts = ", ".join(["month", *t.partition])
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} ({t.columns}, month STRING) "
            f"USING parquet PARTITIONED BY ({parts}) LOCATION '{root}/{name}'"
        )


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns with its exact types; absent ones null, maps and structs as JSON text, month added."""
    t = TABLES[table]
    schema = T._parse_datatype_string(t.columns)
    cols = []
    for f in schema.fields:
        if f.name not in df.columns:
            value = F.lit(None)
        elif isinstance(df.schema[f.name].dataType, (T.MapType, T.StructType, T.ArrayType)):
            value = F.to_json(f.name)
        else:
            value = F.col(f.name)
        cols.append(value.cast(f.dataType).alias(f.name))
    return df.select(*cols).withColumn("month", F.date_format(t.time, "yyyy-MM"))


def append(df: DataFrame, table: str, root: str, load_id: str | None = None, files_per_partition: int | None = None, rows_per_file: int = 5_000_000) -> None:
    """Typed append, sorted inside files; a hot month or symbol is spread over as many files as its rows need.

    With ``load_id`` the load owns a folder, so running it again replaces its
    rows instead of doubling them. Use it for all loads of a table or for none.
    """
    t = TABLES[table]
    by = ["month", *t.partition]
    d = spread(conform(df, table), by, t.sort, files_per_partition, rows_per_file).sortWithinPartitions(*by, *t.sort).drop("_file")
    path = f"{root}/{table}" if load_id is None else f"{root}/{table}/batch={load_id}"
    d.write.mode("append" if load_id is None else "overwrite").partitionBy(*by).option("compression", "zstd").parquet(path)


def batch_sink(table: str, root: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink of a table. Each batch owns a folder, so running it again replaces its rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        t = TABLES[table]
        d = conform(batch, table)
        d.write.mode("overwrite").partitionBy("month", *t.partition).parquet(f"{root}/{table}/batch={batch_id}")

    return write


def expired_months(spark: SparkSession, root: str, table: str, as_of: str) -> DataFrame:
    """Month partitions past the table's retention at ``as_of``, to be dropped as whole folders."""
    t = TABLES[table]
    cutoff = F.date_format(F.add_months(F.to_date(F.lit(as_of)), -t.keep_months), "yyyy-MM")
    return spark.read.parquet(f"{root}/{table}").where(F.col("month") < cutoff).select("month").distinct()


def drop_expired(spark: SparkSession, root: str, table: str, as_of: str) -> list[str]:
    """Delete the month folders past the table's retention at ``as_of``; gives the months dropped."""
    months = sorted(str(r["month"]) for r in expired_months(spark, root, table, as_of).collect())  # a few months
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for month in months:
        for below in (f"month={month}", f"batch=*/month={month}"):
            pattern = hadoop(f"{root}/{table}/{below}")
            files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
            for found in files.globStatus(pattern) or []:
                files.delete(found.getPath(), True)
    return months
