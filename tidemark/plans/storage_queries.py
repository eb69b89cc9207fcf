"""Writers and readers: each query writes derived data to the scratch folder and reads it back."""

from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.plans.report_queries import rounded
from tidemark.plans.window_queries import b1
from tidemark.sources import scan as S
from tidemark.sources import serving
from tidemark.sources.standins import bars, table
from tidemark.streaming.run import fresh_path, run_available


@query(
    "write_partitioned_parquet",
    """SELECT symbol, date, count(*) AS rows, round(sum(close),6) AS total FROM (SELECT symbol, CAST(ts AS DATE) AS date, close FROM bars)
       WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-08' AND symbol IN ('view','click') GROUP BY 1,2""",
)
def _(spark, sf):
    path = fresh_path(spark)
    S.write_partitioned(bars(spark, sf), path, files_per_partition=2)
    d = spark.read.parquet(path).where(F.col("symbol").isin("view", "click") & F.col("date").between("2024-01-05", "2024-01-08"))
    return rounded(d.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("rows"), F.sum("close").alias("total")))


@query(
    "scan_trades_csv",
    """SELECT o_orderkey AS order_id, o_orderdate AS open_date, round(o_totalprice,2) AS price, o_orderstatus AS status FROM orders""",
)
def _(spark, sf):
    path = fresh_path(spark)
    o = table(spark, sf, "orders")
    o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("d"), "o_totalprice", "o_orderstatus").write.csv(path, header=True)
    d = S.read_trades_csv(spark, path, "order_id BIGINT, open_date STRING, price DOUBLE, status STRING", ["open_date"])
    return rounded(d.withColumn("open_date", F.col("open_date").cast("timestamp_ntz")), 2)


@query(
    "write_feature_set",
    """SELECT 'bars' AS name, count(*) AS rows, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS last_ts, 3::BIGINT AS columns FROM bars""",
)
def _(spark, sf):
    path = fresh_path(spark)
    S.write_feature_set(b1(spark, sf), path, "bars", "2024-02-01")
    schema = "name STRING, as_of STRING, rows BIGINT, first_ts STRING, last_ts STRING, columns BIGINT"
    return S.read_json_records(spark, f"{path}/metadata", schema).drop("as_of")


@query(
    "sink_batch_insert",
    """SELECT event_type AS symbol, count(*) AS fills, sum(CAST(json_extract_string(props,'$.k') AS INT))::DOUBLE AS quantity, round(sum(value),6) AS price FROM events GROUP BY 1""",
)
def _(spark, sf):
    from tidemark.plans.stream_queries import event_stream

    root = fresh_path(spark)
    s = event_stream(spark, sf).select(
        F.col("event_id").cast("string").alias("fill_id"), F.col("event_type").alias("symbol"),
        F.get_json_object("props", "$.k").alias("quantity"), F.col("value").alias("price"), F.col("ts").alias("timestamp"),
    )
    run_available(s, "append", serving.batch_sink("fills", root), root)
    d = spark.read.parquet(f"{root}/fills").groupBy("symbol")
    return rounded(d.agg(F.count(F.lit(1)).alias("fills"), F.sum("quantity").cast("double").alias("quantity"), F.sum("price").cast("double").alias("price")))


@query(
    "serving_tables_ddl",
    """SELECT strftime(o_orderdate,'%Y-%m') AS month, count(*) AS orders, round(sum(o_totalprice),2) AS value FROM orders GROUP BY 1""",
)
def _(spark, sf):
    root = fresh_path(spark)
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("create_time"),
    )
    for _ in range(2):  # a load that runs twice leaves its rows once
        serving.append(o, "orders", root, "first", rows_per_file=1000)
    d = spark.read.parquet(f"{root}/orders").groupBy(F.col("month").cast("string").alias("month"))
    return rounded(d.agg(F.count(F.lit(1)).alias("orders"), F.sum("price").cast("double").alias("value")), 2)


@query(
    "retention_drop_months",
    """SELECT strftime(o_orderdate,'%Y-%m') AS month, count(*) AS orders FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01' GROUP BY 1""",
)
def _(spark, sf):
    root = fresh_path(spark)
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("create_time")
    )
    serving.append(o, "orders", root, "first")
    serving.drop_expired(spark, root, "orders", "1997-06-15")
    d = spark.read.parquet(f"{root}/orders").groupBy(F.col("month").cast("string").alias("month"))
    return d.agg(F.count(F.lit(1)).alias("orders"))
