"""Event streams: sources, parsing with quarantine, fan-out, deduplication, routing by type.

Transformations take a streaming DataFrame, so Kafka, files or a test source
can feed them alike.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: topic names
TOPICS = (
    "exec.reports.v1",
    "risk.metrics.v1",
    "alerts.v1",
    "system.health.v1",
    "strategy.performance.v1",
    "trade.signals.v1",
    "position.updates.v1",
    "market.data.v1",
)

REPORT_SCHEMA = """
    event_id BIGINT, timestamp TIMESTAMP, symbol STRING, account_id STRING,
    orders ARRAY<STRUCT<order_id: STRING, side: STRING, quantity: DECIMAL(38,8)>>,
    fills ARRAY<STRUCT<fill_id: STRING, order_id: STRING, quantity: DECIMAL(38,8), price: DECIMAL(38,8)>>,
    metadata MAP<STRING, STRING>
"""


def kafka_events(spark: SparkSession, servers: str, topics: Sequence[str] = TOPICS, starting: str = "latest") -> DataFrame:
    """Raw events from Kafka: topic, value text, broker time. Needs the Kafka connector on the cluster."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", starting)
        .load()
    )
    return raw.select("topic", F.col("value").cast("string").alias("value"), F.col("timestamp").alias("broker_ts"))


def file_events(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def parse_events(raw: DataFrame, schema: str = REPORT_SCHEMA, value: str = "value") -> DataFrame:
    """Add the parsed event as ``event`` and ``bad`` = text that is no such JSON."""
    d = raw.withColumn("event", F.from_json(value, f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"}))
    return d.withColumn("bad", F.col("event").isNull() | F.col("event._corrupt").isNotNull() | F.col("event.event_id").isNull())


def good_events(parsed: DataFrame, *cols: Column | str) -> DataFrame:
    """``cols`` of the events that are not bad. A filter would be pushed below the parser and parse each text again for each of its terms."""
    return parsed.select(F.inline(F.when(~F.col("bad"), F.array(F.struct(*cols)))))


def report_orders(parsed: DataFrame) -> DataFrame:
    return parsed.select("event.event_id", "event.timestamp", "event.symbol", F.inline(F.when(~F.col("bad"), F.col("event.orders"))))


def report_fills(parsed: DataFrame) -> DataFrame:
    return parsed.select("event.event_id", "event.timestamp", "event.symbol", F.inline(F.when(~F.col("bad"), F.col("event.fills"))))


def fan_out(tables: dict[str, Callable[[DataFrame], DataFrame]], root: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends each derived table below ``root``.

    The batch is kept in memory while its tables are written: what several of them need, such as parsed events, belongs into it. Each write goes to
    its own batch folder and overwrites it, so a batch that is run again after
    a failure leaves no double rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, derive in tables.items():
                derive(batch).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def route(handlers: dict[str, Callable[[DataFrame, int], None]], kind: str = "topic", other: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands each handler the rows of its type, and ``other`` all the rest, null types too.

    Without ``other`` a batch with rows that no handler takes is an error.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, fn in handlers.items():
                fn(batch.where(F.col(kind) == name), batch_id)
            rest = batch.where(~F.coalesce(F.col(kind).isin(list(handlers)), F.lit(False)))
            if other is not None:
                other(rest, batch_id)
            elif not rest.isEmpty():
                raise ValueError(f"no handler for {[r[0] for r in rest.select(kind).distinct().limit(5).collect()]}")
        finally:
            batch.unpersist()

    return handle


def deduplicate(events: DataFrame, key: str = "event_id", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """First row of each key; keys are remembered until the watermark passes them."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
