"""Running streams over what is there, and their progress as a table."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.session import scratch_dir


PROGRESS = "query_id STRING, batch_id BIGINT, at STRING, input_rows BIGINT, rows_per_second DOUBLE, late_rows BIGINT"
TOPIC_STATS = "topic STRING, processed BIGINT, errors BIGINT, lag BIGINT"


def fresh_path(spark: SparkSession) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None, path: str | None = None) -> tuple[str, StreamingQuery]:
    """Process all available input and stop. Writes Parquet below the path returned, or calls ``sink`` per batch."""
    spark = stream.sparkSession
    path = path or fresh_path(spark)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True)
    if sink is not None:
        q = writer.foreachBatch(sink).start()
    else:
        q = writer.format("parquet").start(f"{path}/data")
    q.awaitTermination()
    return path, q


def _progress_row(p: dict) -> tuple:
    late = sum(int(o.get("numRowsDroppedByWatermark", 0)) for o in p.get("stateOperators", []))
    return str(p["id"]), int(p["batchId"]), str(p["timestamp"]), int(p["numInputRows"]), float(p.get("processedRowsPerSecond") or 0.0), late


class ProgressLog(StreamingQueryListener):
    """Keeps the progress of every finished batch, however many there are; ``table`` gives its figures as a DataFrame."""

    def __init__(self):
        self.batches: list[dict] = []
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches.append(json.loads(event.progress.json))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([_progress_row(p) for p in self.batches], PROGRESS)


def run_logged(stream: DataFrame, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None, path: str | None = None, wait: float = 60.0) -> tuple[str, ProgressLog]:
    """``run_available`` with the log of all its batches."""
    log, streams = ProgressLog(), stream.sparkSession.streams
    streams.addListener(log)
    try:
        path, query = run_available(stream, mode, sink, path)
        until = time.monotonic() + wait
        while str(query.runId) not in log.ended:  # events come after the query has ended
            if time.monotonic() > until:
                raise TimeoutError("the query's last events did not come")
            time.sleep(0.05)
    finally:
        streams.removeListener(log)
    return path, log


def counted(events: DataFrame, topics: Sequence[str], bad: str = "bad", topic: str = "topic") -> DataFrame:
    """``events`` with its rows and bad rows by topic among the observed metrics of each batch; ``bad`` is a condition."""
    found = []
    for k, name in enumerate(topics):
        here = F.col(topic) == name
        found += [F.count(F.when(here, 1)).alias(f"rows_{k}"), F.count(F.when(here & F.expr(bad), 1)).alias(f"bad_{k}")]
    return events.observe("topics", *found)


def _offsets(told) -> dict[str, dict[str, int]]:
    """Offsets by topic and partition; sources without topics have none."""
    told = json.loads(told) if isinstance(told, str) else told
    return {t: p for t, p in (told or {}).items() if isinstance(p, dict)}


def topic_stats(spark: SparkSession, batches: Iterable[dict], topics: Sequence[str]) -> DataFrame:
    """Per topic: rows processed, bad rows, and how far the last batch was behind the newest offsets.

    ``batches``: progress in order, of a stream through ``counted``. Lag sums the partitions, each at
    least 0; it is null where the source reports no offsets by topic. A topic without rows shows with zeros.
    """
    done = {t: [0, 0] for t in topics}
    lag: dict[str, int] = {}
    for p in batches:
        seen = (p.get("observedMetrics") or {}).get("topics") or {}
        for k, t in enumerate(topics):
            done[t][0] += int(seen.get(f"rows_{k}") or 0)
            done[t][1] += int(seen.get(f"bad_{k}") or 0)
        now: dict[str, int] = {}
        for source in p.get("sources", []):
            newest = _offsets(source.get("latestOffset"))
            for t, at in _offsets(source.get("endOffset")).items():
                ahead = newest.get(t, {})
                now[t] = now.get(t, 0) + sum(max(0, int(ahead.get(part, o)) - int(o)) for part, o in at.items())
        lag |= now
    return spark.createDataFrame([(t, n, bad, lag.get(t)) for t, (n, bad) in done.items()], TOPIC_STATS)


def progress_table(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """The batches that Spark still remembers of a running query; ``run_logged`` keeps all of them."""
    return spark.createDataFrame([_progress_row(p if isinstance(p, dict) else json.loads(p.json)) for p in query.recentProgress], PROGRESS)
