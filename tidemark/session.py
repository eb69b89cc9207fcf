"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator relies on (UTC, adaptive plans)."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


_written: dict[tuple[str, str], str] = {}


def materialize(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Build a table once per application, write it as Parquet in the scratch folder and read it back.

    Later calls with the same ``name`` read the written table, so a table that
    many queries derive from the same source is computed once and survives the
    loss of executors.
    """
    slot = (spark.sparkContext.applicationId, name)
    if slot not in _written:
        path = f"{scratch_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
        make().write.mode("errorifexists").parquet(path)
        _written[slot] = path
    return spark.read.parquet(_written[slot])


def forget() -> None:
    """Build all materialized tables anew at their next use, after a source has changed."""
    _written.clear()


def settle(df: DataFrame) -> DataFrame:
    """Write a costly intermediate that is read several times and go on from the written table.

    Parquet rather than a checkpoint of rows, so later reads still prune columns.
    """
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
