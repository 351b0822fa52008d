"""Session settings the operators are written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Naive timestamps are compared as UTC instants, so the zone is part of the contract.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "gavelspark", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; `extra` takes dotted keys through a dict unpack."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Only a local session may leave it unset; its own is temporary."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="gavelspark-"))
    return (configured or context.getCheckpointDir()).rstrip("/")


def keep_state_on_disk(spark: SparkSession) -> None:
    """Streams with state of their own need the RocksDB store; it is chosen when a query starts."""
    spark.conf.set(_STATE_STORE, _ROCKSDB)
