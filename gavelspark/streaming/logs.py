"""Stored logs as streams, and streams as stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from gavelspark.session import keep_state_on_disk, shared_dir


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for a run, where all executors see it."""
    return f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def stage(rows: DataFrame, name: str) -> str:
    """Write a derived log so that it can be read as a stream; returns its folder."""
    folder = fresh_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return folder


SLICES = 3
FILES_PER_TRIGGER = 8
PARTS_PER_CORE = 1
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def stage_in_order(rows: DataFrame, at: str, name: str, slices: int = SLICES, end: DataFrame | None = None) -> str:
    """As `stage`, one slice of time after the other: streams read files in the order in which they were written.

    The rows of `end` are a file after all others, in one micro-batch with the last slice.
    """
    folder = fresh_folder(rows.sparkSession, name)
    cuts = rows.select(F.percentile_approx(F.col(at).cast("timestamp"), [k / slices for k in range(1, slices)]).alias("cuts")).first()[0] or []
    bounds = [None, *cuts, None]
    time = F.col(at).cast("timestamp")
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = rows if low is None else rows.where(time > F.lit(low))
        part = part if high is None else part.where(time <= F.lit(high))
        files = FILES_PER_TRIGGER - (end is not None and high is None)
        part.coalesce(files).write.mode("append").parquet(folder)
    if end is not None:
        end.coalesce(1).write.mode("append").parquet(folder)
    return folder


def read_log(
    spark: SparkSession, folder: str, schema: T.StructType, bytes_per_trigger: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """A growing Parquet log. `bytes_per_trigger` or `files_per_trigger` bound a micro-batch, and with it what one key brings to a task."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.parquet(folder)


def appended(stream: DataFrame, name: str) -> str:
    """Run a stream over what is there into a Parquet table; returns its folder, which can be read as a stream too."""
    spark = stream.sparkSession
    keep_state_on_disk(spark)
    out = fresh_folder(spark, name)
    _finish(
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows"), spark, f"{out}/progress"
    )
    return f"{out}/rows"


def append_run(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there into a Parquet table, and read that table."""
    return stream.sparkSession.read.schema(stream.schema).parquet(appended(stream, name))


def update_run(stream: DataFrame, key: list[str], name: str) -> DataFrame:
    """Run an updating aggregate into a table of changed rows per batch; read the last row per key.

    A batch writes a folder of its own and replaces it when it is repeated.
    """
    spark = stream.sparkSession
    out = fresh_folder(spark, name)

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")

    _finish(stream.writeStream.outputMode("update").foreachBatch(write), spark, f"{out}/progress")
    versions = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(
        f"{out}/rows"
    )
    newest = Window.partitionBy(*key).orderBy(F.desc("batch"))
    return versions.withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth", "batch")


def state_partitions(spark: SparkSession) -> int:
    """In how many parts a run keeps its state: each costs a worker, a store and its commit in every micro-batch, so one for each core is enough."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS_PER_CORE * spark.sparkContext.defaultParallelism)


def _finish(writer: DataStreamWriter, spark: SparkSession, progress: str) -> None:
    """The query takes the settings with it when it starts; those of the session stay as they are.

    A commit stores what a micro-batch changed, not the whole state anew.
    """
    settings = {"spark.sql.shuffle.partitions": str(state_partitions(spark)), CHANGELOG: "true"}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        query = writer.option("checkpointLocation", progress).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()
