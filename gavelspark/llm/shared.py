"""What several operators of this package need from the session and from tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one named by spark.checkpoint.dir, which all executors see.

    Only a local session may leave that setting out; its folder is temporary.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="gavelspark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/work-{uuid.uuid4().hex}"


@contextmanager
def shuffle_files_end_with_their_query(spark: SparkSession) -> Iterator[None]:
    """Queries begun here remove their shuffle files when they end, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """The rows from a table in the shared folder: computed once, and not lost with an executor."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    with shuffle_files_end_with_their_query(spark):
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def by_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str | T.StructType,
) -> DataFrame:
    """`work` on pieces of bounded text size; a column named text must be there."""
    from gavelspark.llm.words import pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                made = work(piece)
                yield from made.to_batches() if isinstance(made, pa.Table) else [made]

    return df.mapInArrow(run, schema)


def crc_bucket(key: Column, buckets: int) -> Column:
    """crc32 of the key as text, modulo buckets; null keys count as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(buckets))


def sampled(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, chosen by a hash of the key: the same rows on each run."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)
