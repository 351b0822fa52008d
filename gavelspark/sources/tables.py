"""The auction tables: schemas, and how they are stored and read."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gavelspark.operators import reads

MONEY = T.DecimalType(10, 2)
_WHEN = T.TimestampNTZType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "categories": _table(id=T.LongType(), name=T.StringType(), description=T.StringType(), created_at=_WHEN),
    "users": _table(
        id=T.LongType(), username=T.StringType(), email=T.StringType(), password_hash=T.StringType(),
        full_name=T.StringType(), phone=T.StringType(), address=T.StringType(), role=T.StringType(),
        is_active=T.BooleanType(), created_at=_WHEN, updated_at=_WHEN,
    ),
    "auction_items": _table(
        id=T.LongType(), seller_id=T.LongType(), category_id=T.LongType(), title=T.StringType(),
        description=T.StringType(), image_url=T.StringType(), starting_price=MONEY, reserve_price=MONEY,
        current_price=MONEY, buy_now_price=MONEY, start_time=_WHEN, end_time=_WHEN, status=T.StringType(),
        winner_id=T.LongType(), total_bids=T.IntegerType(), created_at=_WHEN, updated_at=_WHEN,
    ),
    "bids": _table(
        id=T.LongType(), auction_id=T.LongType(), bidder_id=T.LongType(), amount=MONEY,
        is_winning=T.BooleanType(), created_at=_WHEN,
    ),
    "watchlist": _table(id=T.LongType(), user_id=T.LongType(), auction_id=T.LongType(), created_at=_WHEN),
    "notifications": _table(
        id=T.LongType(), user_id=T.LongType(), auction_id=T.LongType(), type=T.StringType(),
        message=T.StringType(), is_read=T.BooleanType(), created_at=_WHEN,
    ),
    "auto_bids": _table(
        id=T.LongType(), auction_id=T.LongType(), user_id=T.LongType(), max_amount=MONEY,
        is_active=T.BooleanType(), created_at=_WHEN,
    ),
}

# Reports filter auctions by status, so its files are pruned by folder. The logs are read by
# auction or by user: sorting within files keeps the row-group statistics of that key narrow.
_FOLDERS = {"auction_items": ["status"]}
_ORDER_IN_FILE = {
    "bids": ["auction_id", "created_at", "id"],
    "auto_bids": ["auction_id", "user_id"],
    "watchlist": ["user_id", "auction_id"],
    "notifications": ["user_id", "created_at"],
    "auction_items": ["status", "end_time"],
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored auction table, read with its declared schema (no inference pass over files)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def write_table(rows: DataFrame, root: str, name: str, mode: str = "errorifexists") -> None:
    """Store a snapshot. A new snapshot is a new folder: `mode` refuses to overwrite by default."""
    wanted = [c for c in SCHEMAS[name].fieldNames() if c in rows.columns]
    out = rows.select(*wanted)
    keys = _ORDER_IN_FILE.get(name)
    if keys:
        # A range split on the full key spreads one hot auction or user over many files.
        out = out.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = out.write.mode(mode)
    if name in _FOLDERS:
        writer = writer.partitionBy(*_FOLDERS[name])
    writer.parquet(f"{root}/{name}")


def read_jdbc(
    spark: SparkSession, url: str, name: str, *, key: str = "id", lower: int, upper: int,
    partitions: int, properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A table of an operational database, read in `partitions` parallel key ranges."""
    return spark.read.jdbc(
        url, name, column=key, lowerBound=lower, upperBound=upper, numPartitions=partitions,
        properties=dict(properties or {}),
    )


def register_views(users: DataFrame, categories: DataFrame, auctions: DataFrame, bids: DataFrame) -> None:
    """The base tables and the three reporting views, for use from `spark.sql`."""
    users.createOrReplaceTempView("users")
    categories.createOrReplaceTempView("categories")
    auctions.createOrReplaceTempView("auction_items")
    bids.createOrReplaceTempView("bids")
    reads.active_listing(auctions, users, categories).createOrReplaceTempView("v_active_auctions")
    reads.bid_history(bids, users, auctions).createOrReplaceTempView("v_bid_history")
    reads.bidder_ranking(users, bids).createOrReplaceTempView("v_top_bidders")
