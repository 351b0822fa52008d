"""Live figures of the auctions, as streaming aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest_bids(bids: DataFrame) -> DataFrame:
    """The newest bid of each bidder on each auction."""
    bid = F.struct("id", "amount", "created_at")
    return bids.groupBy("auction_id", "bidder_id").agg(F.max(bid).alias("newest"))


def board(newest: DataFrame) -> DataFrame:
    """The board at rest: of an auction's rows the one with the newest bid is winning."""
    top = newest.groupBy("auction_id").agg(F.max("newest.id").alias("top"))
    return newest.join(top, "auction_id").select(
        "auction_id", "bidder_id", F.col("newest.id").alias("bid_id"), F.col("newest.amount").alias("amount"),
        F.col("newest.created_at").alias("bid_time"), (F.col("newest.id") == F.col("top")).alias("is_winning"),
    )


def prices(bids: DataFrame) -> DataFrame:
    """Current price and number of bids per auction."""
    return bids.groupBy("auction_id").agg(F.max("amount").alias("current_price"), F.count("*").alias("total_bids"))


def unread(notices: DataFrame) -> DataFrame:
    """Unread notices per user, of a stream of them."""
    return notices.groupBy("user_id").agg(F.count_if(~F.col("is_read")).alias("unread"))
