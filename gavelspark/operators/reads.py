"""Views and the reads of the application's pages.

Where a page asks for one user or auction, the operator takes a table of keys and answers for
all of them in one pass; without one it answers for everybody.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.functions.text import contains


def _named(users: DataFrame, key: str, name: str, *more: str) -> DataFrame:
    return users.select(F.col("id").alias(key), F.col("username").alias(name), *more)


def _category(categories: DataFrame, name: str = "category_name") -> DataFrame:
    return categories.select(F.col("id").alias("category_id"), F.col("name").alias(name))


def _only(rows: DataFrame, column: str, keys: DataFrame | None) -> DataFrame:
    if keys is None:
        return rows
    return rows.join(keys.select(F.col("id").alias(column)), column, "left_semi")


def active_listing(auctions: DataFrame, users: DataFrame, categories: DataFrame) -> DataFrame:
    return (
        auctions.where(F.col("status") == "active")
        .join(_named(users, "seller_id", "seller"), "seller_id")
        .join(_category(categories, "category"), "category_id")
        .select("id", "title", "current_price", "end_time", "total_bids", "status", "seller", "category")
    )


def bid_history(bids: DataFrame, users: DataFrame, auctions: DataFrame) -> DataFrame:
    lots = auctions.select(
        F.col("id").alias("auction_id"), F.col("title").alias("auction_title"), F.col("status").alias("auction_status")
    )
    return (
        bids.join(lots, "auction_id")
        .join(_named(users, "bidder_id", "bidder"), "bidder_id")
        .select(
            F.col("id").alias("bid_id"), "amount", F.col("created_at").alias("bid_time"), "is_winning", "bidder",
            "auction_title", "auction_status",
        )
        .orderBy(F.desc("bid_time"), "bid_id")
    )


def bidder_ranking(users: DataFrame, bids: DataFrame) -> DataFrame:
    """By money bid, unlike the leaderboard by number of bids."""
    totals = bids.groupBy(F.col("bidder_id").alias("id")).agg(
        F.count("*").alias("total_bids_placed"),
        F.sum("amount").alias("total_amount_bid"),
        F.max("amount").alias("highest_single_bid"),
    )
    return (
        users.select("id", "username", "full_name").join(totals, "id").orderBy(F.desc("total_amount_bid"), "id")
    )


def catalogue(
    auctions: DataFrame, users: DataFrame, categories: DataFrame, *, status: str | None = None,
    category: int | None = None, search: str | None = None,
) -> DataFrame:
    """Newest first. An absent or empty criterion does not restrict; `search` looks at titles only."""
    if status:
        auctions = auctions.where(F.col("status") == status)
    if category is not None:
        auctions = auctions.where(F.col("category_id") == category)
    if search:
        auctions = auctions.where(contains(F.col("title"), search))
    return (
        auctions.join(_named(users, "seller_id", "seller_name"), "seller_id")
        .join(_category(categories), "category_id")
        .orderBy(F.desc("created_at"), "id")
        .select(
            "id", "title", "description", "image_url", "starting_price", "current_price", "buy_now_price",
            "start_time", "end_time", "status", "total_bids", "seller_name", "category_name",
        )
    )


def featured(auctions: DataFrame, users: DataFrame, categories: DataFrame, n: int = 6) -> DataFrame:
    return catalogue(auctions, users, categories, status="active").limit(n)


def auction_detail(
    auctions: DataFrame, users: DataFrame, categories: DataFrame, keys: DataFrame | None = None
) -> DataFrame:
    return (
        _only(auctions, "id", keys)
        .join(_named(users, "seller_id", "seller_name", F.col("email").alias("seller_email")), "seller_id")
        .join(_category(categories), "category_id")
        .join(_named(users, "winner_id", "winner_name"), "winner_id", "left")
        .select(*auctions.columns, "seller_name", "seller_email", "category_name", "winner_name")
    )


def latest_bid_per_bidder(bids: DataFrame, users: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The newest bid (highest id) of each bidder on each auction, highest amount first."""
    newest = Window.partitionBy("auction_id", "bidder_id").orderBy(F.desc("id"))
    return (
        _only(bids, "auction_id", keys)
        .withColumn("nth", F.row_number().over(newest))
        .where(F.col("nth") == 1)
        .join(_named(users, "bidder_id", "bidder_name"), "bidder_id")
        .select("auction_id", "id", "amount", "is_winning", "created_at", "bidder_name")
        .orderBy(F.desc("amount"), "id")
    )


def my_bids(bids: DataFrame, auctions: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    lots = auctions.select(
        F.col("id").alias("auction_id"), F.col("title").alias("auction_title"), "current_price", "end_time",
        F.col("status").alias("auction_status"), "image_url",
    )
    return (
        _only(bids, "bidder_id", keys)
        .join(lots, "auction_id")
        .select(
            "bidder_id", F.col("id").alias("bid_id"), "amount", "is_winning", F.col("created_at").alias("bid_time"),
            "auction_id", "auction_title", "current_price", "end_time", "auction_status", "image_url",
        )
        .orderBy(F.desc("bid_time"), "bid_id")
    )


def my_auctions(auctions: DataFrame, categories: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    return (
        _only(auctions, "seller_id", keys)
        .join(_category(categories), "category_id")
        .orderBy(F.desc("created_at"), "id")
        .select(
            "seller_id", "id", "title", "image_url", "starting_price", "current_price", "start_time", "end_time",
            "status", "total_bids", "category_name",
        )
    )


def all_bids(bids: DataFrame, users: DataFrame, auctions: DataFrame) -> DataFrame:
    lots = auctions.select(
        F.col("id").alias("auction_id"), F.col("title").alias("auction_title"),
        F.col("status").alias("auction_status"), "current_price",
    )
    return (
        bids.join(lots, "auction_id")
        .join(_named(users, "bidder_id", "bidder_name", F.col("email").alias("bidder_email")), "bidder_id")
        .select(
            "id", "amount", "is_winning", "created_at", "bidder_name", "bidder_email", "auction_id",
            "auction_title", "auction_status", "current_price",
        )
        .orderBy(F.desc("created_at"), "id")
    )


def all_users(users: DataFrame) -> DataFrame:
    return users.select(
        "id", "username", "email", "full_name", "phone", "role", "is_active", "created_at"
    ).orderBy(F.desc("created_at"), "id")


def profile(users: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """What users see of themselves."""
    return _only(users, "id", keys).select(
        "id", "username", "email", "full_name", "phone", "address", "role", "created_at"
    )


def all_auctions(auctions: DataFrame, users: DataFrame, categories: DataFrame) -> DataFrame:
    return (
        auctions.join(_named(users, "seller_id", "seller_name"), "seller_id")
        .join(_category(categories), "category_id")
        .select(
            "id", "title", "status", "current_price", "total_bids", "start_time", "end_time", "created_at",
            "seller_name", "category_name",
        )
        .orderBy(F.desc("created_at"), "id")
    )


def watchlist_items(
    watchlist: DataFrame, auctions: DataFrame, categories: DataFrame, keys: DataFrame | None = None
) -> DataFrame:
    watched = _only(watchlist, "user_id", keys).select(
        "user_id", F.col("id").alias("watchlist_id"), F.col("created_at").alias("watched_at"),
        F.col("auction_id").alias("id"),
    )
    return (
        watched.join(auctions.drop("created_at"), "id")
        .join(_category(categories), "category_id")
        .select(
            "user_id", "watchlist_id", "watched_at", "id", "title", "starting_price", "current_price", "end_time",
            "status", "image_url", "total_bids", "category_name",
        )
        .orderBy(F.desc("watched_at"), "watchlist_id")
    )


def is_watching(pairs: DataFrame, watchlist: DataFrame) -> DataFrame:
    """(user_id, auction_id) pairs with whether the user watches that auction."""
    watched = watchlist.select("user_id", "auction_id", F.lit(True).alias("found"))
    return pairs.join(watched, ["user_id", "auction_id"], "left").select(
        "user_id", "auction_id", F.col("found").isNotNull().alias("is_watching")
    )


def notification_feed(notifications: DataFrame, auctions: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    lots = auctions.select(
        F.col("id").alias("auction_id"), F.col("title").alias("auction_title"),
        F.col("image_url").alias("auction_image"),
    )
    return (
        _only(notifications, "user_id", keys)
        .join(lots, "auction_id", "left")
        .select(*notifications.columns, "auction_title", "auction_image")
        .orderBy(F.desc("created_at"), "id")
    )


def unread_count(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.count_if(~F.col("is_read")).alias("unread"))


def latest_notifications(notifications: DataFrame, n: int = 10) -> DataFrame:
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "id")
    return notifications.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= n)


def active_auto_bid(auto_bids: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    if pairs is not None:
        auto_bids = auto_bids.join(pairs.select("auction_id", "user_id"), ["auction_id", "user_id"], "left_semi")
    return auto_bids.where("is_active")


def identity_conflicts(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """Candidates whose email or username a user has already, whatever its case."""
    def taken(column: str) -> DataFrame:
        have = users.select(F.lower(column).alias("folded"))
        return candidates.join(have, F.lower(candidates[column]) == F.col("folded"), "left_semi")

    return taken("email").unionByName(taken("username")).distinct()


