"""The report queries. Logs are aggregated to their key before anything is joined to them.

Ids are never NULL, so rows are counted as such: counting an id would read its column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.functions.text import contains
from gavelspark.functions.times import days, hours, minutes_between


def _mean(column: str) -> Column:
    return F.sum(column).cast("double") / F.count(column)


def _people(users: DataFrame, role: str) -> DataFrame:
    """Users under the name of the role they play in a join."""
    return users.select(
        F.col("id").alias(f"{role}_id"), F.col("username").alias(role), F.col("email").alias(f"{role}_email"),
        F.col("full_name").alias(f"{role}_full_name"),
    )


def _category(categories: DataFrame) -> DataFrame:
    return categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))


def active_by_end(auctions: DataFrame) -> DataFrame:
    return (
        auctions.where(F.col("status") == "active")
        .select("id", "title", "current_price", "end_time", "total_bids", "status")
        .orderBy("end_time", "id")
    )


def recent_users(users: DataFrame, as_of: Column, within_days: int = 30) -> DataFrame:
    return (
        users.where(F.col("created_at") >= as_of - days(within_days))
        .select("id", "username", "email", "role", "created_at")
        .orderBy(F.desc("created_at"), "id")
    )


def bids_for_auction(bids: DataFrame, users: DataFrame, auctions: DataFrame | None = None) -> DataFrame:
    """Bids with their bidder on the given auctions (a table with `id`), or on all."""
    if auctions is not None:
        bids = bids.join(auctions.select(F.col("id").alias("auction_id")), "auction_id", "left_semi")
    return (
        bids.join(_people(users, "bidder"), "bidder_id")
        .select(
            "auction_id", F.col("id").alias("bid_id"), "bidder", "amount", "is_winning",
            F.col("created_at").alias("bid_time"),
        )
        .orderBy(F.desc("amount"), "bid_id")
    )


def ending_soon(auctions: DataFrame, as_of: Column, within_hours: int = 24) -> DataFrame:
    return (
        auctions.where((F.col("status") == "active") & F.col("end_time").between(as_of, as_of + hours(within_hours)))
        .select(
            "id", "title", "current_price", "total_bids", "end_time",
            minutes_between(as_of, F.col("end_time")).alias("minutes_remaining"),
        )
        .orderBy("end_time", "id")
    )


def keyword_search(auctions: DataFrame, categories: DataFrame, word: str) -> DataFrame:
    return (
        auctions.where(contains(F.col("title"), word) | contains(F.col("description"), word))
        .join(_category(categories), "category_id")
        .select("id", "title", "current_price", "status", "category")
        .orderBy(F.desc("current_price"), "id")
    )


def auction_full(auctions: DataFrame, users: DataFrame, categories: DataFrame) -> DataFrame:
    return (
        auctions.join(_category(categories), "category_id")
        .join(_people(users, "seller"), "seller_id")
        .join(_people(users, "winner"), "winner_id", "left")
        .orderBy(F.desc("created_at"), "id")
        .select(
            F.col("id").alias("auction_id"), "title", "starting_price", "current_price", "status", "total_bids",
            "start_time", "end_time", F.col("seller").alias("seller_name"), "seller_email", "category",
            F.col("winner").alias("winner_name"),
        )
    )


def bid_history_full(bids: DataFrame, auctions: DataFrame, users: DataFrame) -> DataFrame:
    lots = auctions.select(
        F.col("id").alias("auction_id"), F.col("title").alias("auction_title"),
        F.col("status").alias("auction_status"), "current_price",
    )
    return (
        bids.join(lots, "auction_id")
        .join(_people(users, "bidder"), "bidder_id")
        .select(
            F.col("id").alias("bid_id"), "auction_title", F.col("bidder").alias("bidder_name"), "amount",
            "is_winning", F.col("created_at").alias("bid_placed_at"), "auction_status", "current_price",
        )
        .orderBy(F.desc("bid_placed_at"), "bid_id")
    )


def highest_bidder(auctions: DataFrame, bids: DataFrame, users: DataFrame) -> DataFrame:
    leading = bids.where("is_winning").select(F.col("auction_id").alias("id"), "bidder_id")
    return (
        auctions.join(leading, "id", "left")
        .join(_people(users, "bidder"), "bidder_id", "left")
        .select(
            "id", "title", F.col("current_price").alias("highest_bid"), "total_bids",
            F.col("bidder").alias("highest_bidder"), "end_time", "status",
        )
        .orderBy(F.desc("highest_bid"), "id")
    )


def user_activity(users: DataFrame, bids: DataFrame) -> DataFrame:
    activity = bids.groupBy(F.col("bidder_id").alias("id")).agg(
        F.countDistinct("auction_id").alias("auctions_bid_on"),
        F.count("*").alias("total_bids_placed"),
        F.max("amount").alias("highest_bid_ever"),
        F.sum("amount").alias("total_money_bid"),
    )
    return (
        users.select("id", "username", "email")
        .join(activity, "id", "left")
        .na.fill(0, ["auctions_bid_on", "total_bids_placed"])
        .orderBy(F.desc("auctions_bid_on"), "id")
    )


def category_stats(categories: DataFrame, auctions: DataFrame) -> DataFrame:
    stats = auctions.groupBy("category_id").agg(
        F.count("*").alias("total_auctions"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "closed").alias("closed"),
        F.sum("total_bids").alias("total_bids"),
        F.round(_mean("current_price"), 2).alias("avg_price"),
        F.max("current_price").alias("highest_price"),
    )
    return (
        _category(categories).join(stats, "category_id", "left")
        .na.fill(0, ["total_auctions", "active", "closed"])
        .orderBy(F.desc("total_auctions"), "category_id")
        .drop("category_id")
    )


def top_bidders(users: DataFrame, bids: DataFrame, n: int = 10) -> DataFrame:
    score = bids.groupBy("bidder_id").agg(
        F.count("*").alias("total_bids"),
        F.sum("amount").alias("total_bid_value"),
        F.max("amount").alias("highest_single_bid"),
        F.countDistinct("auction_id").alias("unique_auctions"),
    )
    return (
        score.join(_people(users, "bidder"), "bidder_id")
        .orderBy(F.desc("total_bids"), "bidder_id")
        .limit(n)
        .select(
            F.col("bidder").alias("username"), F.col("bidder_full_name").alias("full_name"), "total_bids",
            "total_bid_value", "highest_single_bid", "unique_auctions",
        )
    )


def most_competitive(auctions: DataFrame, users: DataFrame, categories: DataFrame, n: int = 10) -> DataFrame:
    return (
        auctions.where(F.col("total_bids") > 0)
        .join(_category(categories), "category_id")
        .join(_people(users, "seller"), "seller_id")
        .select("id", "title", "current_price", "total_bids", "status", "category", "seller")
        .orderBy(F.desc("total_bids"), "id")
        .limit(n)
    )


def category_avg_bids(categories: DataFrame, auctions: DataFrame) -> DataFrame:
    means = auctions.groupBy("category_id").agg(
        F.count("*").alias("total_auctions"),
        F.round(_mean("total_bids"), 1).alias("avg_bids_per_auction"),
        F.round(_mean("current_price"), 2).alias("avg_final_price"),
    )
    return (
        means.where(F.col("avg_bids_per_auction") > 0)
        .join(_category(categories), "category_id")
        .orderBy(F.desc("avg_bids_per_auction"), "category_id")
        .select("category", "total_auctions", "avg_bids_per_auction", "avg_final_price")
    )


def dual_participants(users: DataFrame, auctions: DataFrame, bids: DataFrame) -> DataFrame:
    # Counting on each side first avoids a row per pair of a user's auctions and bids.
    listed = auctions.groupBy(F.col("seller_id").alias("id")).agg(F.count("*").alias("auctions_listed"))
    placed = bids.groupBy(F.col("bidder_id").alias("id")).agg(F.count("*").alias("bids_placed"))
    return (
        users.select("id", "username", "email")
        .join(listed, "id")
        .join(placed, "id")
        .orderBy(F.desc("auctions_listed"), "id")
        .drop("id")
    )


def seller_revenue(users: DataFrame, auctions: DataFrame) -> DataFrame:
    sales = (
        auctions.where((F.col("status") == "closed") & F.col("winner_id").isNotNull())
        .groupBy("seller_id")
        .agg(
            F.count("*").alias("auctions_closed"),
            F.sum("current_price").alias("total_revenue"),
            _mean("current_price").alias("avg_sale_price"),
            F.max("current_price").alias("highest_sale"),
        )
        .where(F.col("total_revenue") > 0)
    )
    return (
        sales.join(_people(users, "seller"), "seller_id")
        .orderBy(F.desc("total_revenue"), "seller_id")
        .select(
            "seller", F.col("seller_email").alias("email"), "auctions_closed", "total_revenue", "avg_sale_price",
            "highest_sale",
        )
    )


def above_average(auctions: DataFrame) -> DataFrame:
    active = auctions.where(F.col("status") == "active")
    mean = active.agg(_mean("current_price").alias("mean")).scalar()
    return (
        active.where(F.col("current_price").cast("double") > mean)
        .select("id", "title", "current_price", "status", "total_bids")
        .orderBy(F.desc("current_price"), "id")
    )


def never_bid(users: DataFrame, bids: DataFrame) -> DataFrame:
    bidders = bids.select(F.col("bidder_id").alias("id")).distinct()
    return (
        users.where(F.col("role") == "buyer")
        .join(bidders, "id", "left_anti")
        .select("id", "username", "email", "role", "created_at")
        .orderBy(F.desc("created_at"), "id")
    )


def unique_bidders(auctions: DataFrame, bids: DataFrame, n: int = 5) -> DataFrame:
    counts = bids.groupBy(F.col("auction_id").alias("id")).agg(F.countDistinct("bidder_id").alias("unique_bidders"))
    return (
        auctions.select("id", "title", "current_price", "status")
        .join(counts, "id", "left")
        .na.fill(0, ["unique_bidders"])
        .orderBy(F.desc("unique_bidders"), "id")
        .limit(n)
    )


def latest_bid_per_user(bids: DataFrame, users: DataFrame, auctions: DataFrame) -> DataFrame:
    # A rank bound is applied before the shuffle too, so each task sends on only its latest bids.
    recent = Window.partitionBy("bidder_id").orderBy(F.desc("created_at"))
    lots = auctions.select(F.col("id").alias("auction_id"), F.col("title").alias("auction_title"))
    return (
        bids.withColumn("rank", F.rank().over(recent))
        .where(F.col("rank") == 1)
        .join(_people(users, "bidder"), "bidder_id")
        .join(lots, "auction_id")
        .orderBy(F.desc("created_at"), "id")
        .select(
            F.col("bidder").alias("username"), F.col("amount").alias("last_bid_amount"), "auction_title",
            F.col("created_at").alias("bid_time"),
        )
    )


def self_bids(bids: DataFrame, auctions: DataFrame, users: DataFrame) -> DataFrame:
    # Both equalities are join keys: a busy auction spreads over its bidders.
    own = auctions.select(
        F.col("id").alias("auction_id"), F.col("seller_id").alias("bidder_id"), F.col("title").alias("auction_title")
    )
    return bids.join(own, ["auction_id", "bidder_id"]).join(_people(users, "bidder"), "bidder_id").select(
        F.col("id").alias("suspicious_bid_id"), "auction_title", "bidder", "amount", "created_at"
    )


def overdue_active(auctions: DataFrame, as_of: Column) -> DataFrame:
    return (
        auctions.where((F.col("status") == "active") & (F.col("end_time") < as_of))
        .select(
            "id", "title", "end_time", "current_price", "total_bids",
            minutes_between(F.col("end_time"), as_of).alias("minutes_overdue"),
        )
        .orderBy("end_time", "id")
    )


def winner_report(auctions: DataFrame, users: DataFrame) -> DataFrame:
    return (
        auctions.where((F.col("status") == "closed") & F.col("winner_id").isNotNull())
        .join(_people(users, "seller"), "seller_id")
        .join(_people(users, "winner"), "winner_id")
        .select(
            F.col("id").alias("auction_id"), F.col("title").alias("item_won"),
            F.col("current_price").alias("winning_price"), "end_time", F.col("seller").alias("sold_by"),
            F.col("winner").alias("won_by"), "winner_email", "total_bids",
        )
        .orderBy(F.desc("end_time"), "auction_id")
    )


def most_active(
    auctions: DataFrame, categories: DataFrame, users: DataFrame, bids: DataFrame, n: int = 5
) -> DataFrame:
    tally = bids.groupBy(F.col("auction_id").alias("id")).agg(
        F.count("*").alias("total_bids"), F.max("amount").alias("highest_bid")
    )
    return (
        auctions.select("id", "title", "category_id", "seller_id")
        .join(tally, "id", "left")
        .na.fill(0, ["total_bids"])
        .join(_category(categories), "category_id")
        .join(_people(users, "seller"), "seller_id")
        .orderBy(F.desc("total_bids"), "id")
        .limit(n)
        .select(F.col("title").alias("auction_title"), "category", "seller", "total_bids", "highest_bid")
    )


def winning_investment(users: DataFrame, bids: DataFrame) -> DataFrame:
    stakes = bids.where("is_winning").groupBy("bidder_id").agg(F.sum("amount").alias("total_investment"))
    return (
        stakes.join(_people(users, "bidder"), "bidder_id")
        .orderBy(F.desc("total_investment"), "bidder_id")
        .select(F.col("bidder").alias("vip_bidder"), F.col("bidder_email").alias("email"), "total_investment")
    )


def category_volume(categories: DataFrame, auctions: DataFrame) -> DataFrame:
    volume = auctions.groupBy("category_id").agg(
        F.count("*").alias("total_items"),
        F.sum("current_price").alias("potential_volume"),
        _mean("current_price").alias("average_item_value"),
    )
    return (
        _category(categories).join(volume, "category_id", "left")
        .na.fill(0, ["total_items"])
        .orderBy(F.desc("potential_volume"), "category_id")
        .select(F.col("category").alias("category_name"), "total_items", "potential_volume", "average_item_value")
    )
