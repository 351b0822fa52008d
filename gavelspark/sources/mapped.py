"""The auction tables derived from the order, line and event tables of a data folder (FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelspark.functions.times import naive
from gavelspark.operators import changes, lifecycle

AS_OF = "2000-01-01 00:00:00"
MONEY = "decimal(10,2)"


class AuctionData:
    """Lazy DataFrames: nothing is read until a query on them runs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.as_of = naive(AS_OF)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        return self._read("customer").select(
            key.alias("id"),
            F.col("c_name").alias("username"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            F.col("c_mktsegment").alias("full_name"),
            F.lit(None).cast("string").alias("phone"),
            F.lit(None).cast("string").alias("address"),
            F.when(key % 97 == 1, "admin").when(key % 3 == 0, "seller").otherwise("buyer").alias("role"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
            (self.as_of - F.make_dt_interval((key % 90).cast("int"))).alias("created_at"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        return self._read("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))

    @cached_property
    def _lines(self) -> DataFrame:
        """Order lines as bids. Ids and times come from a line alone: no order is ranked in one task."""
        order, part, supplier = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
        line, amount = F.col("l_linenumber").cast("long"), F.col("l_extendedprice").cast(MONEY)
        cents = (amount * 100).cast("long")
        # Lines have no key. A mix of their values is one, and the line number above it lets ids rise with time.
        content = (part * 99999989 + supplier * 86028121 + cents * 49979687) % 2**28
        return self._read("lineitem").select(
            (line * 2**56 + order * 7368787 % 2**28 * 2**28 + content).alias("id"),
            order.alias("auction_id"),
            supplier.alias("bidder_id"),
            amount.alias("amount"),
            (cents * 2**29 + line * 2**26 + (part * 31 + supplier) % 2**26).alias("rank"),
            (
                F.make_dt_interval(F.col("l_linenumber") * 5)
                + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("l_partkey") % 86400).cast("decimal(18,6)"))
            ).alias("after"),
        )

    @cached_property
    def _tally(self) -> DataFrame:
        # Ranks are plain numbers, which keeps this a hash aggregation on both sides of the shuffle.
        return self._lines.groupBy(F.col("auction_id").alias("tallied")).agg(
            F.max("rank").alias("lead"), F.max_by("bidder_id", "rank").alias("leader_id"), F.max("amount").alias("top"),
            F.count("*").alias("n"),
        )

    @cached_property
    def _bid_on(self) -> DataFrame:
        return self._read("orders").where(F.col("o_orderstatus").isin("O", "F")).select(
            F.col("o_orderkey").alias("auction_id"), F.col("o_orderdate").alias("start")
        )

    @cached_property
    def attempts(self) -> DataFrame:
        """Bids before anyone said which of them lead."""
        return self._lines.join(self._bid_on, "auction_id").select(
            "id", "auction_id", "bidder_id", "amount", (F.col("start") + F.col("after")).alias("created_at")
        )

    @cached_property
    def bids(self) -> DataFrame:
        """The highest rank leads: the largest amount, of equal ones the last line."""
        parents = self._bid_on.join(
            self._tally.select(F.col("tallied").alias("auction_id"), "lead"), "auction_id"
        )
        return self._lines.join(parents, "auction_id").select(
            "id", "auction_id", "bidder_id", "amount", (F.col("rank") == F.col("lead")).alias("is_winning"),
            (F.col("start") + F.col("after")).alias("created_at"),
        )

    @cached_property
    def _listing(self) -> DataFrame:
        """The columns of an auction that do not depend on its bids."""
        key, total = F.col("o_orderkey"), F.col("o_totalprice")
        return self._read("orders").select(
            key.alias("id"),
            F.col("o_custkey").alias("seller_id"),
            (key % 20).cast("int").alias("category_id"),
            F.concat("o_orderpriority", F.lit(" lot "), key.cast("string")).alias("title"),
            F.lit(None).cast("string").alias("description"),
            F.lit(None).cast("string").alias("image_url"),
            F.floor(total / 20).cast(MONEY).alias("starting_price"),
            F.when(key % 2 == 0, F.floor(total / 10).cast(MONEY)).alias("reserve_price"),
            F.when(key % 3 == 0, F.floor(total / 5).cast(MONEY)).alias("buy_now_price"),
            F.col("o_orderdate").alias("start_time"),
            (F.col("o_orderdate") + F.make_dt_interval(F.lit(30))).alias("end_time"),
            F.when(F.col("o_orderstatus") == "O", "active")
            .when(F.col("o_orderstatus") == "F", "closed")
            .when(key % 2 == 0, "upcoming")
            .otherwise("cancelled")
            .alias("status"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def auction_items(self) -> DataFrame:
        biddable = F.col("status").isin("active", "closed")
        won = (F.col("status") == "closed") & (F.col("id") % 7 != 0)
        return self._listing.join(self._tally, F.col("id") == F.col("tallied"), "left").select(
            "id", "seller_id", "category_id", "title", "description", "image_url", "starting_price", "reserve_price",
            F.coalesce(F.when(biddable, F.col("top")), "starting_price").alias("current_price"),
            "buy_now_price", "start_time", "end_time", "status",
            F.when(won, F.col("leader_id")).alias("winner_id"),
            F.coalesce(F.when(biddable, F.col("n")), F.lit(0)).cast("int").alias("total_bids"),
            "created_at",
        )

    @cached_property
    def opening(self) -> DataFrame:
        """Auctions as they stood before their first bid; a closed one was open then."""
        return self._listing.select(
            "id", "seller_id", "title", "starting_price", F.col("starting_price").alias("current_price"),
            "buy_now_price", "end_time",
            F.when(F.col("status") == "closed", "active").otherwise(F.col("status")).alias("status"),
        )

    @cached_property
    def auto_bids(self) -> DataFrame:
        """One proxy per auction and user; ids are auction * 1000 + user, users being below 150."""
        maxima = (
            self._read("lineitem")
            .groupBy("l_orderkey", (F.col("l_partkey") % 150).alias("user_id"))
            .agg(F.max(F.col("l_quantity").cast("int") % 25).alias("headroom"))
        )
        active = self.auction_items.where((F.col("status") == "active") & (F.col("total_bids") > 0)).select(
            F.col("id").alias("auction_id"), "current_price", "start_time"
        )
        return maxima.join(active, F.col("l_orderkey") == F.col("auction_id")).select(
            (F.col("auction_id") * 1000 + F.col("user_id")).alias("id"),
            "auction_id",
            "user_id",
            (F.col("current_price") + F.col("headroom").cast(MONEY)).cast(MONEY).alias("max_amount"),
            F.lit(True).alias("is_active"),
            F.col("start_time").alias("created_at"),
        )

    @cached_property
    def watch_log(self) -> DataFrame:
        return self._read("events").where(F.col("event_type").isin("view", "click", "error")).select(
            F.col("event_id").alias("id"),
            "user_id",
            (F.col("event_id") % 50).alias("auction_id"),
            F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("op"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        """The request log the admission limiter reads."""
        return self._read("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("client"), F.col("ts").alias("at")
        )

    @cached_property
    def watchlist(self) -> DataFrame:
        return changes.watch_upsert(self.watch_log, self.auction_items)

    @cached_property
    def replay(self) -> DataFrame:
        return lifecycle.bid_replay(self.opening, self.attempts)

    @cached_property
    def notifications(self) -> DataFrame:
        won = lifecycle.won_notices(self.auction_items.where(F.col("status") == "closed"), self.as_of)
        return lifecycle.outbid_notices(self.replay).unionByName(won)
