"""Bids under the auction rules, and the closing of auctions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.functions.text import money, zero_to_null
from gavelspark.functions.times import countdown, left_hours, left_long, left_short, micros
from gavelspark.operators import splitting
from gavelspark.operators.splitting import DEFAULT, Split

NOTICE = ("id", "user_id", "auction_id", "type", "message", "is_read", "created_at")


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _rules(auctions: DataFrame, opening: str, keep: Sequence[str]) -> DataFrame:
    """What the rules need of an auction. A leader it has before the log begins is its `leader_id`."""
    standing = F.col("leader_id") if "leader_id" in auctions.columns else F.lit(None).cast("long")
    return auctions.select(
        F.col("id").alias("auction_id"), "seller_id", "title", "status", "end_time",
        F.col(opening).alias("opening_price"), zero_to_null(F.col("buy_now_price")).alias("buy_now_price"),
        F.lit(True).alias("known"), standing.alias("standing"), *keep,
    )


def _tests(rows: DataFrame, expiry: bool, buy_now: bool) -> DataFrame:
    """What can be said of an attempt from its own row and its auction."""
    valid = F.col("auction_id").isNotNull() & _yes(F.col("amount") > 0)
    open_ = valid & _yes(F.col("status") == "active")
    late = open_ & _yes(F.col("created_at") > F.col("end_time")) if expiry else F.lit(False)
    own = _yes(F.col("bidder_id") == F.col("seller_id"))
    contends = open_ & ~late & ~own & _yes(F.col("amount") > F.col("opening_price"))
    # The first contender at or above the buy-now price beats all before it: those were below
    # that price. So whether an attempt can close its auction needs no running price.
    buys = contends & _yes(F.col("amount") >= F.col("buy_now_price")) if buy_now else F.lit(False)
    return rows.select(
        "*", valid.alias("valid"), late.alias("late"), own.alias("own"), contends.alias("contends"),
        (late | buys).alias("closing"), F.struct("created_at", "id").alias("place"),
    )


def _peak() -> Column:
    """Largest amount first, among equal amounts the earliest: only that one was accepted."""
    return F.struct(
        F.col("amount").alias("amount"),
        (-micros(F.col("created_at"))).alias("time"),
        (-F.col("id")).alias("order"),
        F.col("bidder_id").alias("bidder"),
    )


_GROUP = ["auction_id", "slice"]


def _from_earlier(hot: DataFrame, attempts: DataFrame, rules: DataFrame, expiry: bool, buy_now: bool) -> DataFrame:
    """What each slice of the cut auctions must know of the others.

    `hot` is bounded, so are its auctions and slices: broadcast joins and map-side aggregation
    only, no row of these auctions' attempts is shuffled here.
    """
    few = rules.join(F.broadcast(hot.select("auction_id")), "auction_id", "left_semi")
    pressed = _tests(
        splitting.only_oversized(attempts, hot, "auction_id", "created_at").join(F.broadcast(few), "auction_id"),
        expiry, buy_now,
    )
    closed = pressed.where("closing").groupBy("auction_id").agg(F.min("place").alias("closed_at")).checkpoint()
    peaks = (
        pressed.join(F.broadcast(closed), "auction_id", "left")
        .where(F.col("contends") & ~_yes(F.col("place") > F.col("closed_at")))
        .groupBy(*_GROUP)
        .agg(F.max(_peak()).alias("peak"))
        .checkpoint()
    )
    final = peaks.groupBy("auction_id").agg(F.max("peak").alias("last_peak"))
    # Every slice gets a row, also one without contenders, so that it learns of the earlier ones.
    every_slice = hot.select("auction_id", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    return (
        splitting.earlier_slices(every_slice.join(F.broadcast(peaks), _GROUP, "left"), "auction_id", "peak")
        .withColumnRenamed("peak", "earlier_peak")
        .join(F.broadcast(closed), "auction_id", "left")
        .join(F.broadcast(final), "auction_id", "left")
    )


def _run(
    auctions: DataFrame, attempts: DataFrame, opening: str, expiry: bool, buy_now: bool, split: Split,
    keep: Sequence[str] = (),
) -> DataFrame:
    """All attempts with what decides on them. One shuffle on (auction, slice) serves join and windows."""
    hot = splitting.oversized(attempts, "auction_id", "created_at", split)
    rules = _rules(auctions, opening, keep)
    rows = splitting.cut(attempts, hot, "auction_id", "created_at").join(
        splitting.spread(rules, hot, "auction_id"), _GROUP, "left"
    )
    if hot is None:
        closed_earlier, earlier_peak, last_peak = F.lit(False), None, None
    else:
        carried = _from_earlier(hot, attempts, rules, expiry, buy_now)
        rows = rows.join(F.broadcast(carried), _GROUP, "left")
        closed_earlier = _yes(F.col("place") > F.col("closed_at"))
        earlier_peak, last_peak = F.col("earlier_peak"), F.col("last_peak")

    before = Window.partitionBy(*_GROUP).orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    tested = _tests(rows, expiry, buy_now)
    dated = tested.select("*", (_yes(F.max("closing").over(before)) | closed_earlier).alias("over"))
    contender = F.when(F.col("contends") & ~F.col("over"), _peak())
    best = F.max(contender).over(before)
    leader = F.max(contender).over(Window.partitionBy(*_GROUP))
    peaked = dated.select(
        "*",
        (best if earlier_peak is None else F.greatest(best, earlier_peak)).alias("best"),
        (leader if last_peak is None else F.coalesce(last_peak, leader)).alias("leader"),
    )
    price = F.greatest("opening_price", "best.amount")
    return peaked.select(
        "*", price.alias("price_before"),
        (F.col("contends") & ~F.col("over") & (F.col("amount") > price)).alias("accepted"),
    )


def bid_replay(
    auctions: DataFrame, attempts: DataFrame, *, opening: str = "starting_price", split: Split = DEFAULT
) -> DataFrame:
    """Each attempt with its outcome when all are made in order of (created_at, id).

    Outcomes: ok, or the first rule that fails of invalid, unknown_auction, not_active, ended,
    self, low. A late attempt closes its auction without a winner, an accepted one at or above
    the buy-now price closes it with one. To go on from a snapshot, open at its current price
    and give its auctions a `leader_id`: that user is displaced by the first accepted bid.
    """
    rows = _run(auctions, attempts, opening, True, True, split)
    outcome = (
        F.when(~F.col("valid"), "invalid")
        .when(F.col("known").isNull(), "unknown_auction")
        .when((F.col("status") != "active") | F.col("over"), "not_active")
        .when(F.col("late"), "ended")
        .when(F.col("own"), "self")
        .when(F.col("accepted"), "ok")
        .otherwise("low")
    )
    return rows.select(
        "id", "auction_id", "bidder_id", "amount", "created_at",
        outcome.alias("outcome"),
        "price_before",
        F.coalesce("best.bidder", "standing").alias("leader_before"),
        (F.col("accepted") & _yes(F.col("id") == -F.col("leader.order"))).alias("is_winning"),
        (F.col("accepted") & F.col("closing")).alias("bought"),
        "title",
        "seller_id",
    )


def place_bid_rules(
    auctions: DataFrame, attempts: DataFrame, *, opening: str = "starting_price", split: Split = DEFAULT
) -> DataFrame:
    """The shorter rule set: no expiry, no buy-now. Amounts count with two decimals."""
    attempts = attempts.withColumn("amount", F.col("amount").cast("decimal(10,2)"))
    rows = _run(auctions, attempts, opening, False, False, split)
    # The result texts.
    result = (
        F.when(F.col("known").isNull(), "unknown_auction")
        .when(F.col("status") != "active", "ERROR: Auction is not active")
        .when(F.col("own"), "ERROR: Seller cannot bid on own auction")
        .when(F.col("accepted"), "SUCCESS: Bid placed")
        .otherwise("ERROR: Bid must be higher than current price")
    )
    return rows.select(
        "id", "auction_id", "bidder_id", "amount", "created_at", result.alias("result"), "price_before",
        (F.col("accepted") & _yes(F.col("id") == -F.col("leader.order"))).alias("is_winning"),
    )


def record_bids(
    auctions: DataFrame, attempts: DataFrame, *, keep: Sequence[str] = (), split: Split = DEFAULT
) -> DataFrame:
    """The accepted attempts, with columns of their auction to `keep`."""
    rows = _run(auctions, attempts, "starting_price", True, True, split, keep)
    return rows.where("accepted").select("id", "auction_id", "bidder_id", "amount", "created_at", *keep)


def accepted_bids(replay: DataFrame) -> DataFrame:
    return replay.where(F.col("outcome") == "ok")


def winning_flags(accepted: DataFrame) -> DataFrame:
    """Per auction: leading bid, current price and number of bids. Accepted amounts only rise."""
    return (
        accepted.groupBy("auction_id")
        .agg(F.max(F.struct("amount", "id", "bidder_id")).alias("top"), F.count("*").cast("int").alias("total_bids"))
        .select(
            "auction_id", F.col("top.id").alias("winning_bid_id"), F.col("top.bidder_id").alias("leader_id"),
            F.col("top.amount").alias("current_price"), "total_bids",
        )
    )


def auctions_after(auctions: DataFrame, replay: DataFrame) -> DataFrame:
    """The snapshot a replay leaves: price, bids added to those there were, and what a purchase or a late attempt closed.

    All columns stay; a snapshot without `total_bids` or `winner_id` has had no bids or winners yet.
    """
    accepted = F.col("outcome") == "ok"
    moved = replay.groupBy(F.col("auction_id").alias("moved_id")).agg(
        F.max(F.when(accepted, F.col("amount"))).alias("price"),
        F.count_if(accepted).cast("int").alias("bids"),
        F.max(F.when(F.col("bought"), F.col("bidder_id"))).alias("buyer_id"),
        F.bool_or(F.col("bought") | (F.col("outcome") == "ended")).alias("closes"),
    )
    for missing, none in (("total_bids", F.lit(0)), ("winner_id", F.lit(None).cast("long"))):
        if missing not in auctions.columns:
            auctions = auctions.withColumn(missing, none)
    changed = {
        "current_price": F.coalesce("price", "current_price"),
        "total_bids": (F.col("total_bids") + F.coalesce("bids", F.lit(0))).cast("int"),
        "status": F.when(F.col("closes"), "closed").otherwise(F.col("status")),
        "winner_id": F.coalesce("buyer_id", "winner_id"),
    }
    joined = auctions.join(moved, F.col("id") == F.col("moved_id"), "left")
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in auctions.columns))


def resumed(auctions: DataFrame, logs: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Replays that follow each other, each from the snapshot and the leaders that those before it left.

    Returns the attempts of all of them with their outcomes, and the last snapshot.
    """
    judged, led = None, None
    for log in logs:
        start = auctions if led is None else auctions.join(led, F.col("id") == F.col("led_id"), "left").drop("led_id")
        replay = bid_replay(start, log, opening="current_price")
        auctions = auctions_after(auctions, replay)
        judged = replay if judged is None else judged.unionByName(replay)
        led = winning_flags(accepted_bids(judged)).select(F.col("auction_id").alias("led_id"), "leader_id")
    return judged, auctions


def buy_now_close(replay: DataFrame) -> DataFrame:
    """Auctions that an accepted bid at or above the buy-now price closed."""
    return replay.where("bought").select(
        "auction_id", F.col("bidder_id").alias("winner_id"), F.col("amount").alias("final_price"),
        F.col("created_at").alias("closed_at"),
    )


def outbid_notices(replay: DataFrame) -> DataFrame:
    """A notice to the leader whom another user's accepted bid displaces."""
    displaced = accepted_bids(replay).where(F.col("leader_before") != F.col("bidder_id"))
    return displaced.select(
        (F.col("id") * 2).alias("id"),
        F.col("leader_before").alias("user_id"),
        "auction_id",
        F.lit("outbid").alias("type"),
        # The notice text.
        F.concat(
            F.lit("You've been outbid on \""), "title", F.lit("\"! New price: ₹"), money(F.col("amount"))
        ).alias("message"),
        F.lit(False).alias("is_read"),
        "created_at",
    )


def won_notices(closed: DataFrame, as_of: Column, price: str = "current_price") -> DataFrame:
    """A notice to the winner of each closed auction that has one."""
    return closed.where(F.col("winner_id").isNotNull()).select(
        (F.col("id") * 2 + 1).alias("id"),
        F.col("winner_id").alias("user_id"),
        F.col("id").alias("auction_id"),
        F.lit("auction_won").alias("type"),
        # The notice text.
        F.concat(
            F.lit("Congratulations! You won \""), "title", F.lit("\" for ₹"), money(F.col(price))
        ).alias("message"),
        F.lit(False).alias("is_read"),
        as_of.alias("created_at"),
    )


def leaders(bids: DataFrame) -> DataFrame:
    """The winning row per auction; of several, the one with the highest amount, then id."""
    top = F.max(F.struct("amount", "id", "bidder_id")).alias("top")
    return bids.where("is_winning").groupBy(F.col("auction_id").alias("led_id")).agg(top).select(
        "led_id", F.col("top.bidder_id").alias("leader_id"), F.col("top.amount").alias("leader_amount")
    )


def resolve_expired(auctions: DataFrame, bids: DataFrame, as_of: Column) -> DataFrame:
    """Close what has ended by now, the leader winning."""
    ends = (F.col("status") == "active") & (F.col("end_time") <= as_of)
    return (
        auctions.join(leaders(bids), F.col("id") == F.col("led_id"), "left")
        .withColumn("winner_id", F.when(ends, F.col("leader_id")).otherwise(F.col("winner_id")))
        .withColumn("status", F.when(ends, "closed").otherwise(F.col("status")))
        .select(*auctions.columns)
    )


def close_and_repair(auctions: DataFrame, bids: DataFrame, as_of: Column) -> DataFrame:
    """Close what ended before now, then give every closed auction with bids its missing winner."""
    ended = (F.col("status") == "active") & (F.col("end_time") < as_of)
    repair = (F.col("status") == "closed") & F.col("winner_id").isNull() & (F.col("total_bids") > 0)
    return (
        auctions.join(leaders(bids), F.col("id") == F.col("led_id"), "left")
        .withColumn("status", F.when(ended, "closed").otherwise(F.col("status")))
        .withColumn("winner_id", F.when(repair, F.col("leader_id")).otherwise(F.col("winner_id")))
        .select(*auctions.columns)
    )


def _expiring(auctions: DataFrame, bids: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    ended = auctions.where((F.col("status") == "active") & (F.col("end_time") < as_of))
    named = users.select(F.col("id").alias("leader_id"), F.col("username").alias("winner_name"))
    return ended.join(
        leaders(bids).join(named, "leader_id"), F.col("id") == F.col("led_id"), "left"
    )


def auto_close(auctions: DataFrame, bids: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """The snapshot after a pass of the closing job."""
    ends = (F.col("status") == "active") & (F.col("end_time") < as_of)
    winners = leaders(bids).join(users.select(F.col("id").alias("leader_id")), "leader_id")
    return (
        auctions.join(winners, F.col("id") == F.col("led_id"), "left")
        .withColumn("winner_id", F.when(ends, F.col("leader_id")).otherwise(F.col("winner_id")))
        .withColumn("status", F.when(ends, "closed").otherwise(F.col("status")))
        .select(*auctions.columns)
    )


def auto_close_events(auctions: DataFrame, bids: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """What watchers of an auction are told by a pass of the closing job."""
    return _expiring(auctions, bids, users, as_of).select(
        F.lit("auction-closed").alias("event_type"),
        F.col("id").alias("auction_id"),
        "winner_name",
        F.coalesce("leader_amount", F.lit(0)).cast("decimal(10,2)").alias("final_price"),
        F.when(F.col("leader_id").isNull(), "Auction ended with no bids").alias("message"),
    )


def auto_close_notices(auctions: DataFrame, bids: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """The winners' notices of a pass of the closing job."""
    closing = _expiring(auctions, bids, users, as_of).withColumn("winner_id", F.col("leader_id"))
    return won_notices(closing, as_of, price="leader_amount")


def new_auctions(submissions: DataFrame, as_of: Column) -> DataFrame:
    """Auctions made of the submissions that have what is required and end after they start."""
    complete = (
        (F.col("title") != "") & F.col("category_id").isNotNull() & (F.col("starting_price") != 0)
        & (F.col("end_time") > F.col("start_time"))
    )
    return submissions.where(complete).select(
        "id", "seller_id", "category_id", "title",
        F.nullif("description", F.lit("")).alias("description"),
        F.nullif("image_url", F.lit("")).alias("image_url"),
        "starting_price",
        F.col("starting_price").alias("current_price"),
        zero_to_null(F.col("reserve_price")).alias("reserve_price"),
        zero_to_null(F.col("buy_now_price")).alias("buy_now_price"),
        "start_time", "end_time",
        F.when(F.col("start_time") <= as_of, "active").otherwise("upcoming").alias("status"),
        F.lit(0).alias("total_bids"),
    )


def time_left(auctions: DataFrame, as_of: Column) -> DataFrame:
    """Labels of the time an active auction has left, in the four forms the pages use."""
    end = F.col("end_time")
    return auctions.where(F.col("status") == "active").select(
        "id", "end_time", left_long(end, as_of).alias("card"), left_short(end, as_of).alias("listing"),
        left_hours(end, as_of).alias("dashboard"), countdown(end, as_of).alias("countdown"),
    )
