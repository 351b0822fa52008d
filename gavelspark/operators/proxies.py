"""Proxy bids: users who let the engine raise for them up to a maximum."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelspark.functions.text import zero_to_null
from gavelspark.operators import lifecycle
from gavelspark.operators.splitting import DEFAULT, Split

# Fixed value: replies to one bid end with the 21st.
MOST_REPLIES = 21


def best_two(auto_bids: DataFrame) -> DataFrame:
    """Per auction the two best active proxies: highest maximum, then lowest id.

    Two are enough: whoever bid last, the next reply is by one of them.
    """
    # Ranks up to 2 are cut on the map side already, so a busy auction costs two rows per task.
    rank = F.row_number().over(Window.partitionBy("auction_id").orderBy(F.desc("max_amount"), "id"))
    top = auto_bids.where("is_active").select("auction_id", "user_id", "max_amount", rank.alias("rank")).where("rank <= 2")
    proxy = F.struct("user_id", "max_amount")
    return top.groupBy("auction_id").agg(
        F.max(F.when(F.col("rank") == 1, proxy)).alias("first"),
        F.max(F.when(F.col("rank") == 2, proxy)).alias("second"),
    )


def _turns(bidder: Column) -> tuple[Column, Column]:
    """Who replies on odd and who on even turns to a bid of `bidder`."""
    own = F.col("first.user_id") == bidder
    return F.when(own, F.col("second")).otherwise(F.col("first")), F.when(own, F.col("first")).otherwise(F.col("second"))


def replies(price: Column, odd: Column, even: Column) -> Column:
    """How many bids, each one above the last, the two proxies make on top of `price`.

    The odd one stops at the first odd step beyond its maximum, the even one at the first even
    step; a missing proxy cannot make its first step.
    """
    def room(proxy: Column) -> Column:
        return F.greatest(F.coalesce(F.floor(proxy["max_amount"] - price), F.lit(0)), F.lit(0))

    odd_room, even_room = room(odd), room(even)
    odd_stop = odd_room + 1 + odd_room % 2
    even_stop = even_room + 2 - even_room % 2
    return (F.least(odd_stop, even_stop, F.lit(MOST_REPLIES + 1)) - 1).cast("int")


def _reply_rows(bids: DataFrame, keep: list[str]) -> DataFrame:
    """One row per reply; `bids` has amount, odd, even and replies."""
    return (
        bids.where("replies > 0")
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.col("replies"))))
        .select(
            *keep,
            "step",
            F.when(F.col("step") % 2 == 1, F.col("odd.user_id")).otherwise(F.col("even.user_id")).alias("bidder_id"),
            (F.col("amount") + F.col("step")).cast("decimal(10,2)").alias("amount"),
            (F.col("step") == F.col("replies")).alias("is_winning"),
        )
    )


def auto_bid_battle(auctions: DataFrame, auto_bids: DataFrame, last_bids: DataFrame) -> DataFrame:
    """The proxy bids that one last bid (auction_id, bidder_id) per active auction sets off."""
    active = auctions.where(F.col("status") == "active").select(
        F.col("id").alias("auction_id"), F.col("current_price").alias("amount")
    )
    odd, even = _turns(F.col("bidder_id"))
    set_off = (
        active.join(last_bids.select("auction_id", "bidder_id"), "auction_id")
        .join(best_two(auto_bids), "auction_id")
        .withColumn("odd", odd)
        .withColumn("even", even)
        .withColumn("replies", replies(F.col("amount"), F.col("odd"), F.col("even")))
    )
    return _reply_rows(set_off, ["auction_id"])


_ASKED = "auction_id long, user_id long, max_amount decimal(10,2), created_at timestamp_ntz, result string, bid_amount decimal(10,2)"
_TOO_LOW = "Max amount must be higher than current price."


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold each auction's requests in order, carrying its price and leader from batch to batch."""
    auction, price, leader = object(), 0, None
    for batch in batches:
        rows = batch.to_pydict()
        results, amounts = [], []
        for at, user, most, opening, led in zip(rows["auction_id"], rows["user_id"], rows["cents"], rows["price"], rows["leader_id"]):
            if at != auction:
                auction, price, leader = at, opening, led
            if most <= price:
                results.append(_TOO_LOW)
                amounts.append(None)
                continue
            results.append("activated")
            if leader is not None and leader == user:
                amounts.append(None)
                continue
            price, leader = min(price + 100, most), user
            amounts.append(Decimal(price).scaleb(-2))
        yield pa.RecordBatch.from_pydict({
            "auction_id": rows["auction_id"], "user_id": rows["user_id"], "max_amount": rows["max_amount"],
            "created_at": rows["created_at"], "result": results, "bid_amount": amounts,
        }, schema=pa.schema([("auction_id", pa.int64()), ("user_id", pa.int64()), ("max_amount", pa.decimal128(10, 2)),
                             ("created_at", pa.timestamp("us")), ("result", pa.string()), ("bid_amount", pa.decimal128(10, 2))]))


def auto_bid_activate(auctions: DataFrame, bids: DataFrame, requests: DataFrame) -> DataFrame:
    """What enabling a proxy does: (auction_id, user_id, max_amount, created_at) → result and first bid.

    Requests of one auction take effect one after another, in order of created_at (nulls last; all null if the column is
    missing), then user_id and max_amount;
    each sees the price and leader that the ones before it left. One at or below the price is refused; otherwise it is
    activated, and unless its user leads, it bids one more than the price (the maximum where that is less), which makes
    the user the leader at that price. A missing auction id or maximum (null or 0) and unknown auctions change nothing.

    The fold is a walk over each auction's requests, sorted within partitions of auction ids and streamed in Arrow batches
    with two values carried, so memory stays flat however many requests an auction has; only they are in order, not the work.
    """
    stated = auctions.select(F.col("id").alias("auction_id"), "current_price", F.lit(True).alias("known"))
    most = F.col("max_amount")
    missing = ~F.coalesce(F.col("auction_id") != 0, F.lit(False)) | ~F.coalesce(most != 0, F.lit(False))
    rows = (
        requests.select(
            "auction_id", "user_id", most.cast("decimal(10,2)").alias("max_amount"),
            (F.col("created_at") if "created_at" in requests.columns else F.lit(None)).cast("timestamp_ntz").alias("created_at"),
        )
        .join(stated, "auction_id", "left")
        .join(lifecycle.leaders(bids).withColumnRenamed("led_id", "auction_id"), "auction_id", "left")
        .withColumn("missing", missing)
    )
    refused = rows.where(F.col("missing") | F.col("known").isNull()).select(
        "auction_id", "user_id", "max_amount", "created_at",
        F.when(F.col("missing"), "auction_id and max_amount required.").otherwise("Auction not found.").alias("result"),
        F.lit(None).cast("decimal(10,2)").alias("bid_amount"),
    )
    cents = (most * 100).cast("long")
    folded = (
        rows.where(~F.col("missing") & F.col("known").isNotNull())
        .select("auction_id", "user_id", "max_amount", "created_at", cents.alias("cents"),
                (F.coalesce(F.col("current_price"), F.lit(0)) * 100).cast("long").alias("price"), "leader_id")
        .repartition("auction_id")
        .sortWithinPartitions("auction_id", F.asc_nulls_last("created_at"), F.asc_nulls_last("user_id"), "cents")
        .mapInArrow(_in_order, _ASKED)
    )
    return folded.unionByName(refused)


_RECORD = "auction_id long, lane int, id long, bidder_id long, created_at timestamp_ntz, cents long, " \
    "replies int, buys boolean, odd_user long, even_user long"


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follow each lane's bids in order of amount, keeping one price between batches."""
    lane, price, closed = None, 0, False
    for batch in batches:
        taken = []
        for auction, part, cents, more, buys in zip(
            *(batch[c].array for c in ("auction_id", "lane", "cents", "replies", "buys"))
        ):
            if (auction, part) != lane:
                lane, price, closed = (auction, part), -1, False
            taken.append(not closed and cents > price)
            if taken[-1]:
                price, closed = cents + 100 * more, buys
        yield batch[taken]


def valid_log(log: DataFrame, auctions: DataFrame) -> DataFrame:
    """The set and stop rows (id, auction_id, user_id, op, max_amount, created_at) that take effect, with the proxy's id.

    As in `changes.auto_bid_upsert`: a set needs a known auction and a maximum above its current price, and a proxy keeps
    the id of its first accepted set. A stop always takes effect on a known auction.
    """
    prices = auctions.select(F.col("id").alias("auction_id"), "current_price")
    kept = log.join(prices, "auction_id").where(
        (F.col("op") == "stop") | ((F.col("op") == "set") & (F.col("max_amount") > F.col("current_price")))
    ).select("id", "auction_id", "user_id", "op", "max_amount", "created_at")
    first = F.min(F.when(F.col("op") == "set", F.struct("created_at", "id"))).over(Window.partitionBy("auction_id", "user_id"))
    # A proxy without user has no id. A window takes the log once, where a join with the first sets would compute it twice.
    return kept.withColumn("proxy_id", F.when(F.col("user_id").isNotNull(), first["id"]))


_SWEPT = ("first_user", "first_cents", "second_user", "second_cents")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per auction in time order: sets and stops change the live proxies; each record bid gets the best two live ones.

    A heap orders (maximum falling, proxy id) and is cleaned lazily; it is rebuilt from the live proxies when stale entries
    outnumber them, so memory follows the live proxies of one auction, not its events.
    """
    auction, live, heap = object(), {}, []
    for batch in batches:
        rows = batch.drop_columns(["record"]).to_pydict()
        out = {name: [] for name in _SWEPT}
        for at, kind, user, op, cents, proxy in zip(*(rows[c] for c in ("auction_id", "kind", "user_id", "op", "cents", "proxy_id"))):
            if at != auction:
                auction, live, heap = at, {}, []
            if kind == 0:
                if op == "set":
                    live[user] = (cents, proxy)
                    heapq.heappush(heap, (-cents, proxy, user))
                else:
                    live.pop(user, None)
                if len(heap) > 2 * len(live) + 16:
                    heap = [(-c, p, u) for u, (c, p) in live.items()]
                    heapq.heapify(heap)
                continue
            top: list[tuple[int, int, int]] = []
            while heap and len(top) < 2:
                entry = heapq.heappop(heap)
                if live.get(entry[2]) == (-entry[0], entry[1]) and all(entry[2] != t[2] for t in top):
                    top.append(entry)
            for entry in top:
                heapq.heappush(heap, entry)
            top += [(None, None, None)] * (2 - len(top))
            for name, (c, _, u) in zip(("first", "second"), top):
                out[f"{name}_user"].append(u)
                out[f"{name}_cents"].append(None if c is None else -c)
        record = batch.column("record").filter(pc.equal(batch.column("kind"), 1))
        yield pa.RecordBatch.from_arrays([record, *(pa.array(out[name], pa.int64()) for name in _SWEPT)], names=["record", *_SWEPT])


def best_two_as_of(records: DataFrame, events: DataFrame) -> DataFrame:
    """`records` (id, auction_id, created_at, ...) with first and second: the best two proxies live at each one's time.

    A set or stop at the same time as a bid is in effect for it; records without id are left out. Records travel whole, so that
    what finds them runs once. Each auction's events and bids are swept in one sorted
    stream; work and memory follow its live proxies, and a hot auction is streamed, not held.
    """
    record = F.struct(*records.columns)
    bids = records.where("id is not null").select(
        "auction_id", F.col("created_at").alias("at"), F.lit(1).alias("kind"), F.col("id").alias("key"), record.alias("record"))
    changes = events.select("auction_id", F.col("created_at").alias("at"), F.lit(0).alias("kind"), F.col("id").alias("key"),
                            "user_id", "op", (F.col("max_amount") * 100).cast("long").alias("cents"), "proxy_id")
    swept = (
        bids.unionByName(changes, allowMissingColumns=True).repartition("auction_id")
        .sortWithinPartitions("auction_id", "at", "kind", "key")
        .mapInArrow(_sweep, T.StructType([bids.schema["record"], *(T.StructField(name, T.LongType()) for name in _SWEPT)]))
    )

    def proxy(name: str) -> Column:
        return F.when(F.col(f"{name}_user").isNotNull(), F.struct(
            F.col(f"{name}_user").alias("user_id"), (F.col(f"{name}_cents") / 100).cast("decimal(10,2)").alias("max_amount")))

    return swept.select("record.*", proxy("first").alias("first"), proxy("second").alias("second"))


def interleaved_ledger(
    auctions: DataFrame, attempts: DataFrame, auto_bids: DataFrame | None = None, *, auto_log: DataFrame | None = None,
    lanes: int = 256, split: Split = DEFAULT,
) -> DataFrame:
    """The bids that result when all proxies reply to each accepted bid before the next attempt.

    Step 0 is the accepted attempt itself, steps from 1 its replies. The price never falls below
    an earlier contender, so only record bids can be accepted, and the price after an accepted
    one depends on it and the proxies alone. A record above every proxy's maximum meets no reply
    and beats all before it, so such records need no order and go to separate lanes. The others
    are followed in order of amount: records of one auction between its opening price and its
    best proxy's maximum, at most one per cent of that range however long its log is.

    With `auto_log` (set and stop rows) proxies answer only from their set to their next set or stop: each record meets
    the best two that are live at its time (`best_two_as_of`), and the lanes' ceiling is the highest maximum ever set.
    Without it, `auto_bids` holds for all time.
    """
    if auto_log is not None:
        events = valid_log(auto_log, auctions)
        ceilings = events.where(F.col("op") == "set").groupBy(F.col("auction_id").alias("id")).agg(F.max("max_amount").alias("top"))
    else:
        two = best_two(auto_bids)
        ceilings = two.select(F.col("auction_id").alias("id"), F.col("first.max_amount").alias("top"))
    ceiling = F.col("top")
    # Above the ceiling, the first contender at or above the buy-now price closes the auction.
    # When the buy-now price is below the ceiling that is one record at most, and whether it
    # still finds the auction open is decided in the lane of the contested ones.
    staged = (
        auctions.join(ceilings, "id", "left")
        .withColumn("asked", zero_to_null(F.col("buy_now_price")))
        .withColumn(
            "buy_now_price", F.when(F.col("asked").isNotNull(), F.greatest("asked", ceiling + F.lit(0.01).cast("decimal(10,2)")))
        )
    )
    odd, even = _turns(F.col("bidder_id"))
    apart = F.coalesce((F.col("amount") > ceiling) & ~F.coalesce(F.col("asked") <= ceiling, F.lit(False)), F.lit(True))
    buys = F.coalesce(F.col("amount") >= F.col("asked"), F.lit(False))
    found = lifecycle.record_bids(staged, attempts, keep=["top", "asked"], split=split)
    found = best_two_as_of(found, events) if auto_log is not None else found.join(two, "auction_id", "left")
    records = (
        found.withColumn("odd", odd)
        .withColumn("even", even)
        .select(
            "auction_id",
            F.when(apart, 1 + F.pmod(F.hash("id"), F.lit(lanes))).otherwise(0).alias("lane"),
            "id", "bidder_id", "created_at",
            (F.col("amount") * 100).cast("long").alias("cents"),
            F.when(buys, 0).otherwise(replies(F.col("amount"), F.col("odd"), F.col("even"))).alias("replies"),
            buys.alias("buys"),
            F.col("odd.user_id").alias("odd_user"),
            F.col("even.user_id").alias("even_user"),
        )
    )
    taken = (
        records.repartition("auction_id", "lane")
        .sortWithinPartitions("auction_id", "lane", "cents")
        .mapInPandas(_walk, _RECORD)
    )
    step = F.col("step")
    return taken.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("replies")))).select(
        "auction_id",
        F.col("id").alias("attempt_id"),
        "created_at",
        "step",
        F.when(step == 0, F.col("bidder_id"))
        .when(step % 2 == 1, F.col("odd_user"))
        .otherwise(F.col("even_user"))
        .alias("bidder_id"),
        (F.col("cents") / 100 + step).cast("decimal(10,2)").alias("amount"),
        (step > 0).alias("is_auto"),
    )
