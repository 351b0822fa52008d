"""The streams run over a whole stored log to its end."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.streaming import boards, desk, limiter, logs, reading

if TYPE_CHECKING:
    from gavelspark.sources.mapped import AuctionData


def _streamed(rows: DataFrame, name: str) -> DataFrame:
    return logs.read_log(rows.sparkSession, logs.stage(rows, name), rows.schema)


# How far out of order the logs are that are run here: not at all, they are staged in order of time.
LATENESS = "1 second"


def _stored(d: AuctionData) -> DataFrame:
    """The log written once, as staging reads it several times and its join costs more than that."""
    return d.spark.read.schema(d.attempts.schema).parquet(logs.stage(d.attempts, "log"))


def _end(log: DataFrame, like: DataFrame) -> DataFrame:
    """A row of the columns of `like` that only moves the time past the whole log; none for an empty log."""
    last = log.agg(F.max("created_at").alias("last"))
    after = F.col("last") + F.expr("interval 2 seconds")
    row = [after.alias(f.name) if f.name == "created_at" else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema]
    return last.where("last is not null").select(*row)


def _attempts(d: AuctionData, log: DataFrame | None = None) -> DataFrame:
    """The log as a stream of a few batches in order of time, ended by a row that only moves the time past all of them."""
    log = _stored(d) if log is None else log
    folder = logs.stage_in_order(log, "created_at", "attempts", end=_end(log, log))
    return logs.read_log(d.spark, folder, log.schema, files_per_trigger=logs.FILES_PER_TRIGGER)


def _changes(d: AuctionData, log: DataFrame) -> DataFrame:
    """Listings, patches and deletions as a stream in order of time, ended like the attempts by a row that moves the time."""
    from gavelspark.sources.samples import sample

    rows = sample(d, "auction_changes")
    folder = logs.stage_in_order(rows, "created_at", "changes", end=_end(log, rows))
    return logs.read_log(d.attempts.sparkSession, folder, rows.schema, files_per_trigger=logs.FILES_PER_TRIGGER)


def listing_events(d: AuctionData) -> DataFrame:
    """A ruling for every attempt while auctions are listed, patched and deleted on the same stream."""
    log = _stored(d)
    return logs.append_run(desk.listing_events(_attempts(d, log), _changes(d, log), d.opening, LATENESS), "listings")


def bid_events(d: AuctionData) -> DataFrame:
    return logs.append_run(desk.bid_events(_attempts(d), d.opening, LATENESS), "bid-events")


def expiry_events(d: AuctionData) -> DataFrame:
    """What closes because the stream's time passed the end, not because of a bid."""
    events = desk.bid_events(_attempts(d), d.opening, LATENESS, close_on_expiry=True)
    return logs.append_run(events, "expiry").where(
        (F.col("event_type") == "auction-closed") & F.col("bid_id").isNull()
    ).select("event_type", "auction_id", "user_id", "amount", "at", "auction_title", "message")


def _notices(d: AuctionData, log: DataFrame | None = None, with_id: bool = False) -> DataFrame:
    events = desk.bid_events(_attempts(d, log), d.opening, LATENESS, close_on_expiry=True)
    return desk.notices(events, with_id)


def notices(d: AuctionData) -> DataFrame:
    """Notices to displaced leaders, and to the winners of auctions that time closes."""
    return logs.append_run(_notices(d), "notices")


def _told(notices: DataFrame) -> DataFrame:
    """The stored output of a notice stream, as a stream."""
    return logs.read_log(notices.sparkSession, logs.appended(notices, "notices"), notices.schema)


def unread(d: AuctionData) -> DataFrame:
    """Unread notices per user, counted from the stored output of the notice stream."""
    return logs.update_run(boards.unread(_told(_notices(d))), ["user_id"], "unread")


def unread_after_reads(d: AuctionData) -> DataFrame:
    """Unread notices per user while acknowledgements (one notice, or all up to a time) stream in beside them."""
    from gavelspark.sources.samples import sample

    log = _stored(d)
    told = _told(_notices(d, log, with_id=True))
    last = log.agg(F.max("created_at")).first()[0]
    acks = sample(d, "acks").select(
        "user_id", "notification_id", (F.lit(last).cast("timestamp_ntz") + F.expr("interval 1 day")).alias("created_at"),
    )
    return logs.update_run(reading.unread_with_reads(told, _streamed(acks, "acks")), ["user_id"], "unread-read")


def live_board(d: AuctionData) -> DataFrame:
    newest = boards.newest_bids(_streamed(d.attempts, "attempts"))
    return boards.board(logs.update_run(newest, ["auction_id", "bidder_id"], "board"))


def auction_price(d: AuctionData) -> DataFrame:
    return logs.update_run(boards.prices(_streamed(d.attempts, "attempts")), ["auction_id"], "prices")


def admitted(d: AuctionData, limit: int, seconds: int) -> DataFrame:
    return logs.append_run(limiter.rate_limit(_streamed(d.requests, "requests"), limit, seconds), "admission")
