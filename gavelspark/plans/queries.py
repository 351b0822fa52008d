"""Every operator as a named query over the whole tables of a data folder.

Bids that are read without their leading flag are taken as `attempts`, which saves deriving it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelspark.operators import admission, changes, lifecycle, proxies, quality, reads, reports
from gavelspark.sources.mapped import AuctionData
from gavelspark.sources.samples import sample
from gavelspark.streaming import runs

DAY = 86_400

Query = Callable[[AuctionData], DataFrame]


def _tables(d: AuctionData, table: str) -> changes.Tables:
    """What a delete needs to give the new state of `table`."""
    dependent = {table: getattr(d, table)} if table not in ("users", "auctions") else {}
    return changes.Tables(d.users, d.auction_items, **dependent)


def _lines(rows: DataFrame, *columns: str) -> DataFrame:
    """Errors as one text, so that results compare across engines."""
    return rows.select(*columns, F.concat_ws(" | ", "errors").alias("errors"), "error")


def _resumed(d: AuctionData) -> tuple[DataFrame, DataFrame]:
    """The log in two runs, the second going on from what the first one left."""
    cut = F.lit("1995-06-17").cast("timestamp_ntz")
    return lifecycle.resumed(d.opening, [d.attempts.where(F.col("created_at") < cut), d.attempts.where(F.col("created_at") >= cut)])


def _validated(kind: str, source: str) -> Query:
    return lambda d: _lines(quality.validate_rows(sample(d, source), quality.RULES[kind]), "id")


def _deleted_auctions(table: str) -> Query:
    return lambda d: getattr(changes.delete_auctions(_tables(d, table), sample(d, "auction_deletions")), table)


def _deleted_users(table: str) -> Query:
    return lambda d: getattr(changes.delete_users(_tables(d, table), sample(d, "user_deletions")), table)


REPORTS: dict[str, Query] = {
    "active_by_end": lambda d: reports.active_by_end(d.auction_items),
    "recent_users": lambda d: reports.recent_users(d.users, d.as_of),
    "bids_for_auction": lambda d: reports.bids_for_auction(d.bids, d.users, d.auction_items),
    "ending_soon": lambda d: reports.ending_soon(d.auction_items, d.as_of),
    "keyword_search": lambda d: reports.keyword_search(d.auction_items, d.categories, "urgent"),
    "auction_full": lambda d: reports.auction_full(d.auction_items, d.users, d.categories),
    "bid_history_full": lambda d: reports.bid_history_full(d.bids, d.auction_items, d.users),
    "highest_bidder": lambda d: reports.highest_bidder(d.auction_items, d.bids, d.users),
    "user_activity": lambda d: reports.user_activity(d.users, d.attempts),
    "category_stats": lambda d: reports.category_stats(d.categories, d.auction_items),
    "top_bidders": lambda d: reports.top_bidders(d.users, d.attempts),
    "most_competitive": lambda d: reports.most_competitive(d.auction_items, d.users, d.categories),
    "category_avg_bids": lambda d: reports.category_avg_bids(d.categories, d.auction_items),
    "dual_participants": lambda d: reports.dual_participants(d.users, d.auction_items, d.attempts),
    "seller_revenue": lambda d: reports.seller_revenue(d.users, d.auction_items),
    "above_average": lambda d: reports.above_average(d.auction_items),
    "never_bid": lambda d: reports.never_bid(d.users, d.attempts),
    "unique_bidders": lambda d: reports.unique_bidders(d.auction_items, d.attempts),
    "latest_bid_per_user": lambda d: reports.latest_bid_per_user(d.attempts, d.users, d.auction_items),
    "self_bids": lambda d: reports.self_bids(d.attempts, d.auction_items, d.users),
    "overdue_active": lambda d: reports.overdue_active(d.auction_items, d.as_of),
    "winner_report": lambda d: reports.winner_report(d.auction_items, d.users),
    "most_active": lambda d: reports.most_active(d.auction_items, d.categories, d.users, d.attempts),
    "winning_investment": lambda d: reports.winning_investment(d.users, d.bids),
    "category_volume": lambda d: reports.category_volume(d.categories, d.auction_items),
}

READS: dict[str, Query] = {
    "v_active_auctions": lambda d: reads.active_listing(d.auction_items, d.users, d.categories),
    "v_bid_history": lambda d: reads.bid_history(d.bids, d.users, d.auction_items),
    "v_top_bidders": lambda d: reads.bidder_ranking(d.users, d.attempts),
    "catalogue": lambda d: reads.catalogue(
        d.auction_items, d.users, d.categories, status="active", search="urgent"
    ),
    "auction_detail": lambda d: reads.auction_detail(d.auction_items, d.users, d.categories),
    "latest_bid_per_bidder": lambda d: reads.latest_bid_per_bidder(d.bids, d.users),
    "my_bids": lambda d: reads.my_bids(d.bids, d.auction_items, d.users),
    "my_auctions": lambda d: reads.my_auctions(d.auction_items, d.categories, d.users),
    "all_bids": lambda d: reads.all_bids(d.bids, d.users, d.auction_items),
    "all_users": lambda d: reads.all_users(d.users),
    "profile": lambda d: reads.profile(d.users),
    "all_auctions": lambda d: reads.all_auctions(d.auction_items, d.users, d.categories),
    "watchlist_items": lambda d: reads.watchlist_items(d.watchlist, d.auction_items, d.categories),
    "is_watching": lambda d: reads.is_watching(sample(d, "watch_pairs"), d.watchlist),
    "notification_feed": lambda d: reads.notification_feed(d.notifications, d.auction_items),
    "unread_count": lambda d: reads.unread_count(d.notifications),
    "latest_notifications": lambda d: reads.latest_notifications(d.notifications),
    "featured": lambda d: reads.featured(d.auction_items, d.users, d.categories),
    "active_auto_bid": lambda d: reads.active_auto_bid(changes.auto_bid_upsert(sample(d, "auto_log"), d.opening)),
    "identity_conflicts": lambda d: reads.identity_conflicts(
        sample(d, "signups").select("id", "username", "email"), d.users
    ),
}

LIFECYCLE: dict[str, Query] = {
    "bid_replay": lambda d: d.replay.drop("title", "seller_id"),
    "place_bid_rules": lambda d: lifecycle.place_bid_rules(d.opening, d.attempts),
    "winning_flags": lambda d: lifecycle.winning_flags(lifecycle.accepted_bids(d.replay)),
    "resolve_expired": lambda d: lifecycle.resolve_expired(d.auction_items, d.bids, d.as_of),
    "close_and_repair": lambda d: lifecycle.close_and_repair(d.auction_items, d.bids, d.as_of),
    "auto_close": lambda d: lifecycle.auto_close(d.auction_items, d.bids, d.users, d.as_of),
    "auto_close_events": lambda d: lifecycle.auto_close_events(d.auction_items, d.bids, d.users, d.as_of),
    "auto_close_notices": lambda d: lifecycle.auto_close_notices(d.auction_items, d.bids, d.users, d.as_of),
    "auctions_after": lambda d: lifecycle.auctions_after(d.auction_items, d.replay),
    "replay_resumed": lambda d: _resumed(d)[0].drop("title", "seller_id", "is_winning"),
    "auctions_resumed": lambda d: _resumed(d)[1],
    "buy_now_close": lambda d: lifecycle.buy_now_close(d.replay),
    "outbid_notices": lambda d: lifecycle.outbid_notices(d.replay),
    "won_notices": lambda d: lifecycle.won_notices(d.auction_items.where(F.col("status") == "closed"), d.as_of),
    "auto_bid_battle": lambda d: proxies.auto_bid_battle(
        d.auction_items, d.auto_bids, d.bids.where("is_winning")
    ),
    "auto_bid_activate": lambda d: proxies.auto_bid_activate(d.auction_items, d.bids, sample(d, "proxy_requests")),
    "auto_bid_interleaved": lambda d: proxies.interleaved_ledger(d.opening, d.attempts, auto_log=sample(d, "proxy_log")),
    "new_auctions": lambda d: lifecycle.new_auctions(sample(d, "submissions"), d.as_of),
    "time_left": lambda d: lifecycle.time_left(d.auction_items, d.as_of),
}

CHANGES: dict[str, Query] = {
    "watch_upsert": lambda d: d.watchlist,
    "auto_bid_upsert": lambda d: changes.auto_bid_upsert(sample(d, "auto_log"), d.opening),
    "auction_patch": lambda d: changes.auction_patch(d.auction_items, sample(d, "auction_patches"), d.users),
    "profile_patch": lambda d: changes.profile_patch(d.users, sample(d, "profile_patches")),
    "mark_read": lambda d: changes.mark_read(d.notifications, sample(d, "acks")),
    "delete_auctions": _deleted_auctions("auctions"),
    "delete_auctions_bids": _deleted_auctions("bids"),
    "delete_auctions_watchlist": _deleted_auctions("watchlist"),
    "delete_auctions_auto_bids": _deleted_auctions("auto_bids"),
    "delete_auctions_notifications": _deleted_auctions("notifications"),
    "delete_users": _deleted_users("users"),
    "delete_users_auctions": _deleted_users("auctions"),
    "delete_users_bids": _deleted_users("bids"),
    "delete_users_watchlist": _deleted_users("watchlist"),
    "delete_users_auto_bids": _deleted_users("auto_bids"),
    "delete_users_notifications": _deleted_users("notifications"),
    "delete_categories": lambda d: changes.delete_categories(
        d.categories, d.auction_items, sample(d, "category_deletions")
    ),
    "bulk_update_like": lambda d: changes.bulk_update_like(
        d.auction_items, "title", "%urgent%",
        {"starting_price": F.lit(1200000), "current_price": F.lit(1200000), "image_url": F.lit("/uploads/urgent.png")},
    ),
}

QUALITY: dict[str, Query] = {
    "validate_rows": _validated("auction", "submitted"),
    "validate_register": _validated("register", "signups"),
    "validate_login": _validated("login", "signups"),
    "validate_bid": _validated("bid", "typed_bids"),
    "validate_profile": _validated("profile", "signups"),
    "validate_auction_form": lambda d: quality.validate_auction_form(sample(d, "submitted"), d.as_of).select("id", "error"),
    "validate_register_form": lambda d: sample(d, "signups").select("id", quality.register_form().alias("error")),
    "validate_login_form": lambda d: sample(d, "signups").select("id", quality.login_form().alias("error")),
    "validate_bid_form": lambda d: sample(d, "typed_bids").select(
        "id", quality.bid_form(F.col("current_price")).alias("error")
    ),
    "validate_profile_form": lambda d: sample(d, "signups").select("id", quality.profile_form().alias("error")),
    "key_violations": lambda d: quality.key_violations({
        "categories": d.categories, "users": sample(d, "repeated_users"), "bids": d.bids,
        "watchlist": d.watch_log, "auto_bids": d.auto_bids,
    }),
    "orphans": lambda d: quality.orphans({
        "categories": d.categories, "users": d.users.where("is_active"),
        "auction_items": d.auction_items.where(F.col("status") != "cancelled"), "bids": d.bids,
        "watchlist": d.watchlist, "notifications": d.notifications, "auto_bids": d.auto_bids,
    }),
    "domain_violations": lambda d: quality.domain_violations({
        "categories": d.categories, "users": sample(d, "damaged_users"),
        "auction_items": sample(d, "damaged_auctions"), "bids": sample(d, "damaged_bids"),
        "notifications": d.notifications,
    }),
    "business_violations": lambda d: quality.business_violations(sample(d, "damaged_auctions"), d.replay),
    "missing_winner": lambda d: quality.missing_winner(d.auction_items),
    "counter_drift": lambda d: quality.counter_drift(
        d.auction_items, lifecycle.accepted_bids(d.replay).select("auction_id", "amount", "is_winning")
    ),
    "rate_limit": lambda d: admission.rate_limit(d.requests, 2, DAY),
    "rate_limit_register": lambda d: admission.guarded(d.requests, "register"),
}

STREAMS: dict[str, Query] = {
    "bid_stream": runs.bid_events,
    "stream_live_board": runs.live_board,
    "stream_auction_price": runs.auction_price,
    "stream_auto_close": runs.expiry_events,
    "stream_listings": runs.listing_events,
    "stream_notices": runs.notices,
    "stream_unread": runs.unread,
    "stream_unread_read": runs.unread_after_reads,
    "rate_limit_stream": lambda d: runs.admitted(d, 2, DAY),
}

ALL: dict[str, Query] = {**REPORTS, **READS, **LIFECYCLE, **CHANGES, **QUALITY, **STREAMS}


def on_folder(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: query(AuctionData(spark, folder))
