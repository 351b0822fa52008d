"""Change logs applied to snapshots. Each operator is a function (snapshot, log) → new snapshot."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _turn() -> Column:
    """The place of a log row in its log."""
    return F.struct("created_at", "id")


def watch_upsert(log: DataFrame, auctions: DataFrame, watchlist: DataFrame | None = None) -> DataFrame:
    """Watchlist after a log of adds and removes (id, user_id, auction_id, op, created_at).

    A repeated add refreshes the time and keeps the row's id; an add after a remove is a new row.
    Adds to unknown auctions are refused.
    """
    key = ["user_id", "auction_id"]
    log = log.select("id", *key, "op", "created_at")
    if watchlist is not None:
        log = watchlist.select("id", *key, F.lit("add").alias("op"), "created_at").unionByName(log)
    add = F.col("op") == "add"
    per_key = log.groupBy(*key).agg(
        F.max(F.when(F.col("op") == "remove", _turn())).alias("removed"),
        F.min(F.when(add, _turn())).alias("first"), F.max(F.when(add, _turn())).alias("last"),
    )
    kept = per_key.where("removed is null and first is not null").select(*key, "first", "last")
    # Only where something was removed and added again the log is read for the first add after that.
    back = per_key.where("last > removed").select(*key, "removed")
    again = log.where(add).join(back, key).where(_turn() > F.col("removed")).groupBy(*key).agg(
        F.min(_turn()).alias("first"), F.max(_turn()).alias("last")
    )
    rows = kept.unionByName(again).select(*key, "first", F.col("last.created_at").alias("created_at"))
    known = auctions.select(F.col("id").alias("auction_id"))
    return rows.join(known, "auction_id", "left_semi").select(F.col("first.id").alias("id"), *key, "created_at")


def auto_bid_upsert(log: DataFrame, auctions: DataFrame, auto_bids: DataFrame | None = None) -> DataFrame:
    """Proxies after a log of `set` and `stop` rows (id, auction_id, user_id, op, max_amount, created_at).

    A set replaces the maximum and reactivates, keeping the id of the first; it is refused where
    the auction is unknown or the maximum is not above the current price.
    """
    key = ["auction_id", "user_id"]
    columns = ["id", *key, "op", "max_amount", "created_at", "checked"]
    log = log.withColumn("checked", F.lit(True)).select(*columns)
    if auto_bids is not None:
        stored = auto_bids.select(
            "id", *key, F.when(F.col("is_active"), "set").otherwise("kept").alias("op"), "max_amount", "created_at",
            F.lit(False).alias("checked"),
        )
        log = stored.unionByName(log)
    prices = auctions.select(F.col("id").alias("auction_id"), "current_price")
    valid = log.join(prices, "auction_id").where(F.col("current_price").isNotNull()).where(
        ~F.col("checked") | (F.col("op") == "stop") | (F.col("max_amount") > F.col("current_price"))
    )
    # Dealt out anew by the finer key: else the grouping would keep the placement by auction, and a hot one could not be split.
    valid = valid.repartition(*key)
    states = F.col("op") != "stop"
    latest_set = F.max(F.when(states, F.struct("checked", "created_at", "id", "max_amount"))).alias("set")
    return (
        valid.groupBy(*key)
        .agg(
            latest_set,
            F.min(F.when(states, F.struct("checked", "created_at", "id"))).alias("first"),
            F.max(F.struct("checked", "created_at", "id", "op")).alias("last"),
        )
        .where(F.col("set").isNotNull())
        .select(
            F.col("first.id").alias("id"), *key, F.col("set.max_amount").alias("max_amount"),
            (F.col("last.op") == "set").alias("is_active"), F.col("first.created_at").alias("created_at"),
        )
    )


def _latest(columns: list[str]) -> list[Column]:
    """Of several patches to a column, the last that is not NULL."""
    return [F.max(F.when(F.col(c).isNotNull(), F.struct("created_at", "patch_id", c))).alias(f"new_{c}") for c in columns]


def _overlay(table: DataFrame, latest: DataFrame, columns: list[str]) -> DataFrame:
    """COALESCE(patch, old) per column."""
    once = latest.groupBy("id").agg(*(F.max(f"new_{c}").alias(f"new_{c}") for c in columns))
    joined = table.join(once, "id", "left")
    return joined.select(
        *(F.coalesce(F.col(f"new_{c}")[c], F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns)
    )


def auction_patch(auctions: DataFrame, patches: DataFrame, users: DataFrame) -> DataFrame:
    """Apply (patch_id, auction_id, user_id, created_at, new values) of owners and admins.

    NULL keeps what is stored, an empty text is a value; an empty image counts as none given.
    """
    columns = ["title", "description", "image_url", "end_time", "status"]
    given = patches.withColumn("image_url", F.nullif("image_url", F.lit("")))
    by_author = given.groupBy("auction_id", "user_id").agg(*_latest(columns))
    return _overlay(auctions, _authorised(by_author, auctions, users).withColumnRenamed("auction_id", "id"), columns)


def _authorised(requests: DataFrame, auctions: DataFrame, users: DataFrame) -> DataFrame:
    """The (auction_id, user_id) requests made by the auction's owner or an admin."""
    own = auctions.select(F.col("id").alias("auction_id"), F.col("seller_id").alias("user_id"))
    admins = users.where(F.col("role") == "admin").select(F.col("id").alias("user_id"))
    known = auctions.select(F.col("id").alias("auction_id"))
    by_owners = requests.join(own, ["auction_id", "user_id"], "left_semi")
    by_admins = requests.join(admins, "user_id", "left_semi").join(known, "auction_id", "left_semi")
    return by_owners.unionByName(by_admins.join(own, ["auction_id", "user_id"], "left_anti"))


def profile_patch(users: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply (patch_id, user_id, created_at, new values) to the columns users may change themselves."""
    columns = [c for c in ("full_name", "phone", "address", "password_hash") if c in users.columns]
    latest = patches.groupBy(F.col("user_id").alias("id")).agg(*_latest(columns))
    return _overlay(users, latest, columns)


def mark_read(notifications: DataFrame, acks: DataFrame) -> DataFrame:
    """Apply acknowledgements (user_id, notification_id): of one notice, or of all where it is NULL."""
    one = acks.where(F.col("notification_id").isNotNull()).select(
        F.col("notification_id").alias("id"), "user_id", F.lit(True).alias("seen")
    ).distinct()
    every = acks.where(F.col("notification_id").isNull()).select("user_id", F.lit(True).alias("seen_all")).distinct()
    read = F.col("is_read") | F.col("seen").isNotNull() | F.col("seen_all").isNotNull()
    return (
        notifications.join(one, ["id", "user_id"], "left")
        .join(every, "user_id", "left")
        .withColumn("is_read", read)
        .select(*notifications.columns)
    )


@dataclass(frozen=True)
class Tables:
    """The tables a delete can reach; those that depend on users and auctions may be left out."""

    users: DataFrame
    auctions: DataFrame
    bids: DataFrame | None = None
    watchlist: DataFrame | None = None
    notifications: DataFrame | None = None
    auto_bids: DataFrame | None = None


def _without(rows: DataFrame | None, column: str, gone: DataFrame) -> DataFrame | None:
    if rows is None:
        return None
    return rows.join(gone.select(F.col("id").alias(column)), column, "left_anti").select(*rows.columns)


def _cleared(rows: DataFrame | None, column: str, gone: DataFrame) -> DataFrame | None:
    """References to what is gone become NULL."""
    if rows is None:
        return None
    lost = gone.select(F.col("id").alias(column), F.lit(True).alias("lost")).distinct()
    return rows.join(lost, column, "left").withColumn(
        column, F.when(F.col("lost").isNull(), F.col(column))
    ).select(*rows.columns)


def _drop_auctions(tables: Tables, gone: DataFrame) -> Tables:
    return replace(
        tables,
        auctions=_without(tables.auctions, "id", gone),
        bids=_without(tables.bids, "auction_id", gone),
        watchlist=_without(tables.watchlist, "auction_id", gone),
        auto_bids=_without(tables.auto_bids, "auction_id", gone),
        notifications=_cleared(tables.notifications, "auction_id", gone),
    )


def delete_auctions(tables: Tables, requests: DataFrame) -> Tables:
    """Delete as owners and admins asked (auction_id, user_id), with what depends on an auction."""
    granted = _authorised(requests, tables.auctions, tables.users)
    return _drop_auctions(tables, granted.select(F.col("auction_id").alias("id")).distinct())


def delete_users(tables: Tables, requests: DataFrame) -> Tables:
    """Delete users (user_id): their auctions and rows go, auctions they won keep no winner."""
    gone = requests.select(F.col("user_id").alias("id")).distinct()
    listed = tables.auctions.join(gone.withColumnRenamed("id", "seller_id"), "seller_id", "left_semi").select("id")
    left = _drop_auctions(tables, listed)
    return replace(
        left,
        users=_without(left.users, "id", gone),
        auctions=_cleared(left.auctions, "winner_id", gone),
        bids=_without(left.bids, "bidder_id", gone),
        watchlist=_without(left.watchlist, "user_id", gone),
        auto_bids=_without(left.auto_bids, "user_id", gone),
        notifications=_without(left.notifications, "user_id", gone),
    )


def delete_categories(categories: DataFrame, auctions: DataFrame, requests: DataFrame) -> DataFrame:
    """The requested categories with whether they could go: one that is used stays."""
    used = auctions.select(F.col("category_id").alias("id")).distinct().withColumn("used", F.lit(True))
    return (
        categories.join(requests.select(F.col("category_id").alias("id")).distinct(), "id", "left_semi")
        .join(used, "id", "left")
        .select("id", "name", F.col("used").isNull().alias("deleted"))
    )


def bulk_update_like(rows: DataFrame, column: str, pattern: str, values: dict[str, Column]) -> DataFrame:
    """Set columns where a text matches a LIKE pattern, case aside."""
    matches = F.col(column).ilike(pattern)
    kinds = dict(rows.dtypes)
    return rows.select(
        *(
            F.when(matches, values[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in rows.columns
        )
    )
