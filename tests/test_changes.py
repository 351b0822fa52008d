from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gavelspark.operators import changes, reads

T0 = datetime(2000, 1, 1)


def at(second):
    return T0 + timedelta(seconds=second)


@pytest.fixture
def lots(spark):
    return spark.createDataFrame(
        [(1, 1, 1, "Phone", None, "/a.png", at(0), "active", 2, Decimal(10), Decimal(10)),
         (2, 2, 1, "Honda Civic", "car", None, at(0), "active", None, Decimal(10), Decimal(20)),
         (3, 1, 2, "Chair", "old", None, at(0), "closed", 3, Decimal(10), Decimal(30))],
        "id long, seller_id long, category_id int, title string, description string, image_url string, "
        "end_time timestamp_ntz, status string, winner_id long, starting_price decimal(10,2), current_price decimal(10,2)",
    )


@pytest.fixture
def users(spark):
    return spark.createDataFrame(
        [(1, "ann", "ann@x.y", "seller", "Ann", "1"), (2, "bob", "bob@x.y", "buyer", "Bob", None), (3, "eve", "e@x.y", "admin", "", "3")],
        "id long, username string, email string, role string, full_name string, phone string",
    )


WATCH = "id long, user_id long, auction_id long, op string, created_at timestamp_ntz"


def test_watch_upsert(spark, lots):
    log = [
        (1, 1, 1, "add", at(1)), (2, 1, 1, "add", at(5)),  # refreshed
        (3, 1, 2, "add", at(1)), (4, 1, 2, "remove", at(2)),  # gone
        (5, 2, 2, "add", at(1)), (6, 2, 2, "remove", at(2)), (7, 2, 2, "add", at(3)),  # a new row
        (8, 2, 9, "add", at(1)),  # unknown auction
        (9, 3, 1, "remove", at(1)), (10, 3, 1, "add", at(1)),  # same time, later id
    ]
    kept = changes.watch_upsert(spark.createDataFrame(log, WATCH), lots)
    assert {(r.user_id, r.auction_id): (r.id, r.created_at) for r in kept.collect()} == {
        (1, 1): (1, at(5)), (2, 2): (7, at(3)), (3, 1): (10, at(1)),
    }
    more = spark.createDataFrame([(20, 1, 1, "add", at(9)), (21, 2, 2, "remove", at(9))], WATCH)
    again = changes.watch_upsert(more, lots, kept)
    assert {(r.user_id, r.auction_id): (r.id, r.created_at) for r in again.collect()} == {
        (1, 1): (1, at(9)), (3, 1): (10, at(1)),
    }
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "user_id long, auction_id long")
    assert {r.auction_id: r.is_watching for r in reads.is_watching(pairs, again).collect()} == {1: True, 2: False}


def test_auto_bid_upsert(spark, lots):
    schema = "id long, auction_id long, user_id long, op string, max_amount decimal(10,2), created_at timestamp_ntz"
    log = [
        (1, 1, 5, "set", Decimal(11), at(1)), (2, 1, 5, "set", Decimal(15), at(2)), (3, 1, 5, "set", Decimal(10), at(3)),
        (4, 2, 5, "set", Decimal(25), at(1)), (5, 2, 5, "stop", None, at(2)),
        (6, 2, 6, "stop", None, at(1)), (7, 9, 6, "set", Decimal(25), at(1)),
        (8, 2, 7, "set", Decimal(25), at(1)), (9, 2, 7, "stop", None, at(2)), (10, 2, 7, "set", Decimal(30), at(3)),
    ]
    kept = changes.auto_bid_upsert(spark.createDataFrame(log, schema), lots)
    assert {(r.auction_id, r.user_id): (r.id, r.max_amount, r.is_active) for r in kept.collect()} == {
        (1, 5): (1, Decimal(15), True), (2, 5): (4, Decimal(25), False), (2, 7): (8, Decimal(30), True),
    }
    more = spark.createDataFrame(
        [(1, 2, 5, "set", Decimal(40), at(0)), (2, 2, 7, "stop", None, at(0)), (3, 1, 5, "set", Decimal(1), at(0))], schema
    )
    again = changes.auto_bid_upsert(more, lots, kept)
    assert {(r.auction_id, r.user_id): (r.id, r.max_amount, r.is_active) for r in again.collect()} == {
        (1, 5): (1, Decimal(15), True), (2, 5): (4, Decimal(40), True), (2, 7): (8, Decimal(30), False),
    }


def test_auction_patch(spark, lots, users):
    patches = spark.createDataFrame(
        [(1, 1, 1, at(1), "Phone X", None, "", None, None), (2, 1, 1, at(2), None, "", None, at(9), None),
         (3, 1, 2, at(3), "stolen", None, None, None, None), (4, 2, 3, at(1), None, None, None, None, "cancelled"),
         (5, 9, 3, at(1), "none", None, None, None, None)],
        "patch_id long, auction_id long, user_id long, created_at timestamp_ntz, title string, description string, "
        "image_url string, end_time timestamp_ntz, status string",
    )
    out = {r.id: (r.title, r.description, r.image_url, r.end_time, r.status) for r in
           changes.auction_patch(lots, patches, users).collect()}
    assert out == {
        1: ("Phone X", "", "/a.png", at(9), "active"), 2: ("Honda Civic", "car", None, at(0), "cancelled"),
        3: ("Chair", "old", None, at(0), "closed"),
    }


def test_profile_patch(spark, users):
    patches = spark.createDataFrame(
        [(1, 1, at(1), "Anna", None), (2, 1, at(2), None, "2"), (3, 2, at(1), "", None)],
        "patch_id long, user_id long, created_at timestamp_ntz, full_name string, phone string",
    ).withColumn("address", F.lit(None).cast("string"))
    out = {r.id: (r.full_name, r.phone) for r in changes.profile_patch(users, patches).collect()}
    assert out == {1: ("Anna", "2"), 2: ("", None), 3: ("", "3")}


NOTICE = "id long, user_id long, auction_id long, type string, message string, is_read boolean, created_at timestamp_ntz"


@pytest.fixture
def notices(spark):
    return spark.createDataFrame(
        [(1, 1, 1, "outbid", "m", False, at(1)), (2, 1, None, "outbid", "m", False, at(2)), (3, 2, 1, "outbid", "m", False, at(3)),
         (4, 2, 3, "auction_won", "m", True, at(4)), (5, 3, 2, "outbid", "m", False, at(5))], NOTICE,
    )


def test_mark_read(spark, notices):
    acks = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "user_id long, notification_id long")
    out = changes.mark_read(notices, acks)
    assert {r.id for r in out.collect() if r.is_read} == {1, 4, 5}
    assert {r.user_id: r.unread for r in reads.unread_count(out).collect()} == {1: 1, 2: 1, 3: 0}
    assert {r.id for r in reads.latest_notifications(out, 1).collect()} == {2, 4, 5}


@pytest.fixture
def tables(spark, lots, users, notices):
    bids = spark.createDataFrame(
        [(1, 1, 2), (2, 1, 3), (3, 2, 3), (4, 3, 2)], "id long, auction_id long, bidder_id long"
    )
    watch = spark.createDataFrame([(1, 1, 2), (2, 2, 1), (3, 3, 3)], "id long, user_id long, auction_id long")
    proxies = spark.createDataFrame([(1, 1, 2), (2, 2, 2), (3, 3, 3)], "id long, auction_id long, user_id long")
    return changes.Tables(users, lots, bids, watch, notices, proxies)


def ids(rows):
    return {r.id for r in rows.collect()}


def test_delete_auctions(spark, tables):
    requests = spark.createDataFrame([(1, 1), (3, 2), (2, 3), (9, 3)], "auction_id long, user_id long")
    left = changes.delete_auctions(tables, requests)
    assert ids(left.auctions) == {3} and ids(left.bids) == {4} and ids(left.watchlist) == {3} and ids(left.auto_bids) == {3}
    assert {r.id: r.auction_id for r in left.notifications.collect()} == {1: None, 2: None, 3: None, 4: 3, 5: None}


def test_delete_users(spark, tables):
    left = changes.delete_users(tables, spark.createDataFrame([(2,)], "user_id long"))
    assert ids(left.users) == {1, 3}
    assert {r.id: r.winner_id for r in left.auctions.collect()} == {1: None, 3: 3}
    assert ids(left.bids) == {2} and ids(left.watchlist) == {3} and ids(left.auto_bids) == {3}
    assert {r.id: r.auction_id for r in left.notifications.collect()} == {1: 1, 2: None, 5: None}


def test_delete_categories(spark, lots):
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id int, name string")
    requests = spark.createDataFrame([(1,), (3,)], "category_id int")
    assert {r.id: r.deleted for r in changes.delete_categories(names, lots, requests).collect()} == {1: False, 3: True}


def test_bulk_update_like(lots):
    out = changes.bulk_update_like(lots, "title", "%civic%", {"starting_price": F.lit(1200000), "image_url": F.lit("/c.png")})
    assert {r.id: (r.starting_price, r.image_url) for r in out.collect()} == {
        1: (Decimal(10), "/a.png"), 2: (Decimal(1200000), "/c.png"), 3: (Decimal(10), None),
    }
    assert dict(out.dtypes) == dict(lots.dtypes)
