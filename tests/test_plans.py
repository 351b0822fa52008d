"""What no plan may contain, whatever the data."""

import pytest

import __spark_entry__ as entry
from tests.test_named_queries import FOLDER

STREAMED = {"bid_stream", "stream_live_board", "stream_auction_price", "stream_auto_close", "stream_notices", "stream_unread",
            "rate_limit_stream"}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries().keys() - STREAMED))
def test_no_pairwise_join_and_no_global_window(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text
    # The first argument of a window is its partition key, or, without one, its ordering or frame.
    firsts = [part.split(",")[0] for part in text.split("windowspecdefinition(")[1:]]
    assert not [first for first in firsts if " ASC" in first or " DESC" in first or "frame" in first]


@pytest.mark.parametrize(
    "name", ["latest_bid_per_user", "latest_bid_per_bidder", "latest_notifications", "auto_bid_battle"]
)
def test_ranks_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(entry.queries()[name](spark, FOLDER))


@pytest.mark.parametrize("name, columns", [
    ("top_bidders", {"l_orderkey", "l_suppkey", "l_extendedprice"}),
    ("never_bid", {"l_orderkey", "l_suppkey"}),
])
def test_scans_read_the_needed_columns_only(spark, name, columns):
    text = plan(entry.queries()[name](spark, FOLDER))
    [lines] = {part.split(">")[0] for part in text.split("ReadSchema: struct<")[1:] if part.startswith("l_")}
    assert {field.split(":")[0] for field in lines.split(",")} == columns


def test_status_reaches_the_scan(spark):
    assert "In(o_orderstatus" in plan(entry.queries()["user_activity"](spark, FOLDER))


def test_orphans_compute_each_child_once(spark):
    from gavelspark.operators import quality

    users = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    lots = spark.createDataFrame([(1, 1, 9, None), (2, 8, None, 2)], "id long, seller_id long, category_id int, winner_id long")
    bids = spark.createDataFrame([(1, 1, 2), (2, 7, 1), (3, None, 8), (3, 7, 8)], "id long, auction_id long, bidder_id long")
    found = quality.orphans({"users": users, "auction_items": lots, "bids": bids})
    assert sorted(map(tuple, found.collect())) == [
        ("auction_items", "seller_id", 2, 8), ("bids", "auction_id", 2, 7), ("bids", "auction_id", 3, 7),
        ("bids", "bidder_id", 3, 8), ("bids", "bidder_id", 3, 8)]
    # Lots are a child and a parent, users a parent, bids a child.
    assert plan(found).split("== Initial Plan ==")[-1].count("Scan ExistingRDD") == 4


def test_the_proxy_sweep_computes_records_once(spark):
    from datetime import datetime
    from decimal import Decimal

    from gavelspark.operators import proxies

    at = lambda second: datetime(2000, 1, 1, 0, 0, second)
    records = spark.createDataFrame(
        [(7 * 2**56 + 1, 1, Decimal(5), at(1)), (2, 1, Decimal(6), at(3)), (3, 1, Decimal(7), at(5)), (4, 2, Decimal(1), at(5)), (None, 1, Decimal(9), at(6))],
        "id long, auction_id long, amount decimal(10,2), created_at timestamp_ntz")
    events = spark.createDataFrame(
        [(1, 1, 10, "set", Decimal(20), at(1), 1), (2, 1, 11, "set", Decimal(30), at(2), 2), (3, 1, 10, "stop", None, at(4), 1)],
        "id long, auction_id long, user_id long, op string, max_amount decimal(10,2), created_at timestamp_ntz, proxy_id long")
    swept = proxies.best_two_as_of(records, events)
    got = {r.id: (r.amount, r.first and tuple(r.first), r.second and tuple(r.second)) for r in swept.collect()}
    ten, eleven = (10, Decimal(20)), (11, Decimal(30))
    assert got == {7 * 2**56 + 1: (5, ten, None), 2: (6, eleven, ten), 3: (7, eleven, None), 4: (1, None, None)}
    assert plan(swept).split("== Initial Plan ==")[-1].count("Scan ExistingRDD") == 2
