from datetime import timedelta
from decimal import Decimal

import pytest

from gavelspark.functions.times import naive
from gavelspark.operators import lifecycle
from gavelspark.operators.splitting import DEFAULT, Split
from tests.machine import ATTEMPT, AUCTION, START, play, random_world

# Cuts every group of more than three rows, so that slices and what they carry are exercised.
CUT = Split(min_rows=3, share=1_000_000, fan=3)


def played(lots, log):
    by_lot = {lot[0]: ([], lot) for lot in lots}
    for attempt in log:
        by_lot[attempt[1]][0].append(attempt)
    outcomes, prices, winning = {}, {}, set()
    for attempts, lot in by_lot.values():
        result, bids, before = play(lot, attempts)
        outcomes.update(result)
        prices.update(before)
        if bids:
            winning.add(bids[-1][0])
    return outcomes, prices, winning


@pytest.mark.parametrize("split", [DEFAULT, CUT], ids=["whole", "cut"])
@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_one_request_at_a_time(spark, seed, split):
    lots, log, _ = random_world(seed)
    replay = lifecycle.bid_replay(
        spark.createDataFrame(lots, AUCTION), spark.createDataFrame(log, ATTEMPT), split=split
    ).collect()
    outcomes, prices, winning = played(lots, log)
    assert {r.id: r.outcome for r in replay} == outcomes
    assert {r.id: r.price_before for r in replay} == prices
    assert {r.id for r in replay if r.is_winning} == winning


def lot(n, **changed):
    row = dict(
        id=n, seller_id=1, title=f"lot {n}", starting_price=Decimal(10), current_price=Decimal(10), buy_now_price=None,
        end_time=START + timedelta(seconds=100), status="active",
    )
    return tuple({**row, **changed}.values())


def bid(n, auction, bidder, amount, second):
    return (n, auction, bidder, None if amount is None else Decimal(str(amount)), START + timedelta(seconds=second))


def test_boundaries(spark):
    lots = [
        lot(1), lot(2, buy_now_price=Decimal(50)), lot(3, buy_now_price=Decimal(5)), lot(4, status="upcoming"), lot(5),
    ]
    log = [
        bid(1, 1, 2, 10, 1),  # equal to the price
        bid(2, 1, 2, "10.01", 2),
        bid(3, 1, 2, 11, 3),  # raises itself
        bid(4, 1, 1, 99, 4),  # the seller
        bid(5, 1, 3, 12, 100),  # exactly at the end
        bid(6, 1, 3, 13, 101),  # late
        bid(7, 1, 3, 14, 102),  # after the late one closed it
        bid(8, 2, 2, 50, 1),  # equal to buy-now
        bid(9, 2, 3, 60, 2),
        bid(10, 3, 2, 9, 1),  # above buy-now, below the price
        bid(11, 3, 2, 11, 2),
        bid(12, 4, 2, 11, 1),
        bid(13, 99, 2, 11, 1),
        bid(14, 5, 2, None, 1),
        bid(15, None, 2, 11, 1),
        bid(16, 5, 2, 0, 1),
        bid(17, 5, 2, 20, 5), bid(18, 5, 3, 20, 5),  # same time and amount
    ]
    replay = lifecycle.bid_replay(spark.createDataFrame(lots, AUCTION), spark.createDataFrame(log, ATTEMPT))
    assert {r.id: r.outcome for r in replay.collect()} == {
        1: "low", 2: "ok", 3: "ok", 4: "self", 5: "ok", 6: "ended", 7: "not_active", 8: "ok", 9: "not_active", 10: "low",
        11: "ok", 12: "not_active", 13: "unknown_auction", 14: "invalid", 15: "invalid", 16: "invalid", 17: "ok", 18: "low",
    }
    bought = {r.auction_id: (r.winner_id, r.final_price) for r in lifecycle.buy_now_close(replay).collect()}
    assert bought == {2: (2, Decimal(50)), 3: (2, Decimal(11))}
    notices = {r.id: (r.user_id, r.message) for r in lifecycle.outbid_notices(replay).collect()}
    assert notices == {10: (2, "You've been outbid on \"lot 1\"! New price: ₹12.00")}


def test_short_rules(spark):
    lots = [lot(1), lot(4, status="closed")]
    log = [bid(1, 1, 2, 20, 500), bid(2, 1, 1, 30, 501), bid(3, 1, 3, 20, 502), bid(4, 4, 2, 30, 1), bid(5, 9, 2, 30, 1)]
    results = lifecycle.place_bid_rules(spark.createDataFrame(lots, AUCTION), spark.createDataFrame(log, ATTEMPT))
    assert {r.id: r.result.split(":")[0] + ("*" if r.is_winning else "") for r in results.collect()} == {
        1: "SUCCESS*", 2: "ERROR", 3: "ERROR", 4: "ERROR", 5: "unknown_auction",
    }


SNAPSHOT = AUCTION + ", winner_id long, total_bids int"
BID = "id long, auction_id long, bidder_id long, amount decimal(10,2), is_winning boolean"


def closing_world(spark):
    end = START + timedelta(seconds=100)
    lots = [
        lot(1, end_time=end) + (None, 2),  # ends exactly now
        lot(2, end_time=end - timedelta(seconds=1)) + (None, 2),  # two winning rows
        lot(3, end_time=end - timedelta(seconds=1)) + (None, 0),  # no bids
        lot(4, status="closed") + (None, 1),  # closed without its winner
        lot(5, end_time=end + timedelta(seconds=1)) + (None, 1),
    ]
    bids = [
        (1, 1, 7, Decimal(20), True), (2, 1, 8, Decimal(15), False), (3, 2, 7, Decimal(20), True),
        (4, 2, 8, Decimal(20), True), (5, 4, 9, Decimal(12), True), (6, 5, 9, Decimal(12), True),
    ]
    users = [(n, f"user {n}") for n in (7, 8, 9)]
    return (
        spark.createDataFrame(lots, SNAPSHOT), spark.createDataFrame(bids, BID),
        spark.createDataFrame(users, "id long, username string"), naive(end),
    )


def states(rows):
    return {r.id: (r.status, r.winner_id) for r in rows.collect()}


def test_closing(spark):
    lots, bids, users, now = closing_world(spark)
    assert states(lifecycle.resolve_expired(lots, bids, now)) == {
        1: ("closed", 7), 2: ("closed", 8), 3: ("closed", None), 4: ("closed", None), 5: ("active", None),
    }
    assert states(lifecycle.close_and_repair(lots, bids, now)) == {
        1: ("active", None), 2: ("closed", 8), 3: ("closed", None), 4: ("closed", 9), 5: ("active", None),
    }
    assert states(lifecycle.auto_close(lots, bids, users, now)) == {
        1: ("active", None), 2: ("closed", 8), 3: ("closed", None), 4: ("closed", None), 5: ("active", None),
    }
    events = {r.auction_id: (r.winner_name, r.final_price, r.message) for r in
              lifecycle.auto_close_events(lots, bids, users, now).collect()}
    assert events == {2: ("user 8", Decimal(20), None), 3: (None, Decimal(0), "Auction ended with no bids")}
    [won] = lifecycle.auto_close_notices(lots, bids, users, now).collect()
    assert (won.user_id, won.message) == (8, 'Congratulations! You won "lot 2" for ₹20.00')


def test_time_left_labels(spark):
    def labels(**left):
        end = START + timedelta(**left)
        [row] = lifecycle.time_left(spark.createDataFrame([lot(1, end_time=end)], AUCTION), naive(START)).collect()
        return row.card, row.listing, row.dashboard, row.countdown

    assert labels(seconds=0) == ("Ended", "Ended", "Ended", "Auction Ended")
    assert labels(hours=24, seconds=5) == ("24h 0m 5s", "24h 0m left", "24h 0m left", "1d 0h 0m 5s")
    assert labels(hours=76, minutes=5) == ("3d 4h left", "3d left", "76h 5m left", "3d 4h 5m 0s")
    assert labels(minutes=61) == ("1h 1m 0s", "1h 1m left", "1h 1m left", "1h 1m 0s")
