from datetime import timedelta
from decimal import Decimal

import pytest

from gavelspark.operators import proxies
from gavelspark.operators.splitting import DEFAULT, Split
from tests.machine import ATTEMPT, AUCTION, PROXY, START, battle, play, random_world

CUT = Split(min_rows=3, share=1_000_000, fan=3)


@pytest.mark.parametrize("seed", range(4))
def test_battle_equals_simulation(spark, seed):
    lots, _, rivals = random_world(seed, auctions=150)
    last = {lot[0]: (lot[0] + seed) % 6 for lot in lots}
    made = proxies.auto_bid_battle(
        spark.createDataFrame(lots, AUCTION), spark.createDataFrame(rivals, PROXY),
        spark.createDataFrame(list(last.items()), "auction_id long, bidder_id long"),
    ).orderBy("auction_id", "step").collect()
    expected = [
        (lot[0], n + 1, user, amount)
        for lot in lots if lot[7] == "active"
        for n, (user, amount) in enumerate(battle(lot[4], last[lot[0]], [p for p in rivals if p[1] == lot[0]]))
    ]
    assert [(r.auction_id, r.step, r.bidder_id, r.amount) for r in made] == expected
    assert sum(r.is_winning for r in made) == len({r.auction_id for r in made})


@pytest.mark.parametrize("split", [DEFAULT, CUT], ids=["whole", "cut"])
@pytest.mark.parametrize("seed", range(4))
def test_ledger_equals_one_request_at_a_time(spark, seed, split):
    lots, log, rivals = random_world(seed, attempts=40)
    rows = proxies.interleaved_ledger(
        spark.createDataFrame(lots, AUCTION), spark.createDataFrame(log, ATTEMPT), spark.createDataFrame(rivals, PROXY),
        lanes=4, split=split,
    ).collect()
    expected = {}
    for lot in lots:
        attempts = [a for a in log if a[1] == lot[0]]
        _, bids, _ = play(lot, attempts, [p for p in rivals if p[1] == lot[0]])
        for attempt, bidder, amount in bids:
            step = sum(a == attempt for a, _ in expected)
            expected[attempt, step] = (bidder, amount)
    assert {(r.attempt_id, r.step): (r.bidder_id, r.amount) for r in rows} == expected
    assert any(r.is_auto for r in rows)


def world(spark, rivals, last, price=10):
    lot = (1, 9, "lot", Decimal(price), Decimal(price), None, START + timedelta(days=1), "active")
    made = proxies.auto_bid_battle(
        spark.createDataFrame([lot], AUCTION), spark.createDataFrame(rivals, PROXY),
        spark.createDataFrame([(1, last)], "auction_id long, bidder_id long"),
    ).orderBy("step")
    return [(r.bidder_id, r.amount) for r in made.collect()]


def test_equal_maxima_go_to_the_lower_id(spark):
    rivals = [(2, 1, 5, Decimal(12), True), (1, 1, 6, Decimal(12), True)]
    assert world(spark, rivals, last=7) == [(6, Decimal(11)), (5, Decimal(12))]


def test_room_of_less_than_one_makes_no_bid(spark):
    assert world(spark, [(1, 1, 5, Decimal("10.50"), True)], last=7) == []


def test_no_proxy_raises_itself(spark):
    assert world(spark, [(1, 1, 5, Decimal(99), True)], last=5) == []
    assert world(spark, [(1, 1, 5, Decimal(99), True)], last=7) == [(5, Decimal(11))]


def test_replies_are_capped(spark):
    rivals = [(1, 1, 5, Decimal(99), True), (2, 1, 6, Decimal(99), True)]
    made = world(spark, rivals, last=7)
    assert len(made) == 21 and made[-1] == (5, Decimal(31))


def test_activation(spark):
    lots = spark.createDataFrame(
        [(n, 9, "lot", Decimal(10), Decimal(10), None, START, "active") for n in (1, 2, 3)], AUCTION
    )
    bids = spark.createDataFrame(
        [(1, 1, 5, Decimal(10), True)], "id long, auction_id long, bidder_id long, amount decimal(10,2), is_winning boolean"
    )
    requests = spark.createDataFrame(
        [(1, 5, Decimal(20)), (1, 6, Decimal(20)), (2, 6, Decimal("10.50")), (3, 6, Decimal(10)), (7, 6, Decimal(10)),
         (3, 7, None)],
        "auction_id long, user_id long, max_amount decimal(10,2)",
    )
    made = {(r.auction_id, r.user_id): (r.result.split()[0], r.bid_amount) for r in
            proxies.auto_bid_activate(lots, bids, requests).collect()}
    assert made == {
        (1, 5): ("activated", None), (1, 6): ("activated", Decimal(11)), (2, 6): ("activated", Decimal("10.50")),
        (3, 6): ("Max", None), (7, 6): ("Auction", None), (3, 7): ("auction_id", None),
    }


def _one_at_a_time(price, leader, requests):
    """The reference's route, request by request."""
    out = []
    for user, most in requests:
        if most <= price:
            out.append(("Max", None))
            continue
        if leader == user:
            out.append(("activated", None))
            continue
        price, leader = min(price + 1, most), user
        out.append(("activated", price))
    return out


def test_requests_take_effect_in_order(spark):
    lots = spark.createDataFrame([(1, 9, "lot", Decimal(10), Decimal(10), None, START, "active")], AUCTION)
    bids = spark.createDataFrame([], "id long, auction_id long, bidder_id long, amount decimal(10,2), is_winning boolean")
    requests = spark.createDataFrame(
        [(1, 5, Decimal(20), START), (1, 6, Decimal(11), START + timedelta(seconds=1))],
        "auction_id long, user_id long, max_amount decimal(10,2), created_at timestamp_ntz",
    )
    made = {r.user_id: (r.result.split()[0], r.bid_amount) for r in proxies.auto_bid_activate(lots, bids, requests).collect()}
    assert made == {5: ("activated", Decimal(11)), 6: ("Max", None)}


@pytest.mark.parametrize("seed", range(3))
def test_ordered_requests_equal_one_at_a_time(spark, seed):
    import random

    rnd = random.Random(seed)
    lots = [(n, 9, "lot", Decimal(10), Decimal(10 + n % 3), None, START, "active") for n in range(1, 5)]
    leaders = {1: 5, 3: 6}
    bids = [(k, a, u, Decimal(10), True) for k, (a, u) in enumerate(leaders.items())]
    asked = [(rnd.randint(1, 4), rnd.randint(5, 8), Decimal(rnd.randint(900, 1600)) / 100, START + timedelta(seconds=k))
             for k in range(300)]
    got = {(r.auction_id, r.created_at): (r.result.split()[0], r.bid_amount) for r in proxies.auto_bid_activate(
        spark.createDataFrame(lots, AUCTION),
        spark.createDataFrame(bids, "id long, auction_id long, bidder_id long, amount decimal(10,2), is_winning boolean"),
        spark.createDataFrame(asked, "auction_id long, user_id long, max_amount decimal(10,2), created_at timestamp_ntz").repartition(7),
    ).collect()}
    for lot in lots:
        mine = [r for r in asked if r[0] == lot[0]]
        expected = _one_at_a_time(lot[4], leaders.get(lot[0]), [(u, m) for _, u, m, _ in mine])
        assert [got[lot[0], r[3]] for r in mine] == expected


LOG = "id long, auction_id long, user_id long, op string, max_amount decimal(10,2), created_at timestamp_ntz"


def _live(events, lot, opening, at):
    """Proxies of a lot live at time `at`: each user's latest accepted set or stop at or before it; ids of first sets."""
    accepted = sorted((e for e in events if e[1] == lot and (e[3] == "stop" or e[4] > opening)), key=lambda e: (e[5], e[0]))
    firsts, state = {}, {}
    for e in accepted:
        if e[3] == "set":
            firsts.setdefault(e[2], e[0])
        if e[5] <= at:
            state[e[2]] = e
    return [(firsts[u], lot, u, e[4], True) for u, e in state.items() if e[3] == "set"]


def _play_in_time(auction, attempts, events):
    _, seller, _, price, _, buy_now, end, status = auction
    opening, bids = price, []
    for number, _, bidder, amount, at in sorted(attempts, key=lambda a: (a[4], a[0])):
        if status != "active" or at > end or bidder == seller or amount <= price:
            status = "closed" if status == "active" and at > end else status
            continue
        price = amount
        bids.append((number, bidder, amount))
        if buy_now and amount >= buy_now:
            status = "closed"
            continue
        for user, raised in battle(price, bidder, _live(events, auction[0], opening, at)):
            bids.append((number, user, raised))
            price = raised
    return bids


@pytest.mark.parametrize("seed", range(4))
def test_proxies_answer_only_while_set(spark, seed):
    import random

    lots, log, rivals = random_world(seed, attempts=40)
    rnd = random.Random(seed)
    events = []
    for k, (pid, lot, user, most, _) in enumerate(rivals):
        events.append((2 * k, lot, user, "set", most, START + timedelta(seconds=rnd.randint(0, 30))))
        if rnd.random() < 0.5:
            events.append((2 * k + 1, lot, user, "stop", None, START + timedelta(seconds=rnd.randint(0, 50))))
        if rnd.random() < 0.3:
            events.append((10_000 + k, lot, user, "set", most + 7, START + timedelta(seconds=rnd.randint(10, 50))))
    rows = proxies.interleaved_ledger(
        spark.createDataFrame(lots, AUCTION), spark.createDataFrame(log, ATTEMPT), auto_log=spark.createDataFrame(events, LOG), lanes=4,
    ).collect()
    expected = {}
    for lot in lots:
        for attempt, bidder, amount in _play_in_time(lot, [a for a in log if a[1] == lot[0]], events):
            step = sum(a == attempt for a, _ in expected)
            expected[attempt, step] = (bidder, amount)
    assert {(r.attempt_id, r.step): (r.bidder_id, r.amount) for r in rows} == expected
    assert any(r.is_auto for r in rows)


def test_a_proxy_set_later_or_stopped_is_silent(spark):
    lot = (1, 9, "lot", Decimal(10), Decimal(10), None, START + timedelta(days=1), "active")
    bids = [(1, 1, 7, Decimal(11), START + timedelta(seconds=10)), (2, 1, 7, Decimal(20), START + timedelta(seconds=30))]
    events = [(1, 1, 5, "set", Decimal(50), START + timedelta(seconds=20)), (2, 1, 5, "stop", None, START + timedelta(seconds=25)),
              (3, 1, 6, "set", Decimal(15), START + timedelta(seconds=5))]
    rows = proxies.interleaved_ledger(
        spark.createDataFrame([lot], AUCTION), spark.createDataFrame(bids, ATTEMPT), auto_log=spark.createDataFrame(events, LOG),
    ).collect()
    made = sorted((r.attempt_id, r.step, r.bidder_id, r.amount) for r in rows)
    # The first bid meets only proxy 6 (5 is set later); the second meets nobody (5 stopped, 6 is below it).
    assert made == [(1, 0, 7, Decimal(11)), (1, 1, 6, Decimal(12)), (2, 0, 7, Decimal(20))]
