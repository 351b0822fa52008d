"""The auction rules one request at a time, as plain Python to compare with."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal
from random import Random

START = datetime(2000, 1, 1)
AUCTION = "id long, seller_id long, title string, starting_price decimal(10,2), current_price decimal(10,2), " \
    "buy_now_price decimal(10,2), end_time timestamp_ntz, status string"
ATTEMPT = "id long, auction_id long, bidder_id long, amount decimal(10,2), created_at timestamp_ntz"
PROXY = "id long, auction_id long, user_id long, max_amount decimal(10,2), is_active boolean"


def battle(price, last, proxies):
    """Proxy bids on top of a bid of `last`: [(user, amount)]."""
    made = []
    while len(made) < 21:
        able = [p for p in proxies if p[2] != last and p[4] and p[3] > price]
        if not able:
            break
        best = min(able, key=lambda p: (-p[3], p[0]))
        if price + 1 > best[3]:
            break
        price, last = price + 1, best[2]
        made.append((last, price))
    return made


def play(auction, attempts, proxies=()):
    """Outcome per attempt id, bids made as (attempt, bidder, amount), and price before each attempt."""
    _, seller, _, price, _, buy_now, end, status = auction
    outcomes, bids, prices = {}, [], {}
    for number, _, bidder, amount, at in sorted(attempts, key=lambda a: (a[4], a[0])):
        prices[number] = price
        if status != "active":
            outcome = "not_active"
        elif at > end:
            status, outcome = "closed", "ended"
        elif bidder == seller:
            outcome = "self"
        elif amount <= price:
            outcome = "low"
        else:
            outcome, price = "ok", amount
            bids.append((number, bidder, amount))
            if buy_now and amount >= buy_now:
                status = "closed"
            else:
                for user, raised in battle(price, bidder, proxies):
                    bids.append((number, user, raised))
                    price = raised
        outcomes[number] = outcome
    return outcomes, bids, prices


def random_world(seed, auctions=60, attempts=25):
    """Auctions, attempts and proxies with many ties, late and own bids."""
    pick = Random(seed)
    lots, log, proxies = [], [], []
    for lot in range(auctions):
        opening = Decimal(pick.randint(1, 20))
        buy_now = pick.choice([None, None, Decimal(pick.randint(1, 120)), Decimal(0)])
        lots.append((
            lot, pick.randint(0, 4), f"lot {lot}", opening, opening, buy_now, START + timedelta(seconds=pick.randint(20, 60)),
            pick.choice(["active"] * 5 + ["closed"]),
        ))
        for n in range(pick.randint(0, attempts)):
            amount = Decimal(pick.randint(100, 9000 if n % 3 else 3000)) / 100
            log.append((
                lot * 1000 + n, lot, pick.randint(0, 5), amount if n % 2 else amount.quantize(Decimal(1)),
                START + timedelta(seconds=pick.randint(0, 50)),
            ))
        for user in pick.sample(range(6), pick.randint(0, 4)):
            proxies.append((
                lot * 10 + user, lot, user, Decimal(pick.choice([pick.randint(5, 90), 40])) + Decimal("0.50") * pick.randint(0, 1),
                pick.random() < 0.9,
            ))
    return lots, log, proxies
