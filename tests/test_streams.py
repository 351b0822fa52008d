from datetime import timedelta
from decimal import Decimal
from pathlib import Path
from random import Random

import pytest
from pyspark.sql import functions as F

from gavelspark.operators import admission, lifecycle
from gavelspark.streaming import boards, desk, limiter, logs
from tests.machine import ATTEMPT, AUCTION, START, random_world


def in_batches(spark, rows, schema, parts, build, run):
    """Run a stream over a log that arrives in parts, each its own micro-batch."""
    folder = logs.fresh_folder(spark, "log")
    size = len(rows) // parts + 1
    typed = spark.createDataFrame(rows, schema).schema
    for start in range(0, len(rows), size):
        spark.createDataFrame(rows[start:start + size], schema).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(typed).option("maxFilesPerTrigger", 1).parquet(folder)
    return run(build(source))


def ended(log, after):
    """The log and a row that only moves the stream's time."""
    return [*log, (None, None, None, None, max(a[4] for a in log) + after)]


@pytest.mark.parametrize(("parts", "order"), [(1, "time"), (4, "time"), (4, "auction"), (8, "auction")])
def test_bid_stream_equals_replay(spark, parts, order):
    """Same events in any number of batches, also when the log is stored by auction and so comes out of order."""
    lots, log, _ = random_world(5, auctions=30)
    log.sort(key=lambda a: (a[4], a[0]) if order == "time" else (a[1] or 0, a[4], a[0]))
    auctions = spark.createDataFrame(lots, AUCTION)
    late = "0 seconds" if order == "time" else "1000 days"
    given = ended(log, timedelta(seconds=2) if order == "time" else timedelta(days=1001))
    events = in_batches(spark, given, ATTEMPT, parts, lambda s: desk.bid_events(s, auctions, late), lambda e: logs.append_run(e, "events"))
    replay = lifecycle.bid_replay(auctions, spark.createDataFrame(log, ATTEMPT)).collect()
    ok = [r for r in replay if r.outcome == "ok"]
    got = events.collect()
    assert sorted((r.bid_id, r.user_id, r.amount) for r in got if r.event_type == "new-bid") == sorted((r.id, r.bidder_id, r.amount) for r in ok)
    assert sorted((r.bid_id, r.user_id) for r in got if r.event_type == "outbid") == sorted(
        (r.id, r.leader_before) for r in ok if r.leader_before not in (None, r.bidder_id))
    assert {r.bid_id for r in got if r.event_type == "auction-closed"} == {r.id for r in ok if r.bought}
    assert not any(r.event_type == "late-bid" for r in got)
    messages = {r.message for r in desk.notices(events).collect()}
    assert messages == {
        r.message for r in lifecycle.outbid_notices(lifecycle.bid_replay(auctions, spark.createDataFrame(log, ATTEMPT))).collect()
    }


def lot(n, seconds, status="active"):
    return (n, 1, f"lot {n}", Decimal(10), Decimal(10), None, START + timedelta(seconds=seconds), status)


@pytest.mark.parametrize("parts", [1, 2, 6])
def test_auctions_close_when_time_passes_their_end(spark, parts):
    auctions = spark.createDataFrame([lot(1, 10), lot(2, 10), lot(3, 90), lot(4, 20), lot(5, 20, "cancelled"), lot(6, 500)], AUCTION)
    log = [
        (1, 1, 2, Decimal(20), START + timedelta(seconds=1)), (2, 2, 2, Decimal(5), START + timedelta(seconds=2)),
        (3, 3, 2, Decimal(20), START + timedelta(seconds=3)), (4, 3, 3, Decimal(30), START + timedelta(seconds=50)),
        (5, 1, 3, Decimal(40), START + timedelta(seconds=60)),
    ]
    events = in_batches(
        spark, ended(log, timedelta(seconds=40)), ATTEMPT, parts, lambda s: desk.bid_events(s, auctions, "0 seconds", close_on_expiry=True),
        lambda e: logs.append_run(e, "events"),
    )
    closed = sorted((r.auction_id, r.user_id, r.amount, r.message) for r in events.where("event_type = 'auction-closed'").collect())
    nobody = "Auction ended with no bids"
    assert closed == [(1, 2, Decimal(20), None), (2, None, Decimal(0), nobody), (3, 3, Decimal(30), None), (4, None, Decimal(0), nobody)]
    users = spark.createDataFrame([(2, "bob")], "id long, username string")
    assert {r.username for r in desk.named(events, users).collect()} == {"bob", None}
    won = sorted((r.user_id, r.message) for r in desk.notices(events).where("type = 'auction_won'").collect())
    assert won == [(2, 'Congratulations! You won "lot 1" for ₹20.00'), (3, 'Congratulations! You won "lot 3" for ₹30.00')]


def test_what_comes_too_late_is_told(spark):
    auctions = spark.createDataFrame([lot(1, 900)], AUCTION)
    at = lambda n: START + timedelta(seconds=n)
    tick = lambda n: (None, None, None, None, at(n))
    log = [(1, 1, 2, Decimal(20), at(10)), tick(100), tick(101), (2, 1, 3, Decimal(90), at(5)), (3, 1, 4, Decimal(30), at(150)), tick(300)]
    events = in_batches(spark, log, ATTEMPT, 7, lambda s: desk.bid_events(s, auctions, "3 seconds"), lambda e: logs.append_run(e, "events"))
    got = sorted((r.event_type, r.bid_id, r.user_id) for r in events.collect())
    assert got == [("late-bid", 2, 3), ("new-bid", 1, 2), ("new-bid", 3, 4), ("outbid", 3, 2)]


def state_parts(spark, monkeypatch, run):
    """Result of a run whose session has many shuffle partitions, and the partitions of its state."""
    made, name, new = [], "spark.sql.shuffle.partitions", logs.fresh_folder
    monkeypatch.setattr(logs, "fresh_folder", lambda *a: made.append(new(*a)) or made[-1])
    before = spark.conf.get(name)
    spark.conf.set(name, 40)
    try:
        got = run().collect()
        assert spark.conf.get(name) == "40"
    finally:
        spark.conf.set(name, before)
    return got, [p for p in Path(made[-1].removeprefix("file:"), "progress/state/0").iterdir() if p.name.isdigit()]


def test_state_of_a_run_has_a_few_parts_for_each_core(spark, monkeypatch):
    """However many partitions shuffles have: a part of the state costs the same in every batch, also without rows."""
    lots, log, _ = random_world(5, auctions=6)
    log.sort(key=lambda a: (a[4], a[0]))
    auctions, given = spark.createDataFrame(lots, AUCTION), ended(log, timedelta(seconds=2))
    run = lambda: in_batches(spark, given, ATTEMPT, 1, lambda s: desk.bid_events(s, auctions, "0 seconds"), lambda e: logs.append_run(e, "events"))
    got, parts = state_parts(spark, monkeypatch, run)
    assert 1 < len(parts) <= 2 * spark.sparkContext.defaultParallelism
    assert sorted(got) == sorted(run().collect())


def test_notices_keep_a_few_parts_of_state(spark, monkeypatch):
    lots, log, _ = random_world(9, auctions=6)
    log.sort(key=lambda a: (a[4], a[0]))
    auctions, given = spark.createDataFrame(lots, AUCTION), ended(log, timedelta(days=400))
    told = lambda s: desk.notices(desk.bid_events(s, auctions, "0 seconds", close_on_expiry=True), with_id=True)
    run = lambda: in_batches(spark, given, ATTEMPT, 1, told, lambda e: logs.append_run(e, "notices"))
    got, parts = state_parts(spark, monkeypatch, run)
    assert 1 < len(parts) <= 2 * spark.sparkContext.defaultParallelism
    assert got and sorted(got) == sorted(run().collect())


def test_commits_store_changes_only(spark, monkeypatch):
    """One part of the state for each core, and a commit that writes what a batch changed, not the part anew; the session's settings stay."""
    lots, log, _ = random_world(9, auctions=6)
    log.sort(key=lambda a: (a[4], a[0]))
    auctions, given = spark.createDataFrame(lots, AUCTION), ended(log, timedelta(days=400))
    told = lambda s: desk.notices(desk.bid_events(s, auctions, "0 seconds", close_on_expiry=True), with_id=True)
    run = lambda: in_batches(spark, given, ATTEMPT, 3, told, lambda e: logs.append_run(e, "notices"))
    before = spark.conf.get(logs.CHANGELOG, None)
    got, parts = state_parts(spark, monkeypatch, run)
    assert 1 < len(parts) <= spark.sparkContext.defaultParallelism
    assert all(any(f.name.endswith(".changelog") for f in part.iterdir()) for part in parts)
    assert spark.conf.get(logs.CHANGELOG, None) == before
    assert got and sorted(got) == sorted(run().collect())


def test_last_row_shares_the_batch_of_the_last_slice(spark):
    rows = spark.range(3000).repartition(24).select("id", F.timestamp_seconds("id").alias("at"))
    end = spark.range(1).select(F.lit(None).cast("long").alias("id"), F.timestamp_seconds(F.lit(5000)).alias("at"))
    folder = logs.stage_in_order(rows, "at", "log", end=end)
    seen = []
    logs.read_log(spark, folder, rows.schema, files_per_trigger=logs.FILES_PER_TRIGGER).writeStream.foreachBatch(
        lambda batch, _: seen.append(sorted((r.at.timestamp(), r.id) for r in batch.collect()))
    ).option("checkpointLocation", logs.fresh_folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == logs.SLICES
    assert [i for batch in seen for _, i in batch] == [*range(3000), None]  # slices keep the order of time


def test_unread_counts_keep_a_few_parts_of_state(spark, monkeypatch):
    rows = [(k % 7, k % 3 == 0) for k in range(60)]
    run = lambda: in_batches(spark, rows, "user_id long, is_read boolean", 3, boards.unread, lambda s: logs.update_run(s, ["user_id"], "unread"))
    got, parts = state_parts(spark, monkeypatch, run)
    assert 1 < len(parts) <= 2 * spark.sparkContext.defaultParallelism
    assert {r.user_id: r.unread for r in got} == {u: sum(user == u and not read for user, read in rows) for u in range(7)}


def test_unread_is_counted_from_the_notices_as_they_were_written(spark):
    """The folder that a notice stream wrote is the next stream; nothing is written twice."""
    rows = [(k % 7, k % 3 == 0) for k in range(60)]
    seen = []

    def count(notices):
        folder = logs.appended(notices, "notices")
        seen.append(spark.read.parquet(folder).count())
        return logs.update_run(boards.unread(logs.read_log(spark, folder, notices.schema)), ["user_id"], "unread")

    got = in_batches(spark, rows, "user_id long, is_read boolean", 3, lambda s: s, count).collect()
    assert seen == [60]
    assert {r.user_id: r.unread for r in got} == {u: sum(user == u and not read for user, read in rows) for u in range(7)}


def test_boards_over_batches(spark):
    _, log, _ = random_world(7, auctions=10)
    log.sort(key=lambda a: a[0])
    newest = in_batches(
        spark, log, ATTEMPT, 3, boards.newest_bids, lambda s: logs.update_run(s, ["auction_id", "bidder_id"], "board")
    )
    last = {}
    for bid, auction, bidder, amount, _ in log:
        last[auction, bidder] = (bid, amount)
    rows = boards.board(newest).collect()
    assert {(r.auction_id, r.bidder_id): (r.bid_id, r.amount) for r in rows} == last
    assert {r.bid_id for r in rows if r.is_winning} == {max(b for (a, _), (b, _) in last.items() if a == lot) for lot, _ in last}
    prices = in_batches(spark, log, ATTEMPT, 3, boards.prices, lambda s: logs.update_run(s, ["auction_id"], "prices"))
    assert {r.auction_id: (r.current_price, r.total_bids) for r in prices.collect()} == {
        lot: (max(a[3] for a in log if a[1] == lot), sum(a[1] == lot for a in log)) for lot in {a[1] for a in log}
    }


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_admission_equals_log_admission(spark, parts):
    pick, log = Random(3), []
    for n in range(600):
        log.append((n, pick.randint(0, 5), START + timedelta(seconds=n * 2 + pick.randint(0, 1))))
    schema = "id long, client long, at timestamp_ntz"
    stream = in_batches(
        spark, log, schema, parts, lambda s: limiter.rate_limit(s, 3, 60), lambda e: logs.append_run(e, "admission")
    )
    batch = admission.rate_limit(spark.createDataFrame(log, schema), 3, 60)
    assert {(r.id, r.admitted) for r in stream.collect()} == {(r.id, r.admitted) for r in batch.collect()}


def test_unread_totals(spark):
    notices = spark.createDataFrame([(1, False), (1, False), (2, False)], "user_id long, is_read boolean")
    assert {r.user_id: r.unread for r in boards.unread(notices).collect()} == {1: 2, 2: 1}
    assert boards.unread(notices.where(F.col("is_read"))).count() == 0


CHANGE = "auction_id long, op string, created_at timestamp_ntz, seller_id long, starting_price decimal(10,2), " \
    "buy_now_price decimal(10,2), end_time timestamp_ntz, status string"


def one_by_one(lots, attempts, changes):
    """Outcome of every attempt when changes and attempts are applied in order of (time, changes first)."""
    state = {lot[0]: dict(status=lot[7], price=lot[3], seller=lot[1], buy=lot[5] or 0, end=lot[6]) for lot in lots if lot[7] == "active"}
    rows = sorted([(c[2], 0, 0, c) for c in changes] + [(a[4], 1, a[0], a) for a in attempts], key=lambda r: r[:3])
    out = {}
    for _, kind, _, row in rows:
        if kind == 0:
            auction, op, _, seller, opening, buy, end, status = row
            s = state.get(auction)
            if op == "list" and s is None:
                state[auction] = dict(status=status or "active", price=opening, seller=seller, buy=buy or 0, end=end)
            elif op == "patch" and s is not None:
                s["end"], s["status"] = end or s["end"], status or s["status"]
            elif op == "delete":
                state.pop(auction, None)
            continue
        number, auction, bidder, amount, at = row
        s = state.get(auction)
        if s is None:
            out[number] = "unknown_auction"
        elif s["status"] != "active":
            out[number] = "not_active"
        elif at > s["end"]:
            out[number], s["status"] = "ended", "closed"
        elif bidder == s["seller"]:
            out[number] = "self"
        elif amount <= s["price"]:
            out[number] = "low"
        else:
            out[number], s["price"] = "placed", amount
            if 0 < s["buy"] <= amount:
                s["status"] = "closed"
    return out


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_listings_patches_and_deletes_in_any_number_of_batches(spark, parts):
    lots, log, _ = random_world(11, auctions=20, attempts=30)
    pick = Random(parts)
    changes = []
    for lot in range(20, 26):
        opening = Decimal(pick.randint(1, 20))
        changes.append((lot, "list", START + timedelta(seconds=pick.randint(0, 40)), pick.randint(0, 4), opening,
                        pick.choice([None, Decimal(60)]), START + timedelta(seconds=pick.randint(30, 60)), None))
        for n in range(pick.randint(5, 25)):
            log.append((lot * 1000 + n, lot, pick.randint(0, 5), Decimal(pick.randint(100, 9000)) / 100, START + timedelta(seconds=pick.randint(0, 50))))
    for lot in pick.sample(range(26), 8):
        at = START + timedelta(seconds=pick.randint(0, 50))
        changes.append(pick.choice([
            (lot, "patch", at, None, None, None, at + timedelta(seconds=30), None), (lot, "patch", at, None, None, None, None, "cancelled"),
            (lot, "delete", at, None, None, None, None, None),
        ]))
    log.sort(key=lambda a: (a[4], a[0]))
    changes.sort(key=lambda c: c[2])
    last = max(a[4] for a in log) + timedelta(seconds=2)
    folder_a, folder_c = logs.fresh_folder(spark, "attempts"), logs.fresh_folder(spark, "changes")
    for rows, schema, folder, tick in ((log, ATTEMPT, folder_a, (None, None, None, None, last)),
                                       (changes, CHANGE, folder_c, (None, None, last, None, None, None, None, None))):
        rows = [*rows, tick]
        size = len(rows) // parts + 1
        for start in range(0, len(rows), size):
            spark.createDataFrame(rows[start:start + size], schema).coalesce(1).write.mode("append").parquet(folder)
    read = [spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(folder)
            for schema, folder in ((ATTEMPT, folder_a), (CHANGE, folder_c))]
    got = logs.append_run(desk.listing_events(*read, spark.createDataFrame(lots, AUCTION), "0 seconds"), "listings").collect()
    assert {r.bid_id: r.kind for r in got} == one_by_one(lots, log, changes)
    assert any(r.kind == "placed" and r.auction_id >= 20 for r in got) and any(r.kind == "unknown_auction" for r in got)


def test_listing_query_equals_one_by_one_on_the_tables(spark):
    from gavelspark.plans.queries import ALL, on_folder
    from gavelspark.sources.mapped import AuctionData
    from gavelspark.sources.samples import sample

    folder = "/root/testdata/sf0.001"
    got = {r.bid_id: r.kind for r in on_folder(ALL["stream_listings"])(spark, folder).collect()}
    d = AuctionData(spark, folder)
    lots = [tuple(r) for r in d.opening.select("id", "seller_id", "title", "starting_price", "current_price", "buy_now_price",
                                                "end_time", "status").collect()]
    changes = [tuple(r) for r in sample(d, "auction_changes").collect()]
    attempts = [tuple(r) for r in d.attempts.collect()]
    assert got == one_by_one(lots, attempts, changes)


NOTICE = "id long, user_id long, created_at timestamp_ntz"
ACK = "user_id long, notification_id long, created_at timestamp_ntz"


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_unread_falls_when_notices_are_read_in_any_order(spark, parts):
    from gavelspark.operators import changes, reads
    from gavelspark.streaming import reading

    pick = Random(parts)
    notices = [(k, pick.randint(1, 6), START + timedelta(seconds=pick.randint(0, 100))) for k in range(120)]
    acks = [(u, k, START + timedelta(seconds=pick.randint(0, 200))) for k, u, _ in pick.sample(notices, 50)]
    acks += [(u + 1, k, START) for k, u, _ in pick.sample(notices, 10)]  # another user's ack reads nothing
    acks += [(3, None, START + timedelta(seconds=500)), (5, None, START + timedelta(seconds=40))]
    rows = [("n", n) for n in notices] + [("a", a) for a in acks]
    pick.shuffle(rows)
    folder_n, folder_a = logs.fresh_folder(spark, "notices"), logs.fresh_folder(spark, "acks")
    size = len(rows) // parts + 1
    for start in range(0, len(rows), size):
        part = rows[start:start + size]
        spark.createDataFrame([r for kind, r in part if kind == "n"], NOTICE).coalesce(1).write.mode("append").parquet(folder_n)
        spark.createDataFrame([r for kind, r in part if kind == "a"], ACK).coalesce(1).write.mode("append").parquet(folder_a)
    streams = [spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(folder)
               for schema, folder in ((NOTICE, folder_n), (ACK, folder_a))]
    got = {r.user_id: r.unread for r in logs.update_run(reading.unread_with_reads(*streams), ["user_id"], "unread").collect()}
    expected = {}
    for k, u, at in notices:
        read = any(a[0] == u and a[1] == k for a in acks) or any(a[0] == u and a[1] is None and a[2] >= at for a in acks)
        expected[u] = expected.get(u, 0) + (not read)
    assert got == expected
    # Where every read-all comes after the notices, the batch form gives the same counts as this expectation.
    later = [a for a in acks if a[1] is not None] + [(3, None, START + timedelta(seconds=500))]
    batch = spark.createDataFrame([(k, u, at, False) for k, u, at in notices], "id long, user_id long, created_at timestamp_ntz, is_read boolean")
    counted = {r.user_id: r.unread for r in reads.unread_count(changes.mark_read(batch, spark.createDataFrame(later, ACK))).collect()}
    expected_later = {}
    for k, u, at in notices:
        read = any(a[0] == u and a[1] == k for a in later) or any(a[0] == u and a[1] is None and a[2] >= at for a in later)
        expected_later[u] = expected_later.get(u, 0) + (not read)
    assert counted == expected_later


def stored_rows(stream, spark, name):
    """The most rows of state that a stream held, run over what is there, and what it told."""
    logs.keep_state_on_disk(spark)
    out = logs.fresh_folder(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    held = max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])
    return held, spark.read.schema(stream.schema).parquet(f"{out}/rows")


def test_auctions_share_the_state_of_a_bucket(spark):
    """A key of the stream is a bucket of auctions, so calls and state rows do not rise with the auctions; all bids are told."""
    lots, log, _ = random_world(17, auctions=200, attempts=12)
    log.sort(key=lambda a: (a[4], a[0]))
    auctions = spark.createDataFrame(lots, AUCTION)
    held, events = in_batches(
        spark, ended(log, timedelta(seconds=2)), ATTEMPT, 3, lambda s: desk.bid_events(s, auctions, "0 seconds", buckets=5),
        lambda e: stored_rows(e, spark, "events"))
    assert held <= 5 * 4  # book, waiting rows, timers and the one registered
    ok = [r for r in lifecycle.bid_replay(auctions, spark.createDataFrame(log, ATTEMPT)).collect() if r.outcome == "ok"]
    got = events.collect()
    assert len({r.auction_id for r in ok}) > 50
    assert sorted((r.bid_id, r.user_id, r.amount) for r in got if r.event_type == "new-bid") == sorted((r.id, r.bidder_id, r.amount) for r in ok)
    assert sorted((r.bid_id, r.user_id) for r in got if r.event_type == "outbid") == sorted(
        (r.id, r.leader_before) for r in ok if r.leader_before not in (None, r.bidder_id))
    assert {r.bid_id for r in got if r.event_type == "auction-closed"} == {r.id for r in ok if r.bought}


def test_users_share_the_state_of_a_bucket(spark):
    """State rows rise with buckets and slots, not with notices; read-alls, early and repeated acks count as before."""
    from gavelspark.streaming import reading

    notices = [(k, k % 90, START + timedelta(seconds=k % 50)) for k in range(1500)]
    acks = [(k % 90, k, START) for k in range(0, 1500, 4)] + [(7, None, START + timedelta(seconds=20)), (8, 2000, START)]
    folders = logs.fresh_folder(spark, "notices"), logs.fresh_folder(spark, "acks")
    for part in range(3):
        spark.createDataFrame(notices[part::3], NOTICE).coalesce(1).write.mode("append").parquet(folders[0])
        spark.createDataFrame(acks[part::3], ACK).coalesce(1).write.mode("append").parquet(folders[1])
    streams = [spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(folder)
               for schema, folder in ((NOTICE, folders[0]), (ACK, folders[1]))]
    logs.keep_state_on_disk(spark)
    got = {}
    query = reading.unread_with_reads(*streams, buckets=2).writeStream.outputMode("update").foreachBatch(
        lambda rows, _: got.update({r.user_id: r.unread for r in rows.collect()})
    ).option("checkpointLocation", logs.fresh_folder(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]) <= 2 * (2 * reading.SLOTS + 1) * 2
    expected = dict.fromkeys(range(90), 0)
    for k, u, at in notices:
        expected[u] += k % 4 != 0 and not (u == 7 and at <= START + timedelta(seconds=20))
    assert got == expected


def test_auctions_of_one_bucket_close_at_their_own_ends(spark):
    """Expiry in shared state: each auction closes once, with the last accepted bid before its end as winner."""
    lots, log, _ = random_world(23, auctions=80, attempts=10)
    log.sort(key=lambda a: (a[4], a[0]))
    auctions, attempts = spark.createDataFrame(lots, AUCTION), spark.createDataFrame(log, ATTEMPT)
    held, events = in_batches(
        spark, ended(log, timedelta(seconds=90)), ATTEMPT, 4, lambda s: desk.bid_events(s, auctions, "0 seconds", close_on_expiry=True, buckets=3),
        lambda e: stored_rows(e, spark, "expiry"))
    assert held <= 3 * 4
    ok = [r for r in lifecycle.bid_replay(auctions, attempts).collect() if r.outcome == "ok"]
    leaders = {r.auction_id: (r.bidder_id, r.amount) for r in sorted(ok, key=lambda r: (r.created_at, r.id))}
    bought = {r.auction_id for r in ok if r.bought}
    closed = [(r.auction_id, r.user_id, r.amount) for r in events.where("event_type = 'auction-closed' and bid_id is null").collect()]
    assert sorted(closed) == sorted((a[0], *leaders.get(a[0], (None, Decimal(0)))) for a in lots if a[7] == "active" and a[0] not in bought)
