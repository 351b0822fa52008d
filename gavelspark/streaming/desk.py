"""The auction rules on a stream of bid attempts, one state per auction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gavelspark.functions.text import money, zero_to_null
from gavelspark.functions.times import micros

_RULING = "auction_id long, kind string, bid_id long, bidder_id long, cents long, total_bids int, displaced long, closes boolean, at long"
_COLUMNS = [part.split()[0] for part in _RULING.split(", ")]
# Fixed values.
NO_BIDS = "Auction ended with no bids"
# A missing number in rows of plain 64-bit numbers.
NONE = -(2**63)
# Auctions are dealt to this many keys of a stream; a stored stream keeps the number it began with.
BUCKETS = 512


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.hash("auction_id"), F.lit(buckets)))


class _Bucket(StatefulProcessor):
    """State of a bucket of auctions: the book (a row for each, by id), the rows that wait, and what each auction's timers are.

    Rows are 64-bit numbers. What arrives is appended to those that wait, as it comes. Of all the timers only the earliest is
    registered with Spark; when it goes off, those of every auction that the clock has passed do.
    """

    book_columns: list[str]
    held_columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.book = handle.getValueState("book", "rows binary")
        self.held = handle.getListState("held", "rows binary")
        self.timers = handle.getValueState("timers", "rows binary")

    @staticmethod
    def _rows(state: tuple | None, width: int) -> np.ndarray:
        return np.frombuffer(state[0] if state else b"", np.int64).reshape(-1, width).copy()

    def _book(self) -> np.ndarray:
        return self._rows(self.book.get(), len(self.book_columns))

    def _held(self) -> np.ndarray:
        width = len(self.held_columns)
        return np.concatenate([self._rows(None, width), *(self._rows(part, width) for part in self.held.get())])

    def _hold(self, rows: np.ndarray) -> None:
        self.held.appendValue((np.ascontiguousarray(rows).tobytes(),))

    def _set_timers(self, auctions: np.ndarray, at: np.ndarray) -> None:
        """Timers as soon as the clock has passed a time of each of these auctions."""
        old = self._rows(self.timers.get(), 2)
        new = np.unique(np.concatenate([old, np.stack([auctions, _ms(at)], 1)]), axis=0)
        self.timers.update((new.tobytes(),))
        if len(new) and (not len(old) or new[:, 1].min() < old[:, 1].min()):
            self.handle.registerTimer(int(new[:, 1].min()))

    def _passed_timers(self, timerValues, expiredTimerInfo) -> tuple[np.ndarray, int]:
        """The auctions (sorted) whose timers the clock has passed, which are gone now, and the clock."""
        watermark, expiry = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        timers = self._rows(self.timers.get(), 2)
        gone = (timers[:, 1] < watermark) | (timers[:, 1] <= expiry)
        rest = timers[~gone]
        self.timers.update((rest.tobytes(),))
        if len(rest):
            self.handle.registerTimer(int(rest[:, 1].min()))
        return np.unique(timers[gone, 0]), max(watermark, expiry) * 1000 - 1000

    def _keep(self, rows: np.ndarray, auctions: np.ndarray) -> None:
        """Leave these rows waiting; of `auctions` the first ones set timers."""
        self.held.clear()
        if len(rows):
            self._hold(rows)
        again = rows[np.isin(rows[:, 0], auctions)]
        if len(again):
            at = again[:, self.held_columns.index("at")]
            order = np.lexsort((at, again[:, 0]))
            ids, first = np.unique(again[order, 0], return_index=True)
            self._set_timers(ids, at[order][first])

    def close(self) -> None:
        pass


def _found(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted `ids` have the wanted ones, and which of these they have."""
    at = np.searchsorted(ids, wanted)
    if not len(ids):
        return at, np.zeros(len(wanted), bool)
    at = np.minimum(at, len(ids) - 1)
    return at, ids[at] == wanted


def _by_id(rows: np.ndarray) -> np.ndarray:
    """Rows by id, the first one of each."""
    return rows[np.unique(rows[:, 0], return_index=True)[1]]


def _late(rows: np.ndarray) -> pd.DataFrame:
    """Rulings on late attempts (auction, id, bidder, cents, at)."""
    return pd.DataFrame({
        "auction_id": rows[:, 0], "kind": "late", "bid_id": rows[:, 1], "bidder_id": _nullable(rows[:, 2]), "cents": rows[:, 3],
        "total_bids": None, "displaced": None, "closes": False, "at": rows[:, 4]}, columns=_COLUMNS)


def _nullable(numbers: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(np.ascontiguousarray(numbers, dtype=np.int64), np.asarray(numbers) == NONE)


class AuctionDesk(_Bucket):
    """Judges the attempts on each auction of a bucket in order of (at, id), whatever batches they come in.

    Attempts wait until the stream's clock has passed them; the clock is the watermark, so it runs
    `lateness` behind the newest attempt of any auction. Of those that wait only the ones that may still count are kept.
    An attempt that comes when later ones of its auction have been judged cannot count any more; it gets a ruling of its own.
    """

    # An auction without bids has no leader. `first` is the time of the earliest attempt that waits.
    book_columns = ["auction", "price", "leader", "bids", "closed", "seller", "buy_now", "end_at", "judged_to", "first"]
    held_columns = ["auction_id", "id", "bidder", "cents", "at"]

    def __init__(self, close_on_expiry: bool):
        self.close_on_expiry = close_on_expiry

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        auction, opening, seller, buy_now, end = (
            initialState[c].to_numpy().astype(np.int64) for c in ("auction_id", "opening", "seller_id", "buy_now", "end_at"))
        none = np.zeros_like(auction)
        new = np.stack([auction, opening, none + NONE, none, none, seller, buy_now, end, none - 2**62, none + NONE], 1)
        book = _by_id(np.concatenate([self._book(), new]))
        self.book.update((book.tobytes(),))
        if self.close_on_expiry:
            ours = book[_found(book[:, 0], np.unique(auction))[0]]
            self._set_timers(ours[:, 0], ours[:, 7])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        book, late, waiting = self._book(), [], []
        for frame in rows:
            new = np.stack([frame[c].to_numpy().astype(np.int64) for c in ("auction_id", "id", "bidder_id", "cents", "at")], 1)
            at, known = _found(book[:, 0], new[:, 0])
            new, of = new[known], book[at[known]]
            passed = new[:, 4] <= of[:, 8]
            late.append(new[passed])
            waiting.append(new[~passed & (of[:, 4] == 0) & (new[:, 2] != of[:, 5]) & (new[:, 4] <= of[:, 7]) & (new[:, 3] > of[:, 1])])
        if waiting and sum(map(len, waiting)):
            new = np.concatenate(waiting)
            self._hold(new)
            order = np.lexsort((new[:, 4], new[:, 0]))
            ids, nth = np.unique(new[order, 0], return_index=True)
            first, of = new[order, 4][nth], _found(book[:, 0], ids)[0]
            earlier = (book[of, 9] == NONE) | (first < book[of, 9])
            if earlier.any():
                book[of[earlier], 9] = first[earlier]
                self.book.update((book.tobytes(),))
                self._set_timers(ids[earlier], first[earlier])
        for part in late:
            if len(part):
                yield _late(part)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        auctions, clock = self._passed_timers(timerValues, expiredTimerInfo)
        if not len(auctions):
            return
        book, held = self._book(), self._held()
        ours = _found(book[:, 0], auctions)[0]
        ready = np.isin(held[:, 0], auctions)
        due = held[ready & (held[:, 4] <= clock)]
        due = due[np.lexsort((due[:, 1], due[:, 4], due[:, 0]))]
        due = due[book[_found(book[:, 0], due[:, 0])[0], 4] == 0]
        rulings = []
        if len(due):
            # Accepted are those above all before them: each rise of the running maximum.
            of = _found(book[:, 0], due[:, 0])[0]
            frame = pd.DataFrame({"auction": due[:, 0], "bidder": due[:, 2], "cents": due[:, 3]})
            before = frame.groupby("auction")["cents"].cummax().groupby(frame["auction"]).shift(fill_value=NONE).to_numpy()
            accepted = due[:, 3] > np.maximum(before, book[of, 1])
            due, of = due[accepted], of[accepted]
        if len(due):
            closes = (book[of, 6] > 0) & (due[:, 3] >= book[of, 6])
            frame = pd.DataFrame({"auction": due[:, 0], "bidder": due[:, 2], "closes": closes.astype(np.int64)})
            by = frame.groupby("auction")
            open_ = (by["closes"].cumsum().to_numpy() - closes) == 0
            led = by["bidder"].shift(fill_value=NONE).to_numpy()
            nth = by.cumcount().to_numpy()
            led = np.where(nth == 0, book[of, 2], led)
            due, of, closes, led, nth = due[open_], of[open_], closes[open_], led[open_], nth[open_]
            total = book[of, 3] + nth + 1
            displaced = np.where((total > 1) & (led != due[:, 2]), led, NONE)
            rulings.append(pd.DataFrame({
                "auction_id": due[:, 0], "kind": "placed", "bid_id": due[:, 1], "bidder_id": due[:, 2], "cents": due[:, 3],
                "total_bids": total, "displaced": _nullable(displaced), "closes": closes, "at": due[:, 4]}, columns=_COLUMNS))
            # Rows rise by auction and time, so an auction's last one stays.
            last = np.append(of[1:] != of[:-1], True)
            book[of[last], 1], book[of[last], 2], book[of[last], 3] = due[last, 3], due[last, 2], total[last]
            book[of[last], 4] = closes[last]
        if self.close_on_expiry:
            ended = ours[(book[ours, 4] == 0) & (book[ours, 7] <= clock)]
            if len(ended):
                book[ended, 4] = 1
                rows, bid_on = book[ended], book[ended, 3] > 0
                rulings.append(pd.DataFrame({
                    "auction_id": rows[:, 0], "kind": "expired", "bid_id": _nullable(np.full(len(rows), NONE)),
                    "bidder_id": _nullable(np.where(bid_on, rows[:, 2], NONE)), "cents": np.where(bid_on, rows[:, 1], 0),
                    "total_bids": rows[:, 3], "displaced": None, "closes": True, "at": rows[:, 7]}, columns=_COLUMNS))
        over = book[ours[book[ours, 4] == 1], 0]
        rest = held[~(ready & (held[:, 4] <= clock)) & ~np.isin(held[:, 0], over)]
        self._keep(rest, auctions)
        book[ours, 8] = np.maximum(book[ours, 8], clock)
        book[ours, 9] = NONE
        again = rest[np.isin(rest[:, 0], auctions)]
        again = again[np.lexsort((-again[:, 4], again[:, 0]))]  # an auction's earliest one comes last, and stays
        book[_found(book[:, 0], again[:, 0])[0], 9] = again[:, 4]
        self.book.update((book.tobytes(),))
        yield from rulings


def _ms(at: np.ndarray) -> np.ndarray:
    """The first whole millisecond of the clock at which all of a microsecond's attempts are there."""
    return at // 1000 + 2


def _cents(amount: Column) -> Column:
    return (amount * 100).cast("long")


def bid_events(
    attempts: DataFrame, auctions: DataFrame, lateness: str, *, close_on_expiry: bool = False, buckets: int = BUCKETS,
) -> DataFrame:
    """`new-bid`, `outbid`, `auction-closed` and `late-bid` events of a stream of attempts.

    `lateness` is how far behind the newest attempt another one may come and still count in any case: what comes later than that, and
    after its auction's later attempts were judged, is a `late-bid`. Attempts are judged once the stream's time has passed them by that, so the last ones of a log wait for more; an
    attempt without auction only moves the time. With `close_on_expiry` every open auction, also one without attempts, closes
    when that time passes its end. `user_id` is the bidder, the displaced leader, or the winner. Auctions share the state and calls
    of one of `buckets` keys: a call costs much more than the few rows of one auction.
    """
    rules = auctions.where(F.col("status") == "active").select(
        F.col("id").alias("auction_id"), F.coalesce("seller_id", F.lit(-1)).alias("seller_id"), micros(F.col("end_time")).alias("end_at"),
        _cents(F.col("starting_price")).alias("opening"), F.coalesce(_cents(zero_to_null(F.col("buy_now_price"))), F.lit(0)).alias("buy_now"),
    )
    # The clock is a branch of its own: on rows that carried it, Spark would drop those behind the watermark.
    columns = [F.col("id"), F.col("auction_id"), F.col("bidder_id"), _cents(F.col("amount")).alias("cents"), micros(F.col("created_at")).alias("at")]
    clock = F.col("created_at").cast("timestamp").alias("clock")
    ticking = attempts.select(clock, *columns).withWatermark("clock", lateness).where(F.col("clock") < F.lit("0001-01-02").cast("timestamp"))
    judged = attempts.dropna(subset=["id", "auction_id", "bidder_id", "created_at"]).where(F.col("amount") > 0).select(F.lit(None).cast("timestamp").alias("clock"), *columns)
    rulings = _bucketed(ticking.union(judged), buckets).groupBy("bucket").transformWithStateInPandas(
        AuctionDesk(close_on_expiry), _RULING, "append", "EventTime", initialState=_bucketed(rules, buckets).groupBy("bucket")
    )
    nothing = F.lit(None)

    def event(kind: str, user: str, total: Column = nothing, won: Column = nothing, message: Column = nothing) -> Column:
        return F.struct(
            F.lit(kind).alias("event_type"), F.col(user).alias("user_id"), total.cast("int").alias("total_bids"),
            won.cast("boolean").alias("auction_won"), message.cast("string").alias("message"),
        )

    placed = F.col("kind") == "placed"
    events = F.array(
        F.when(placed, event("new-bid", "bidder_id", F.col("total_bids"), F.col("closes"))),
        F.when(placed & F.col("displaced").isNotNull(), event("outbid", "displaced")),
        F.when(F.col("closes"), event("auction-closed", "bidder_id", message=F.when(F.col("bidder_id").isNull(), NO_BIDS))),
        F.when(F.col("kind") == "late", event("late-bid", "bidder_id")),
    )
    titles = auctions.select(F.col("id").alias("auction_id"), F.col("title").alias("auction_title"))
    return (
        rulings.withColumn("event", F.explode(F.filter(events, lambda e: e.isNotNull())))
        .join(titles, "auction_id")
        .select(
            "event.event_type", "auction_id", "bid_id", "event.user_id",
            (F.col("cents") / 100).cast("decimal(10,2)").alias("amount"), "event.total_bids", "event.auction_won",
            F.timestamp_micros("at").cast("timestamp_ntz").alias("at"), "auction_title", "event.message",
        )
    )


def named(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events with the user's name, as watchers see them."""
    return events.join(users.select(F.col("id").alias("user_id"), "username"), "user_id", "left")


def notices(events: DataFrame, with_id: bool = False) -> DataFrame:
    """Notices that events give rise to: to displaced leaders, and to winners at expiry.

    With `with_id` the batch form's ids come first: twice the displacing bid's id, or twice the auction's id plus one.
    """
    outbid = F.col("event_type") == "outbid"
    won = (F.col("event_type") == "auction-closed") & F.col("bid_id").isNull() & F.col("user_id").isNotNull()
    # The notice texts.
    text = F.when(
        outbid, F.concat(F.lit("You've been outbid on \""), "auction_title", F.lit("\"! New price: ₹"), money(F.col("amount")))
    ).otherwise(F.concat(F.lit("Congratulations! You won \""), "auction_title", F.lit("\" for ₹"), money(F.col("amount"))))
    ids = [F.when(outbid, F.col("bid_id") * 2).otherwise(F.col("auction_id") * 2 + 1).alias("id")] if with_id else []
    return events.where(outbid | won).select(
        *ids, "user_id", "auction_id", F.when(outbid, "outbid").otherwise("auction_won").alias("type"),
        text.alias("message"), F.lit(False).alias("is_read"), F.col("at").alias("created_at"),
    )


# What a change row may do, and the statuses that are told apart, both by their place; others are the number after the last.
CHANGE_OPS = ("list", "patch", "delete")
STATUSES = ("unlisted", "active")
UNLISTED, ACTIVE, OTHER = range(3)


def _code(text: Column, words: tuple[str, ...]) -> Column:
    """The place of a text among words, as a number."""
    place = F.lit(len(words))
    for k, word in enumerate(words):
        place = F.when(text == word, k).otherwise(place)
    return F.when(text.isNotNull(), place).cast("long")


class ListingDesk(_Bucket):
    """Attempts and auction changes of a bucket of auctions, judged together in order of (time, changes first, id).

    An auction begins `unlisted` unless it is in the initial state. Rows wait until the stream's clock (the watermark)
    has passed them, and are then applied one by one:
    - `list` opens an unlisted auction with its seller, opening price, buy-now price and end (status `active`, or the
      row's status); a second listing is ignored.
    - `patch` sets end and status where the row has them, as an owner's edit does; on an unlisted auction it does nothing.
    - `delete` makes the auction unlisted again, so later attempts meet an unknown auction.
    - an attempt gets the batch replay's outcome: unknown_auction, not_active, ended (which closes the auction), self, low
      or ok; ok raises the price and may buy the auction out. Every attempt gets a ruling.
    With `close_on_expiry` an active auction closes when the clock passes its end, before any later row.
    """

    # `timer` is the time of the earliest row that waits.
    book_columns = ["auction", "status", "price", "leader", "bids", "seller", "buy_now", "end_at", "judged_to", "timer"]
    held_columns = ["auction_id", "id", "bidder", "cents", "at", "ord", "op", "seller", "opening", "buy_now", "end_at", "status"]

    def __init__(self, close_on_expiry: bool):
        self.close_on_expiry = close_on_expiry

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        auction, opening, seller, buy_now, end = (
            initialState[c].to_numpy().astype(np.int64) for c in ("auction_id", "opening", "seller", "buy_now", "end_at"))
        none = np.zeros_like(auction)
        new = np.stack([auction, none + ACTIVE, opening, none + NONE, none, seller, buy_now, end, none - 2**62, none + NONE], 1)
        book = _by_id(np.concatenate([self._book(), new]))
        self.book.update((book.tobytes(),))
        if self.close_on_expiry:
            ours = book[_found(book[:, 0], np.unique(auction))[0]]
            self._set_timers(ours[:, 0], ours[:, 7])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        book, late, waiting = self._book(), [], []
        for frame in rows:
            new = np.stack([frame[c].to_numpy().astype(np.int64) for c in self.held_columns], 1)
            unseen = np.setdiff1d(new[:, 0], book[:, 0])
            none = np.zeros_like(unseen)
            fresh = np.stack([unseen, none + UNLISTED, none, none + NONE, none, none + NONE, none, none, none - 2**62, none + NONE], 1)
            book = _by_id(np.concatenate([book, fresh]))
            passed = new[:, 4] <= book[_found(book[:, 0], new[:, 0])[0], 8]
            late.append(new[passed & (new[:, 6] == NONE)])
            waiting.append(new[~passed])
        new = np.concatenate(waiting)
        if len(new):
            self._hold(new)
            order = np.lexsort((new[:, 4], new[:, 0]))
            ids, nth = np.unique(new[order, 0], return_index=True)
            first, of = new[order, 4][nth], _found(book[:, 0], ids)[0]
            earlier = (book[of, 9] == NONE) | (first < book[of, 9])
            book[of[earlier], 9] = first[earlier]
            self._set_timers(ids[earlier], first[earlier])
        self.book.update((book.tobytes(),))
        for part in late:
            if len(part):
                yield _late(part)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        auctions, clock = self._passed_timers(timerValues, expiredTimerInfo)
        if not len(auctions):
            return
        book, held = self._book(), self._held()
        ours = _found(book[:, 0], auctions)[0]
        ready = np.isin(held[:, 0], auctions) & (held[:, 4] <= clock)
        due = held[ready]
        due = due[np.lexsort((due[:, 1], due[:, 5], due[:, 4], due[:, 0]))]
        begins = np.searchsorted(due[:, 0], auctions)
        ends = np.searchsorted(due[:, 0], auctions, side="right")
        rulings, timers = [], []
        for place, begin, end in zip(ours.tolist(), begins.tolist(), ends.tolist()):
            book[place, 1:8] = self._applied(book[place].tolist(), due[begin:end].tolist(), clock, rulings, timers)
        book[ours, 8] = np.maximum(book[ours, 8], clock)
        book[ours, 9] = NONE
        rest = held[~ready]
        self._keep(rest, auctions)
        again = rest[np.isin(rest[:, 0], auctions)]
        again = again[np.lexsort((-again[:, 4], again[:, 0]))]  # an auction's earliest one comes last, and stays
        book[_found(book[:, 0], again[:, 0])[0], 9] = again[:, 4]
        self.book.update((book.tobytes(),))
        if timers:
            self._set_timers(*np.array(timers, np.int64).T)
        if rulings:
            auction, kind, bid, bidder, cents, total, displaced, closes, at = zip(*rulings)
            numbers = [_nullable(np.array(column, np.int64)) for column in (auction, bid, bidder, cents, total, displaced, at)]
            yield pd.DataFrame(dict(zip(_COLUMNS, [
                numbers[0], list(kind), *numbers[1:4], numbers[4], numbers[5], list(closes), numbers[6]])), columns=_COLUMNS)

    def _applied(self, auction: list[int], due: list[list[int]], clock: int, rulings: list[tuple], timers: list[tuple[int, int]]) -> list[int]:
        """One auction after its due rows; what they give rise to is added to `rulings` and `timers`."""
        number, status, price, leader, bids, seller, buy_now, end, *_ = auction

        def expire(upto: int) -> None:
            nonlocal status
            if self.close_on_expiry and status == ACTIVE and end <= upto:
                status = OTHER
                rulings.append((number, "expired", NONE, leader, 0 if leader == NONE else price, bids, NONE, True, end))

        for _, bid, bidder, cents, at, _, op, new_seller, opening, new_buy_now, new_end, new_status in due:
            expire(at - 1)
            if op != NONE:
                if CHANGE_OPS[op] == "list" and status == UNLISTED:
                    status = ACTIVE if new_status == NONE else new_status
                    price, leader, bids, seller, buy_now, end = opening, NONE, 0, new_seller, max(new_buy_now, 0), new_end
                    if self.close_on_expiry:
                        timers.append((number, end))
                elif CHANGE_OPS[op] == "patch" and status != UNLISTED:
                    end = end if new_end in (NONE, 0) else new_end
                    status = status if new_status == NONE else new_status
                    if self.close_on_expiry:
                        timers.append((number, end))
                elif CHANGE_OPS[op] == "delete":
                    status, price, leader, bids = UNLISTED, 0, NONE, 0
                continue
            if status == UNLISTED:
                kind = "unknown_auction"
            elif status != ACTIVE:
                kind = "not_active"
            elif at > end:
                kind, status = "ended", OTHER
            elif seller != NONE and bidder == seller:
                kind = "self"
            elif cents <= price:
                kind = "low"
            else:
                bids, closes = bids + 1, 0 < buy_now <= cents
                rulings.append((number, "placed", bid, bidder, cents, bids, leader if leader != bidder else NONE, closes, at))
                price, leader = cents, bidder
                status = OTHER if closes else status
                continue
            rulings.append((number, kind, bid, bidder, cents, NONE, NONE, kind == "ended", at))
        expire(clock)
        return [status, price, leader, bids, seller, buy_now, end]


def listing_events(
    attempts: DataFrame, changes: DataFrame, auctions: DataFrame, lateness: str, *, close_on_expiry: bool = False,
    buckets: int = BUCKETS,
) -> DataFrame:
    """A ruling for every attempt, on auctions that are listed, patched or deleted while the stream runs.

    `changes` (auction_id, op, created_at, seller_id, starting_price, buy_now_price, end_time, status) is a second stream keyed
    like the attempts; `auctions` active at the start are the initial state. Columns: kind (placed, expired, late, or the
    outcome that refused the attempt), auction_id, bid_id, user_id, amount, total_bids, closes, at, displaced.
    """
    rules = auctions.where(F.col("status") == "active").select(
        F.col("id").alias("auction_id"), F.coalesce("seller_id", F.lit(NONE)).alias("seller"), micros(F.col("end_time")).alias("end_at"),
        _cents(F.col("starting_price")).alias("opening"), F.coalesce(_cents(zero_to_null(F.col("buy_now_price"))), F.lit(0)).alias("buy_now"),
    )
    # Numbers only: a missing one is NONE, as frames with nulls would turn long ids into floats.
    def numbers(**given: Column) -> list[Column]:
        given = {"op": F.lit(NONE), **dict.fromkeys(("seller", "opening", "buy_now", "end_at", "status"), F.lit(NONE)), **given}
        return [F.coalesce(given[name].cast("long"), F.lit(NONE)).alias(name) for name in ListingDesk.held_columns[1:]]

    at = micros(F.col("created_at"))
    tried = [F.col("auction_id"), *numbers(id=F.col("id"), bidder=F.col("bidder_id"), cents=_cents(F.col("amount")), at=at, ord=F.lit(1))]
    changed = [F.col("auction_id"), *numbers(
        id=F.lit(-1), bidder=F.lit(NONE), cents=F.lit(0), at=at, ord=F.lit(0), op=_code(F.col("op"), CHANGE_OPS), seller=F.col("seller_id"),
        opening=_cents(F.col("starting_price")), buy_now=_cents(zero_to_null(F.col("buy_now_price"))), end_at=micros(F.col("end_time")),
        status=_code(F.col("status"), STATUSES))]
    clock = F.col("created_at").cast("timestamp").alias("clock")
    early = F.lit("0001-01-02").cast("timestamp")
    ticking = (
        attempts.select(clock, *tried).withWatermark("clock", lateness).where(F.col("clock") < early)
        .unionByName(changes.select(clock, *changed).withWatermark("clock", lateness).where(F.col("clock") < early))
    )
    rows = (
        attempts.dropna(subset=["id", "auction_id", "created_at", "amount"]).select(F.lit(None).cast("timestamp").alias("clock"), *tried)
        .unionByName(changes.dropna(subset=["auction_id", "created_at", "op"]).where(F.col("op").isin(*CHANGE_OPS))
                     .select(F.lit(None).cast("timestamp").alias("clock"), *changed))
    )
    rulings = _bucketed(ticking.unionByName(rows), buckets).groupBy("bucket").transformWithStateInPandas(
        ListingDesk(close_on_expiry), _RULING, "append", "EventTime", initialState=_bucketed(rules, buckets).groupBy("bucket")
    )
    return rulings.select(
        "kind", "auction_id", "bid_id", F.col("bidder_id").alias("user_id"), (F.col("cents") / 100).cast("decimal(10,2)").alias("amount"),
        "total_bids", "closes", F.timestamp_micros("at").cast("timestamp_ntz").alias("at"), "displaced",
    )
