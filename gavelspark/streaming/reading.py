"""Unread notices on a stream where notices and acknowledgements both arrive, in any order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gavelspark.functions.times import micros
from gavelspark.session import keep_state_on_disk

_OUT = "user_id long, unread long"
# A missing number in rows of plain 64-bit numbers; it sorts last.
NONE = 2**63 - 1
# Users are dealt to this many keys of a stream, and what one holds to this many slots by id; a stored stream keeps the numbers it began with.
BUCKETS = 256
SLOTS = 32


class UnreadDesk(StatefulProcessor):
    """The unread notices of a bucket of users, as notices and acknowledgements come.

    A notice is read once an acknowledgement of its id comes (before or after it), or a read-all whose time is at or after the
    notice's creation. State: the unread notices (user, id, creation time), acknowledgements whose notice has not come yet, and each
    user's count and latest read-all time. A notice that is read leaves the state; so does an early acknowledgement once its
    notice comes. Acknowledgements of notices that never come stay. Both kinds are held in slots by id, and a batch reads and writes
    only the slots of its ids (all of them if it has a read-all), each at once: a call to the store costs more than its rows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.unread = handle.getMapState("unread", "slot int", "rows binary")
        self.early = handle.getMapState("early", "slot int", "rows binary")
        self.users = handle.getValueState("users", "rows binary")

    @staticmethod
    def _rows(state: tuple | None, width: int) -> list[list[int]]:
        return np.frombuffer(state[0] if state else b"", np.int64).reshape(-1, width).tolist()

    def _slot(self, number: int) -> None:
        """Have what is held of a slot at hand."""
        if number not in self.open:
            unread = self.unread.getValue((number,)) if self.unread.containsKey((number,)) else None
            early = self.early.getValue((number,)) if self.early.containsKey((number,)) else None
            by_user: dict[int, dict[int, int]] = {}
            for user, notice, at in self._rows(unread, 3):
                by_user.setdefault(user, {})[notice] = at
            self.open[number] = by_user, {(user, notice) for user, notice in self._rows(early, 2)}

    def _store(self, state, number: int, rows: list[tuple[int, ...]]) -> None:
        if rows:
            state.updateValue((number,), (np.array(rows, np.int64).tobytes(),))
        elif state.containsKey((number,)):
            state.removeKey((number,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = np.concatenate([np.stack([frame[c].to_numpy().astype(np.int64) for c in ("user_id", "kind", "id", "at")], 1) for frame in rows])
        new = new[np.lexsort((new[:, 2], new[:, 3], new[:, 1]))]
        users = {user: (count, read_all, told) for user, count, read_all, told in self._rows(self.users.get(), 4)}
        self.open: dict[int, tuple[dict, set]] = {}
        for user, kind, number, at in new.tolist():
            count, read_all, told = users.get(user, (0, NONE, 0))
            self._slot(number % SLOTS)
            by_user, early = self.open[number % SLOTS]
            unread = by_user.setdefault(user, {})
            if kind == 0:  # a notice
                told = 1
                if number != NONE and (user, number) in early:
                    early.remove((user, number))
                elif read_all != NONE and at != NONE and at <= read_all:
                    pass
                elif number == NONE or number not in unread:
                    unread[number] = at
                    count += 1
            elif number != NONE:  # an acknowledgement of one notice
                if number in unread:
                    del unread[number]
                    count -= 1
                else:
                    early.add((user, number))
            elif at != NONE and (read_all == NONE or at > read_all):  # a read-all
                read_all = at
                for slot in range(SLOTS):
                    self._slot(slot)
                    unread = self.open[slot][0].get(user, {})
                    gone = [k for k, v in unread.items() if v <= at and v != NONE]
                    for k in gone:
                        del unread[k]
                    count -= len(gone)
            users[user] = count, read_all, told
        for slot, (by_user, early) in self.open.items():
            self._store(self.unread, slot, [(user, notice, at) for user, unread in by_user.items() for notice, at in unread.items()])
            self._store(self.early, slot, [*early])
        self.open = {}
        self.users.update((np.array([(u, *rest) for u, rest in users.items()], np.int64).tobytes(),))
        told = [u for u in np.unique(new[:, 0]).tolist() if users[u][2]]
        if told:
            yield pd.DataFrame({"user_id": told, "unread": [users[u][0] for u in told]})

    def close(self) -> None:
        pass


def unread_with_reads(notices: DataFrame, acks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(user_id, unread) after every batch, from notices (id, user_id, created_at) and acks (user_id, notification_id, created_at).

    An ack without notification_id reads all of the user's notices created up to its time. Rows without a user are ignored;
    notices without id count as unread until a read-all covers them. Equal to `unread_count(mark_read(...))` of the batch form
    once every notice and ack has come, whatever the order and batches, when read-alls come after the notices they read.
    """
    keep_state_on_disk(notices.sparkSession)
    def rows(kind: int, log: DataFrame, number: str) -> DataFrame:
        id, at = F.col(number), micros(F.col("created_at"))
        return log.where(F.col("user_id").isNotNull()).select(
            F.col("user_id").cast("long"), F.lit(kind).alias("kind"), F.coalesce(id.cast("long"), F.lit(NONE)).alias("id"),
            F.coalesce(at, F.lit(NONE)).alias("at"), F.pmod(F.hash(F.col("user_id").cast("long")), F.lit(buckets)).alias("bucket"))

    return (
        rows(0, notices, "id").unionByName(rows(1, acks, "notification_id")).groupBy("bucket")
        .transformWithStateInPandas(UnreadDesk(), _OUT, "update", "None")
    )
