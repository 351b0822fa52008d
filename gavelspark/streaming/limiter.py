"""Sliding-window admission on a stream of requests, one state per client."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gavelspark.functions.times import micros
from gavelspark.operators.admission import admit


class Limiter(StatefulProcessor):
    """Keeps the last `limit` admitted times of a client, whatever the length of its log."""

    def __init__(self, limit: int, width: int):
        self.limit, self.width = limit, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "time long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["time", "id"])
        recent = deque(time for (time,) in self.recent.get()) if self.recent.exists() else deque()
        flags = admit(batch["time"].to_numpy(), recent, self.limit, self.width)
        self.recent.put([(time,) for time in recent])
        yield batch[["id", "client", "time"]].assign(admitted=flags)

    def close(self) -> None:
        pass


def rate_limit(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """A stream (id, client, at) with whether each request is admitted."""
    client = requests.schema["client"].dataType.simpleString()
    judged = (
        requests.select("id", "client", micros(F.col("at")).alias("time"))
        .groupBy("client")
        .transformWithStateInPandas(
            Limiter(limit, seconds * 1_000_000), f"id long, client {client}, time long, admitted boolean", "append", "None"
        )
    )
    return judged.select("id", "client", F.timestamp_micros("time").cast("timestamp_ntz").alias("at"), "admitted")
