"""Sliding-window admission: at most `limit` admitted requests per client in any window."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.functions.times import micros

# Fixed values: (requests, seconds) of the limits in use.
LIMITS = {"bid": (60, 60), "login": (5, 60), "register": (3, 300)}


def admit(times: np.ndarray, recent: deque, limit: int, width: int) -> np.ndarray:
    """Flags for ascending `times`; `recent` holds the last admitted ones and is brought forward.

    While the window is full nothing is admitted until its oldest entry leaves, so the scan jumps there.
    """
    admitted = np.zeros(len(times), dtype=bool)
    at = 0
    while at < len(times):
        if len(recent) == limit:
            at = max(at, int(np.searchsorted(times, recent[0] + width)))
            if at >= len(times):
                break
            recent.popleft()
        admitted[at] = True
        recent.append(int(times[at]))
        at += 1
    return admitted


def _walker(limit: int, width: int):
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, recent = None, deque()
        for batch in batches:
            clients, runs, times, flags = (batch["client"].to_numpy(), batch["run"].to_numpy(), batch["time"].to_numpy(), [])
            changes = np.flatnonzero((clients[1:] != clients[:-1]) | (runs[1:] != runs[:-1])) + 1
            starts = [0, *changes.tolist()] if len(times) else []
            for start, end in zip(starts, [*starts[1:], len(times)]):
                key = (clients[start], runs[start])
                if key != run:
                    run, recent = key, deque()
                flags.append(admit(times[start:end], recent, limit, width))
            out = batch[["id", "client", "time", "seed"]].assign(admitted=np.concatenate(flags) if flags else [])
            yield out[~out["seed"]].drop(columns="seed")

    return walk


def rate_limit(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """The log (id, client, at) with whether each request is admitted, in order of (at, id).

    Rejected requests do not count against later ones. Time is cut into cells of one window: a
    window reaches back into the previous cell only, so where a cell and the one before it hold
    no more than `limit` requests all of the cell is admitted, whatever happened earlier. Only
    runs of crowded cells are followed in order, each with its preceding cell to start from;
    a run is streamed through its task and what is held of it is the last `limit` times.
    """
    width = seconds * 1_000_000
    log = requests.select("id", "client", micros(F.col("at")).alias("time")).withColumn(
        "cell", F.floor(F.col("time") / width).cast("long")
    )
    by_cell = Window.partitionBy("client").orderBy("cell")
    previous = F.when(F.lag("cell").over(by_cell) == F.col("cell") - 1, F.lag("n").over(by_cell)).otherwise(0)
    next_crowded = (F.lead("cell").over(by_cell) == F.col("cell") + 1) & F.lead("crowded").over(by_cell)
    begins = F.col("crowded") & ~F.coalesce(
        (F.lag("cell").over(by_cell) == F.col("cell") - 1) & F.lag("crowded").over(by_cell), F.lit(False)
    )
    # One row per client and cell: however many requests a client sends, a day has so many windows.
    cells = (
        log.groupBy("client", "cell")
        .agg(F.count("*").alias("n"))
        .withColumn("crowded", F.col("n") + previous > limit)
        .withColumn("begins", F.when(begins, F.col("cell")))
        .withColumn("feeds", ~F.col("crowded") & F.coalesce(next_crowded, F.lit(False)))
        .withColumn("run", F.max("begins").over(by_cell.rowsBetween(Window.unboundedPreceding, 0)))
        .select(
            "client", "cell", "crowded",
            F.when(F.col("crowded"), F.col("run")).when(F.col("feeds"), F.col("cell") + 1).alias("run"),
        )
    )
    placed = log.join(cells, ["client", "cell"])
    calm = placed.where(~F.col("crowded")).select("id", "client", "time", F.lit(True).alias("admitted"))
    followed = (
        placed.where(F.col("run").isNotNull())
        .select("id", "client", "run", "time", (~F.col("crowded")).alias("seed"))
        .repartition("client", "run")
        .sortWithinPartitions("client", "run", "time", "id")
        .mapInPandas(_walker(limit, width), calm.schema)
    )
    return calm.unionByName(followed).select(
        "id", "client", F.timestamp_micros("time").cast("timestamp_ntz").alias("at"), "admitted"
    )


def guarded(requests: DataFrame, kind: str) -> DataFrame:
    """The log under the limit in use for `kind`; every kind counts for itself."""
    return rate_limit(requests, *LIMITS[kind])
