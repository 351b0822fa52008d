from collections import deque
from datetime import datetime, timedelta
from random import Random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from gavelspark.operators.admission import admit, rate_limit

START = datetime(2000, 1, 1)


def simulate(times, limit, width):
    kept, flags = [], []
    for time in times:
        kept = [t for t in kept if time - t < width]
        flags.append(len(kept) < limit)
        if flags[-1]:
            kept.append(time)
    return flags


@given(st.lists(st.integers(0, 200)), st.integers(1, 4), st.integers(1, 50), st.integers(0, 40))
def test_scan_equals_simulation_also_when_interrupted(times, limit, width, pause):
    times, recent = sorted(times), deque()
    flags = [f for part in (times[:pause], times[pause:])
             for f in admit(np.array(part, dtype="int64"), recent, limit, width).tolist()]
    assert flags == simulate(times, limit, width)
    assert len(recent) <= limit


@pytest.mark.parametrize("limit", [1, 3])
def test_log_equals_simulation(spark, limit):
    pick = Random(limit)
    log, time = [], {c: 0 for c in range(20)}
    for n in range(3000):
        client = min(pick.randint(0, 19), pick.randint(0, 19))
        time[client] += pick.choice([0, 1, 2, 5, 40, 130])
        log.append((n, client, START + timedelta(seconds=time[client])))
    rows = rate_limit(spark.createDataFrame(log, "id long, client long, at timestamp_ntz"), limit, 60).collect()
    expected = {}
    for client in time:
        own = sorted(((at, n) for n, c, at in log if c == client))
        flags = simulate([(at - START).total_seconds() for at, _ in own], limit, 60)
        expected.update({n: flag for (_, n), flag in zip(own, flags)})
    assert {r.id: r.admitted for r in rows} == expected


def test_rejected_requests_do_not_count_and_the_window_is_open(spark):
    log = [(1, 1, START), (2, 1, START + timedelta(seconds=59)), (3, 1, START + timedelta(seconds=60)),
           (4, 1, START + timedelta(seconds=119)), (5, 1, START + timedelta(seconds=120))]
    rows = rate_limit(spark.createDataFrame(log, "id long, client long, at timestamp_ntz"), 1, 60).collect()
    assert {r.id for r in rows if r.admitted} == {1, 3, 5}
