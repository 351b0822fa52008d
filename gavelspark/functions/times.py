"""Expressions on naive timestamps. The clock is always an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def naive(value: str | datetime | Column) -> Column:
    """A point in time without a zone."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def hours(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes, cut towards zero."""
    return F.timestamp_diff("MINUTE", start, end)


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def _parts(end: Column, as_of: Column) -> tuple[Column, Column, Column, Column]:
    left = F.floor((micros(end) - micros(as_of)) / 1_000_000).cast("long")
    return left, F.floor(left / 3600), F.floor(left % 3600 / 60), left % 60


def left_long(end: Column, as_of: Column) -> Column:
    """`3d 4h left`, within a day `4h 5m 6s`."""
    left, h, m, s = _parts(end, as_of)
    return (
        F.when(micros(end) <= micros(as_of), "Ended")
        .when(h > 24, F.concat(F.floor(h / 24), F.lit("d "), h % 24, F.lit("h left")))
        .otherwise(F.concat(h, F.lit("h "), m, F.lit("m "), s, F.lit("s")))
    )


def left_short(end: Column, as_of: Column) -> Column:
    """`3d left`, within a day `4h 5m left`."""
    left, h, m, _ = _parts(end, as_of)
    return (
        F.when(micros(end) <= micros(as_of), "Ended")
        .when(h > 24, F.concat(F.floor(h / 24), F.lit("d left")))
        .otherwise(F.concat(h, F.lit("h "), m, F.lit("m left")))
    )


def left_hours(end: Column, as_of: Column) -> Column:
    """`76h 5m left`, however far away."""
    left, h, m, _ = _parts(end, as_of)
    return F.when(micros(end) <= micros(as_of), "Ended").otherwise(F.concat(h, F.lit("h "), m, F.lit("m left")))


def countdown(end: Column, as_of: Column) -> Column:
    """`3d 4h 5m 6s`, without the days when there are none."""
    left, h, m, s = _parts(end, as_of)
    d = F.floor(left / 86400)
    return F.when(micros(end) <= micros(as_of), "Auction Ended").otherwise(
        F.concat(F.when(d > 0, F.concat(d, F.lit("d "))).otherwise(""), h % 24, F.lit("h "), m, F.lit("m "), s, F.lit("s"))
    )
