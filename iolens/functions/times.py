"""Moments, days and epoch seconds that do not depend on the session's time zone.

A moment without a zone is UTC. A TIMESTAMP column holds instants; any other time column is zone-less
and is taken as it is written.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampType

_EPOCH = dt.datetime(1970, 1, 1)
_DAY = 86400


def utc(moment: str | dt.datetime | dt.date) -> dt.datetime:
    """A moment as a naive UTC datetime."""
    if isinstance(moment, str):
        moment = dt.datetime.fromisoformat(moment)
    if not isinstance(moment, dt.datetime):
        return dt.datetime(moment.year, moment.month, moment.day)
    return moment.astimezone(dt.UTC).replace(tzinfo=None) if moment.tzinfo else moment


def seconds_since_epoch(moment: str | dt.datetime) -> float:
    return (utc(moment) - _EPOCH) / dt.timedelta(seconds=1)


def literal(moment: str | dt.datetime, kind: DataType) -> Column:
    """The moment as a constant of the type of a time column, so that the scan filter is not cast."""
    if isinstance(kind, TimestampType):
        return F.timestamp_micros(F.lit((utc(moment) - _EPOCH) // dt.timedelta(microseconds=1)))
    return F.lit(str(utc(moment))).cast(kind)


def epoch(time: Column, kind: DataType) -> Column:
    """Whole seconds since 1970, rounded down."""
    if isinstance(kind, TimestampType):
        return F.unix_seconds(time)
    time = time.cast("timestamp_ntz")
    day = F.unix_date(time.cast("date")).cast("bigint")
    return day * _DAY + F.hour(time) * 3600 + F.minute(time) * 60 + F.floor(F.second(time))


def from_epoch(seconds: Column, kind: DataType) -> Column:
    """The time of a whole number of seconds since 1970, as the column's kind of time."""
    if isinstance(kind, TimestampType):
        return F.timestamp_seconds(seconds)
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(secs=seconds)


def utc_day(time: Column, kind: DataType) -> Column:
    """The UTC day of an instant, or the written day of a zone-less time."""
    if isinstance(kind, TimestampType):
        return F.date_from_unix_date(F.floor(F.unix_seconds(time) / _DAY).cast("int"))
    return F.to_date(time)
