"""Queries over the long history table ``(time, host, tags, event, value)``.

Only positive values are stored, so every average is over positive samples.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iolens.functions import times
from iolens.functions.names import unit_of
from iolens.schema import DERIVED, HISTORY_COLUMNS, UNKNOWN

_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
_FILLED = 4096  # empty buckets made in one row at most


def seconds_of(width: str) -> int:
    """Length of ``30s``, ``15m``, ``1h`` or ``1d``."""
    match = re.fullmatch(r"(\d+)([smhd])", width)
    if not match:
        raise ValueError(f"not a time width: {width!r}")
    return int(match.group(1)) * _SECONDS[match.group(2)]


def _window_text(width: str) -> str:
    seconds = seconds_of(width)
    if 86400 % seconds:
        raise ValueError(f"a bucket must divide a day: {width!r}")
    return f"{seconds} seconds"


def _at(df: DataFrame, moment: str | dt.datetime | Column) -> Column:
    """A bound in the type of the time column; moments without a zone are UTC."""
    return moment if isinstance(moment, Column) else times.literal(moment, df.schema["time"].dataType)


def time_window(width: str) -> Column:
    return F.window("time", _window_text(width))


def bucket_of(width: str) -> Column:
    return time_window(width)["start"]


def to_history(derived: DataFrame) -> DataFrame:
    """Melt derived groups to history rows; only values above 0, unknown tags as ``*``."""
    named = [x for c in DERIVED for x in (F.lit(c), F.col(c))]
    melted = derived.withColumn(
        "__all", F.map_concat("events", F.create_map(*named))
    ).select(
        "time",
        F.col("server").alias("host"),
        *[
            F.coalesce(F.col(c), F.lit(UNKNOWN)).alias(c)
            if c in derived.columns
            else F.lit(UNKNOWN).alias(c)
            for c in ("system", "fid", "jid", "uid", "client")
        ],
        F.explode("__all").alias("event", "value"),
    )
    return melted.where("value > 0").select(*HISTORY_COLUMNS)


def in_range(
    df: DataFrame,
    start: str | dt.datetime | Column | None = None,
    end: str | dt.datetime | Column | None = None,
    include_start: bool = False,
) -> DataFrame:
    """Rows with ``start < time <= end``; prunes ``date`` partitions where there are any.

    ``date`` is the UTC day of the time, as the history table has it.
    """
    dated = "date" in df.columns

    def day(bound: Column) -> Column:
        return times.utc_day(bound, df.schema["time"].dataType)

    if start is not None:
        low = _at(df, start)
        df = df.where(F.col("time") >= low if include_start else F.col("time") > low)
        df = df.where(F.col("date") >= day(low)) if dated else df
    if end is not None:
        high = _at(df, end)
        df = df.where(F.col("time") <= high)
        df = df.where(F.col("date") <= day(high)) if dated else df
    return df


def last_interval(df: DataFrame, width: str, now: dt.datetime) -> DataFrame:
    return in_range(df, now - dt.timedelta(seconds=seconds_of(width)), now)


def bucket_sum_by_tag(
    df: DataFrame, width: str, tag: str, event: str, host: str | None = None
) -> DataFrame:
    """Sum of one event per bucket, host, system and tag."""
    kept = df.where(F.col("event") == event)
    if host is not None:
        kept = kept.where(F.col("host") == host)
    return kept.groupBy(bucket_of(width).alias("t"), "host", "system", tag).agg(
        F.sum("value").alias("value")
    )


def bucket_sum_by_host(df: DataFrame, width: str, event: str) -> DataFrame:
    """Sum of one event per bucket and host (the heat map)."""
    return (
        df.where(F.col("event") == event)
        .groupBy(bucket_of(width).alias("t"), "host")
        .agg(F.sum("value").alias("value"))
    )


def colour_range(series: DataFrame) -> DataFrame:
    return series.agg(F.min("value").alias("low"), F.max("value").alias("high"))


def gapfill(
    df: DataFrame,
    width: str,
    start: dt.datetime,
    end: dt.datetime,
    keys: Sequence[str] = ("host", "system", "uid", "jid", "event"),
    agg: str = "avg",
    fill: float = 0.0,
) -> DataFrame:
    """Every bucket from ``start`` to ``end`` for every key present in the range.

    Each bucket that has data also emits the empty ones up to the next, so there
    is no join. A task sees the buckets of a key, never its rows. ``last`` is the
    value of the latest row, the largest of them where several share that time.
    """
    step = seconds_of(width)
    _window_text(width)
    value = {
        "avg": F.avg("value"),
        "last": F.max_by("value", F.struct("time", "value")),
        "sum": F.sum("value"),
    }[agg]
    kind = df.schema["time"].dataType

    def bucket(moment: dt.datetime) -> Column:
        return F.lit(math.floor(times.seconds_since_epoch(moment) / step)).cast("bigint")

    buckets = (
        in_range(df, start, end)
        .groupBy(*keys, F.floor(times.epoch(F.col("time"), kind) / step).alias("__n"))
        .agg(value.alias("__value"))
    )
    along = Window.partitionBy(*keys).orderBy("__n")
    spans = buckets.select(
        *keys, "__n", "__value",
        F.when(F.row_number().over(along) == 1, bucket(start)).otherwise(F.col("__n")).alias("__from"),
        F.coalesce(F.lead("__n").over(along) - 1, bucket(end)).alias("__to"),
    )
    first, last, runs = F.col("__from"), F.col("__to"), spans
    if (times.seconds_since_epoch(end) - times.seconds_since_epoch(start)) / step > _FILLED:
        # runs of buckets first, then the buckets of a run: no row holds a long array
        runs = spans.withColumn(
            "__run",
            F.explode(F.sequence(F.floor(F.col("__from") / _FILLED), F.floor(F.col("__to") / _FILLED))),
        )
        first = F.greatest("__from", F.col("__run") * _FILLED)
        last = F.least("__to", F.col("__run") * _FILLED + (_FILLED - 1))
    return runs.withColumn("__b", F.explode(F.sequence(first, last))).select(
        times.from_epoch(F.col("__b") * step, kind).alias("t"), *keys,
        F.when(F.col("__b") == F.col("__n"), F.coalesce("__value", F.lit(fill)))
        .otherwise(F.lit(fill))
        .alias("value"),
    )


def distinct_dims(df: DataFrame, columns: Sequence[str] = ("system", "host", "event")) -> DataFrame:
    """Sorted distinct ``(dim, value)`` of the columns, in one pass over the rows."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("dim"), F.col(c).alias("value")) for c in columns]
    )
    return df.select(F.inline(pairs)).distinct().orderBy("dim", "value")


def focus_tag(series: DataFrame, tag: str, value: str) -> DataFrame:
    """Keep one tag value, fold all others into ``*`` and sum again."""
    keys = [c for c in series.columns if c not in (tag, "value")]
    folded = F.when(F.col(tag) == value, F.col(tag)).otherwise(F.lit(UNKNOWN))
    return (
        series.withColumn(tag, folded).groupBy(*keys, tag).agg(F.sum("value").alias("value"))
    )


def pivot_series(series: DataFrame, tag: str, values: Sequence[str]) -> DataFrame:
    """Buckets as rows, the named tag values as columns.

    The long series itself serves where the values are not known beforehand:
    they may be too many for columns, and finding them takes a job.
    """
    keys = [c for c in series.columns if c not in (tag, "value")]
    return series.groupBy(*keys).pivot(tag, list(values)).agg(F.sum("value"))


def axis_limit(series: DataFrame, stacked: bool = False) -> DataFrame:
    """1.1 times the largest value per system and host, or the largest stack."""
    if stacked:
        series = series.groupBy("t", "system", "host").agg(F.sum("value").alias("value"))
    return series.groupBy("system", "host").agg((F.max("value") * 1.1).alias("limit"))


def latest_active(df: DataFrame) -> DataFrame:
    """Per host its last time with active clients."""
    return (
        df.where("event = 'nclients' and value > 0").groupBy("host").agg(F.max("time").alias("time"))
    )


def latest_active_share(
    df: DataFrame, tag: str, event: str, host: str | None = None
) -> DataFrame:
    """Tag rows of one event at each host's last active time, with total, share and angle."""
    if host is not None:
        df = df.where(F.col("host") == host)
    rows = (
        df.where(F.col("event") == event)
        .join(latest_active(df), ["host", "time"], "left_semi")
        .select(tag, "host", "system", "time", "value")
    )
    return shares(rows)


def shares(rows: DataFrame) -> DataFrame:
    """Add the total of a host's moment, and each row's share and angle of it."""
    total = F.sum("value").over(Window.partitionBy("host", "time"))
    share = F.col("value") / F.col("total")
    return rows.withColumn("total", total).withColumns(
        {"share": share, "angle": share * 2 * F.lit(math.pi)}
    )


def bucket_width(series: DataFrame) -> DataFrame:
    """Seconds between the first two buckets; null if there is only one."""
    first_two = series.select("t").distinct().orderBy("t").limit(2)
    seconds = F.timestamp_diff("SECOND", F.min("t"), F.max("t"))
    return first_two.agg(F.when(F.count("t") == 2, seconds).alias("seconds"))


def job_extent(df: DataFrame, jid: str) -> DataFrame:
    return df.where(F.col("jid") == jid).agg(
        F.min("time").alias("first_time"), F.max("time").alias("last_time")
    )


def with_units(df: DataFrame) -> DataFrame:
    return df.withColumn("unit", unit_of("event"))


def raw_lookup(
    df: DataFrame, since: str | dt.datetime, host: str, events: Sequence[str]
) -> DataFrame:
    """Rows after a time for one host and some events; takes raw or history column names."""
    host_col = "hostname" if "hostname" in df.columns else "host"
    event_col = "event_name" if "event_name" in df.columns else "event"
    return in_range(df, since).where(
        (F.col(host_col) == host) & F.col(event_col).isin(*events)
    )


def host_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.where(F.col("host").startswith(prefix))


def host_total_overlay(series: DataFrame) -> DataFrame:
    """Each tag value beside its (bucket, host) total.

    Totals are summed with map-side combine and joined back, since the tags of a
    busy host's bucket may be too many for one window group.
    """
    totals = series.groupBy("t", "host").agg(F.sum("value").alias("total"))
    return series.join(totals, ["t", "host"])


def host_rate_series(
    df: DataFrame, prefix: str, event: str, width: str, start: dt.datetime, end: dt.datetime
) -> DataFrame:
    """Per bucket and host the sum of each key's last value, 0 where it has none."""
    kept = host_prefix(df, prefix).where(F.col("event") == event)
    filled = gapfill(kept, width, start, end, agg="last")
    return filled.groupBy("t", "host").agg(F.sum("value").alias("value"))


def recent_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` rows by time, ties in column order."""
    rest = [c for c in df.columns if c != "time"]
    return df.orderBy(F.col("time").desc(), *rest).limit(n)
