"""Summaries of each day of the history table, kept with every write.

A write adds what it knows of its days; readers merge the rows of several writes. So the tags there are, the last
moment of activity of each host, the extent of a job and the days with the newest rows come from
a table of one row per day and tag value instead of from the history rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iolens.operators import history as H
from iolens.schema import HISTORY_COLUMNS

DIMS = ("system", "host", "event", "uid", "jid")
FOLDER = "_days"  # readers of the history pass over folders that begin so


def write_days(rows: DataFrame, path: str, split: Sequence[str] = ("date",)) -> None:
    """Summaries of history rows that have ``date``, below the history's own path.

    ``split`` has the columns the history is split by; what is replaced there is replaced here.
    """
    active = F.max(F.when((F.col("event") == "nclients") & (F.col("value") > 0), F.col("time")))
    sets = [[*split], *[[*split, d] for d in DIMS]]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *split, *DIMS).agg(
        F.grouping_id().alias("set"), F.count(F.lit(1)).alias("rows"),
        F.min("time").alias("first_time"), F.max("time").alias("last_time"), active.alias("active_time"),
    )
    ids = {d: (1 << len(DIMS)) - 1 - (1 << (len(DIMS) - 1 - i)) for i, d in enumerate(DIMS)}
    dim = F.coalesce(*[F.when(F.col("set") == n, F.lit(d)) for d, n in ids.items()])
    value = F.coalesce(*[F.when(F.col("set") == n, F.col(d)) for d, n in ids.items()])
    out = grouped.select(*split, dim.alias("dim"), value.alias("value"), "rows", "first_time", "last_time", "active_time")
    writer = out.repartition(*split).write.mode("append" if len(split) == 1 else "overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(*split).parquet(f"{path}/{FOLDER}")


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """``date, dim, value, rows, first_time, last_time, active_time``; several rows of a value where there were several
    writes. ``dim`` is null in the rows that count whole days."""
    return spark.read.parquet(f"{path}/{FOLDER}")


def distinct_dims(days: DataFrame, columns: Sequence[str] = ("system", "host", "event")) -> DataFrame:
    """As :func:`iolens.operators.history.distinct_dims`, of whole days."""
    return days.where(F.col("dim").isin(*columns)).select("dim", "value").distinct().orderBy("dim", "value")


def latest_active(days: DataFrame) -> DataFrame:
    """Per host its last time with active clients, and that time's day."""
    active = days.where("dim = 'host' and active_time is not null")
    last = active.groupBy(F.col("value").alias("host")).agg(F.max(F.struct("active_time", "date")).alias("last"))
    return last.select("host", F.col("last.active_time").alias("time"), F.col("last.date").alias("date"))


def latest_active_share(table: DataFrame, days: DataFrame, tag: str, event: str) -> DataFrame:
    """As :func:`iolens.operators.history.latest_active_share` of the whole table; of it only the days that some host was
    last active in are read."""
    places = latest_active(days)
    # one row per host, of a few days
    rows = table.where(F.col("event") == event).join(places, ["date", "host", "time"], "left_semi")
    return H.shares(rows.select(tag, "host", "system", "time", "value"))


def job_extent(days: DataFrame, jid: str) -> DataFrame:
    return days.where((F.col("dim") == "jid") & (F.col("value") == jid)).agg(
        F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time")
    )


def job_days(days: DataFrame, jid: str) -> DataFrame:
    """The days a job has rows in."""
    return days.where((F.col("dim") == "jid") & (F.col("value") == jid)).select("date").distinct()


def recent_rows(table: DataFrame, days: DataFrame, n: int = 10) -> DataFrame:
    """As :func:`iolens.operators.history.recent_rows`; reads the newest days that have as many rows."""
    counted = days.where("dim is null").groupBy("date").agg(F.sum("rows").alias("rows"))
    border, seen = None, 0
    for day in counted.orderBy(F.desc("date")).limit(n).collect():  # a row per day, and each has one row at least
        border, seen = day["date"], seen + day["rows"]
        if seen >= n:
            break
    kept = table if border is None else table.where(F.col("date") >= F.lit(border))
    return H.recent_rows(kept.select(*HISTORY_COLUMNS), n)
