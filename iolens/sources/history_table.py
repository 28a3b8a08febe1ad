"""The history table on disk: daily partitions, clustering and its size report."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iolens.functions.times import utc, utc_day
from iolens.functions.zorder import z_order
from iolens.schema import HISTORY_COLUMNS
from iolens.sources.history_days import write_days
from iolens.sources.shared import kept

_CLUSTER = ("system", "uid", "jid", "host", "event")
_ROWS_PER_FILE = 20_000_000
COMPACT_AFTER = dt.timedelta(hours=12)


#: Tags that are looked up by one value; a file that lacks it is passed over.
_LOOKED_UP = ("jid", "host", "event", "uid")


def _clustered(df: DataFrame, split: Sequence[str], last: Sequence[Column], parts: int | None = None) -> DataFrame:
    """Range partitions on day and the Z-order of the tags: a large day is cut into many files, and each file and
    page has a small range of every tag, for the Parquet statistics."""
    ordered, z = z_order(df, _CLUSTER)
    order = [*split, F.col(z), *[F.col(c) for c in _CLUSTER], *last]
    dealt = ordered.repartitionByRange(*([parts] if parts else []), *order)
    return dealt.sortWithinPartitions(*order).drop(z)


def _written_as(df: DataFrame, split: Sequence[str], mode: str, path: str) -> None:
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", _ROWS_PER_FILE)
    # integers as differences, also where a dictionary would be too large
    writer = writer.option("parquet.writer.version", "v2").option("parquet.bloom.filter.adaptive.enabled", "true")
    for tag in _LOOKED_UP:
        writer = writer.option(f"parquet.bloom.filter.enabled#{tag}", "true")
    writer.partitionBy(*split).parquet(path)


def write_history(
    df: DataFrame, path: str, compat_real: bool = False, batch_id: int | None = None, parts: int | None = None
) -> None:
    """Append history rows, split by the UTC day of their time; ``compat_real`` stores 4-byte values.

    With ``batch_id`` the rows of that batch are replaced if they were written
    before, which makes a repeated micro-batch harmless. ``parts`` sets how many pieces are made
    of all rows. Summaries of the days are kept beside (:mod:`iolens.sources.history_days`).
    """
    value = F.col("value").cast("float" if compat_real else "double")
    day = utc_day(F.col("time"), df.schema["time"].dataType)
    rows = df.select(*HISTORY_COLUMNS).withColumns({"value": value, "date": day})
    split = ["date"]
    if batch_id is not None:
        rows = rows.withColumn("batch_id", F.lit(batch_id))
        split.append("batch_id")
    rows = kept(rows, "history")
    mode = "append" if batch_id is None else "overwrite"
    _written_as(_clustered(rows, split, [F.col("time").desc()], parts), split, mode, path)
    write_days(rows, path, split)


def read_history(
    spark: SparkSession, path: str, compacted: str | None = None, before: dt.date | None = None
) -> DataFrame:
    """The table; days earlier than ``before`` come from the compacted copy."""
    table = spark.read.parquet(path).select(*HISTORY_COLUMNS, "date")
    if compacted is None or before is None:
        return table
    border = F.lit(before)
    old = rows_of_segments(spark.read.parquet(compacted)).select(*table.columns).where(F.col("date") < border)
    return table.where(F.col("date") >= border).unionByName(old)


def compaction_border(now: dt.datetime, older_than: dt.timedelta = COMPACT_AFTER) -> dt.date:
    """First UTC day that is not yet wholly older than the limit."""
    return (utc(now) - older_than).date()


def compact_history(
    spark: SparkSession,
    path: str,
    compacted: str,
    now: dt.datetime,
    older_than: dt.timedelta = COMPACT_AFTER,
) -> dt.date:
    """Write the whole days older than the limit into ``compacted``, as segments.

    Only days that are not there yet, or that were written to since, are taken; a
    day is replaced as a whole, so a failed run is simply run again and a run with
    nothing to do writes nothing. Returns the border to read with; the original
    days can be dropped after that.
    """
    border = compaction_border(now, older_than)
    table = spark.read.parquet(path)
    todo = _written(table).where(F.col("date") < F.lit(border)).withColumnRenamed("at", "__at")
    done = _compacted(spark, compacted)
    if done is not None:
        todo = todo.join(_written(done), "date", "left").where("at is null or __at > at")
    days = [r.date for r in todo.select("date").collect()]  # a row per day
    if days:
        _write_days(table.where(F.col("date").isin(days)).select(*HISTORY_COLUMNS, "date"), compacted)
    return border


def _written(table: DataFrame) -> DataFrame:
    """When each day was last written to; opens files, reads no column of them."""
    return table.groupBy("date").agg(F.max("_metadata.file_modification_time").alias("at"))


def _compacted(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


_SEGMENT = ("date", "system", "fid", "jid", "uid", "client", "host", "event")


def segments_of(rows: DataFrame) -> DataFrame:
    """One row per day and set of tags, with its times and values as arrays in order of time.

    ``offsets`` are microseconds from ``first_time``. Values that all are whole numbers stand in ``whole``, else all stand
    in ``real``. A segment is as long as a day has samples of one set of tags.
    """
    pair = F.array_sort(F.collect_list(F.struct("time", "value")))
    value = F.col("value")
    whole = (F.abs(value) < 2.0**53) & (value == F.floor(value).cast("double"))
    held = rows.groupBy(*_SEGMENT).agg(pair.alias("__rows"), F.every(F.coalesce(whole, F.lit(False))).alias("__whole"))
    held = held.withColumn("first_time", F.col("__rows")[0]["time"]).withColumn("last_time", F.element_at("__rows", -1)["time"])
    values = F.transform("__rows", lambda r: r["value"])
    offset = lambda r: F.timestamp_diff("MICROSECOND", F.col("first_time"), r["time"])
    return held.select(
        *_SEGMENT, F.size("__rows").alias("rows"), "first_time", "last_time", F.transform("__rows", offset).alias("offsets"),
        F.when(F.col("__whole"), values.cast("array<bigint>")).alias("whole"), F.when(~F.col("__whole"), values).alias("real"),
    )


def rows_of_segments(segments: DataFrame) -> DataFrame:
    """The history rows of segments, with their ``date``; filters on tags and day reach the files."""
    at = F.sequence(F.lit(0), F.col("rows") - 1)
    value = lambda i: F.coalesce(F.get("whole", i).cast("double"), F.get("real", i))
    rows = F.transform(at, lambda i: F.struct(F.get("offsets", i).alias("__offset"), value(i).alias("value")))
    seconds = (F.col("__offset").cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)")
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return segments.select(*_SEGMENT, "first_time", F.inline(rows)).select(
        (F.col("first_time") + since).alias("time"), *HISTORY_COLUMNS[1:], "date"
    )


def _write_days(rows: DataFrame, path: str) -> None:
    segments = kept(segments_of(rows), "segments")
    _written_as(_clustered(segments, ["date"], [F.col("first_time")]), ["date"], "overwrite", path)


def storage_report(spark: SparkSession, path: str) -> DataFrame:
    """Files, bytes, rows and time range of each day, of rows or segments; reads no values."""
    table = spark.read.parquet(path)
    packed = "offsets" in table.columns
    files = table.groupBy("date", F.col("_metadata.file_path").alias("__file")).agg(
        F.max("_metadata.file_size").alias("__bytes"),
        (F.sum("rows") if packed else F.count(F.lit(1))).alias("__rows"),
        F.min("first_time" if packed else "time").alias("__first"),
        F.max("last_time" if packed else "time").alias("__last"),
    )
    return files.groupBy("date").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("__bytes").alias("bytes"),
        F.sum("__rows").alias("rows"),
        F.min("__first").alias("first_time"),
        F.max("__last").alias("last_time"),
    )


def total_bytes(spark: SparkSession, path: str) -> DataFrame:
    return storage_report(spark, path).agg(F.sum("bytes").alias("bytes"))


def compaction_report(spark: SparkSession, path: str, compacted: str) -> DataFrame:
    """Bytes of each day before and after compaction; null after where it is not compacted."""
    before, after = (
        storage_report(spark, p).select("date", F.col("bytes").alias(name))
        for p, name in ((path, "before_bytes"), (compacted, "after_bytes"))
    )
    return before.join(after, "date", "left")
