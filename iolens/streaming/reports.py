"""Rates, history export and bucketed sums of a running feed.

What lasts from batch to batch is kept by the steps of :mod:`iolens.streaming.steps`.
The batch operators do the rest on the reports of a micro-batch, and the rows are
the same as those of one batch run over the whole feed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from iolens.functions.times import utc_day
from iolens.operators.groups import derive_events
from iolens.operators.history import time_window, to_history
from iolens.operators.rates import (
    SAMPLES_PER_CHUNK,
    STEP,
    aggregate_with_load,
    host_snapshot,
    rates_of_placed,
)
from iolens.operators.tagging import tag_from_report
from iolens.schema import HISTORY_COLUMNS, ORDER, TAGS
from iolens.sources.history_table import write_history
from iolens.sources.reports import ENTRIES, explode_entries
from iolens.streaming.steps import reports_with_tags

_STORE = "spark.sql.streaming.stateStore"
#: A process has a store for each step and partition, which share this memory; a batch saves its changes only.
_ROCKSDB = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.maxMemoryUsageMB": "256",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
}
_NUMBERED = ENTRIES.replace("array<struct<", "array<struct<at: int, ", 1)
_TAG_MAP = "map<string, struct<client string, system string, jid string, uid string>>"


def rates_of_reports(reports: DataFrame) -> DataFrame:
    """Rates of the reports that :func:`iolens.streaming.steps.reports_with_tags` gives of one batch.

    Reports come in parts by their clients; they are numbered per host, so each finds the one before it
    beside it, as in :func:`iolens.operators.rates.rates_of_placed`.
    """
    number, zero = F.col("number").cast("bigint"), F.lit(0).cast("bigint")
    part = F.floor(number / SAMPLES_PER_CHUNK)
    crosses = number % SAMPLES_PER_CHUNK == SAMPLES_PER_CHUNK - 1
    placed = reports.select(
        F.col("host").alias("hostname"), *ORDER, "time", "obdclass", F.lit("sample").alias("kind"),
        F.from_json("report", _NUMBERED).alias("data"), F.from_json("tags", _TAG_MAP).alias("tags"),
        number.alias("sample_no"), F.struct(zero.alias("block"), part.alias("part")).alias("chunk"),
        F.when(crosses, F.struct(zero.alias("block"), (part + 1).alias("part"))).alias("next_chunk"),
        (F.col("time") - F.col("prev_time")).alias("__dt"),
    )
    return rates_of_placed(tag_from_report(explode_entries(placed, *STEP, "tags")))


def _milliseconds(seconds: float | None) -> int | None:
    return None if seconds is None else max(1, round(seconds * 1000))


def _each_batch(reports: DataFrame, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    for name, value in _ROCKSDB.items():
        reports.sparkSession.conf.set(name, value)
    return reports.writeStream.foreachBatch(sink)


def _latest_rates(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rates of each host's last reports of a batch, and the time of the last ones that have any.

    The last report and the one before it are enough, but for hosts where nothing of the two goes together:
    of these all reports of the batch are taken.
    """
    newest = reports.groupBy("host").agg(F.max("number").alias("__newest")).persist()
    last_two = reports.join(newest, "host").where(F.col("number") >= F.col("__newest") - 1).drop("__newest")
    rows = rates_of_reports(last_two)
    times = {r.server: r.time for r in rows.groupBy("server").agg(F.max("time").alias("time")).collect()}  # a row a server
    lacking = [r.host for r in newest.where(F.col("__newest") > 1).collect() if r.host not in times]
    newest.unpersist()
    if lacking:
        rows = rows.unionByName(rates_of_reports(reports.where(F.col("host").isin(lacking))))
    return rows, rows.groupBy("server").agg(F.max("time").alias("time"))


def stream_rates(messages: DataFrame, output_path: str, idle_after: float | None = None) -> DataStreamWriter:
    """Write the rate rows of each batch below ``output_path/batch_id=<n>``.

    Set trigger and checkpoint on the returned writer and start it; the checkpoint holds the state, in
    RocksDB, to which this sets the session's state store. A sample not newer than the last accepted
    one of its host is dropped; there is no other rule for late data. A host that sent nothing for
    ``idle_after`` seconds of processing time is forgotten and begins anew if it comes back. With
    such a timeout Spark looks for due timers after every batch, so use a processing-time trigger.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = rates_of_reports(batch)  # read once, as the stateful steps run for each reading
        rows.write.mode("overwrite").parquet(f"{output_path}/batch_id={batch_id}")

    return _each_batch(reports_with_tags(messages, idle_ms=_milliseconds(idle_after)), sink)


def export_stream(
    messages: DataFrame,
    history_path: str,
    tags: Sequence[str] = TAGS,
    dedupe: bool = True,
    repeat_after: float = 30.0,
    idle_after: float | None = None,
) -> DataStreamWriter:
    """Append each batch's latest groups per server to the history table.

    The trigger interval is the export interval. With ``dedupe=False`` a server of which nothing was
    accepted for ``repeat_after`` seconds has its last groups written again, by a timer of the state
    store, and so on until it is heard of or forgotten. A replayed batch replaces its own rows.
    State, trigger and ``idle_after`` are as in :func:`stream_rates`.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        # the stateful steps run once a batch; what follows reads their rows several times
        held = batch.persist(StorageLevel.DISK_ONLY)
        try:
            rows, latest = _latest_rates(held)
            groups = aggregate_with_load(rows, tags)
            write_history(to_history(derive_events(host_snapshot(groups, latest))), history_path, batch_id=batch_id)
        finally:
            held.unpersist()

    repeat = None if dedupe else _milliseconds(repeat_after)
    return _each_batch(reports_with_tags(messages, repeat, _milliseconds(idle_after)), sink)


def stream_buckets(
    history: DataFrame, width: str, delay: str, keys: Sequence[str] = ("host", "event")
) -> DataFrame:
    """Tumbling sums of a history stream, emitted once a bucket is ``delay`` old."""
    return (
        history.select(*HISTORY_COLUMNS)
        .withWatermark("time", delay)
        .groupBy(time_window(width).alias("__window"), *keys)
        .agg(F.sum("value").alias("value"))
        .select(F.col("__window.start").alias("t"), *keys, "value")
    )


def export_buckets(
    history: DataFrame, width: str, path: str, keys: Sequence[str] = ("host", "event")
) -> DataStreamWriter:
    """Keep sums of a history stream up to date, however late its rows come: read them with :func:`bucket_sums`.

    Each batch adds what it has of every bucket it touches, old or new, below the bucket's UTC day. There is no
    watermark and no state, and a replayed batch replaces its own part.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy(time_window(width)["start"].alias("t"), *keys).agg(F.sum("value").alias("value"), F.count("value").alias("rows"))
        day = utc_day(F.col("t"), sums.schema["t"].dataType)
        dated = sums.withColumns({"date": day, "batch_id": F.lit(batch_id)})
        writer = dated.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("date", "batch_id").parquet(path)

    return history.select(*HISTORY_COLUMNS).writeStream.foreachBatch(sink)


def bucket_sums(spark: SparkSession, path: str, keys: Sequence[str] = ("host", "event")) -> DataFrame:
    """``date, t, *keys, value`` from the parts of all batches; a filter on ``date`` reads those days only."""
    parts = spark.read.parquet(path)
    return parts.groupBy("date", "t", *keys).agg(F.sum("value").alias("value"))


def open_buckets(
    history: DataFrame, sums: DataFrame, width: str, keys: Sequence[str] = ("host", "event")
) -> DataFrame:
    """Sums of the buckets after the last one that :func:`stream_buckets` has closed.

    Closes a feed that has ended, or shows the running bucket, from the stored
    history; ``sums`` is what the stream has put out.
    """
    closed = sums.agg(F.max("t").alias("closed")).scalar()
    rows = history.select("time", *keys, "value", time_window(width)["start"].alias("t"))
    after = rows.where(F.coalesce(F.col("t") > closed, F.lit(True)))
    return after.groupBy("t", *keys).agg(F.sum("value").alias("value"))
