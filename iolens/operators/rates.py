"""From cumulative counters to rates, and rates summed by tags."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iolens.functions.blocks import Blocks, block_of
from iolens.schema import ORDER, SERVER_CLASSES, TAGS

SAMPLES_PER_CHUNK = 256
BLOCK_ROWS = 1 << 24  # width of a block of the arrival order

_SAMPLE = ("host", *ORDER)


def accept_samples(
    samples: DataFrame,
    samples_per_chunk: int = SAMPLES_PER_CHUNK,
    block_rows: int | Blocks = BLOCK_ROWS,
) -> DataFrame:
    """Samples newer than every earlier arrival of their host.

    ``prev_time`` is the time of the accepted sample before; null on the first,
    which only seeds. ``sample_no`` counts the accepted samples of a host within
    a block of the arrival order, and ``chunk`` groups neighbouring ones.
    ``next_chunk`` is set on the last sample of a chunk: where its successor is.

    Blocks are summarised by an aggregate and only the summaries are scanned per
    host, so a host with most of the samples is spread over tasks as well.
    """
    blocked = samples.select(
        *_SAMPLE, "time", block_of(F.col("arrival_seq"), block_rows).alias("__block")
    )
    forward = Window.partitionBy("host").orderBy("__block")
    backward = Window.partitionBy("host").orderBy(F.col("__block").desc())
    advances = F.col("__before").isNull() | (F.col("__top") > F.col("__before"))
    blocks = (
        blocked.groupBy("host", "__block")
        .agg(F.max("time").alias("__top"))
        .withColumn("__before", F.max("__top").over(forward.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn(
            "__next",
            F.last(F.when(advances, F.col("__block")), ignorenulls=True).over(
                backward.rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
    )
    inside = Window.partitionBy("host", "__block").orderBy(*ORDER)
    seen = F.max("time").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    accepted = (
        blocked.join(blocks, ["host", "__block"])
        .withColumn("prev_time", F.greatest("__before", seen))
        .where("prev_time is null or time > prev_time")
        .withColumn("sample_no", F.row_number().over(inside))
    )
    part = F.floor(F.col("sample_no") / samples_per_chunk)

    def chunk(block: Column, number: Column) -> Column:
        return F.struct(block.alias("block"), number.alias("part"))

    last_of_part = F.col("sample_no") % samples_per_chunk == samples_per_chunk - 1
    # the sample that reaches the block's top time is its last accepted one
    next_chunk = F.when(
        F.col("time") == F.col("__top"),
        F.when(F.col("__next").isNotNull(), chunk(F.col("__next"), F.lit(0).cast("bigint"))),
    ).when(last_of_part, chunk(F.col("__block"), part + 1))
    return accepted.select(
        *_SAMPLE, "time", "prev_time", "sample_no",
        chunk(F.col("__block"), part).alias("chunk"), next_chunk.alias("next_chunk"),
    )


def coalesce_ticks(samples: DataFrame, every: float) -> DataFrame:
    """Only the last arrived sample per host and tick of ``every`` seconds."""
    payload = [c for c in samples.columns if c != "host"]
    return (
        samples.groupBy("host", F.floor(F.col("time") / every).alias("__tick"))
        .agg(F.max_by(F.struct(*payload), F.struct(*ORDER)).alias("__last"))
        .select("host", *[F.col("__last")[c].alias(c) for c in payload])
    )


def newest_samples(samples: DataFrame) -> DataFrame:
    """The last two accepted samples of every host, laid out as by :func:`accept_samples`.

    The last is the earliest arrival of the latest time, the one before it the
    same among the arrivals ahead of that; two aggregates, no ordered scan.
    """
    place = F.struct("time", *[(-F.col(c)).alias(c) for c in ORDER])
    last = samples.groupBy("host").agg(F.max(place).alias("__last"))
    ahead = F.struct(*ORDER) < F.struct(*[(-F.col("__last")[c]).alias(c) for c in ORDER])
    # one row a host: Spark broadcasts it below its limit, and else splits a host's samples at run time
    pairs = samples.join(last, "host").groupBy("host", "__last").agg(F.max(F.when(ahead, place)).alias("__prev"))

    def row(sample: str, prev_time: Column, number: int) -> Column:
        return F.struct(
            *[(-F.col(sample)[c]).alias(c) for c in ORDER],
            F.col(sample)["time"].alias("time"), prev_time.alias("prev_time"),
            F.lit(number).alias("sample_no"),
        )

    first = row("__prev", F.lit(None).cast("double"), 1)
    second = row("__last", F.col("__prev")["time"], 2)
    zero = F.lit(0).cast("bigint")
    return pairs.select(
        "host",
        F.inline(F.when(F.col("__prev").isNull(), F.array(second)).otherwise(F.array(first, second))),
    ).select(
        "*",
        F.struct(zero.alias("block"), zero.alias("part")).alias("chunk"),
        F.lit(None).cast("struct<block:bigint,part:bigint>").alias("next_chunk"),
    )


def rates(
    entries: DataFrame,
    samples: DataFrame | None = None,
    samples_per_chunk: int = SAMPLES_PER_CHUNK,
    block_rows: int | Blocks = BLOCK_ROWS,
) -> DataFrame:
    """Rates of all entries. ``samples`` names all samples of the hosts; without
    it a sample that has no entries is not known of."""
    if samples is None:
        samples = entries.select(*_SAMPLE, "time").distinct()
    return rates_of(entries, accept_samples(samples, samples_per_chunk, block_rows))


def rates_of(entries: DataFrame, accepted: DataFrame) -> DataFrame:
    """Per event ``max(0, new - old) / dt`` against the previous accepted sample.

    An entry is compared with the entry of the same client, target and type in
    the host's immediately previous sample, and dropped if there is none. An
    event missing there has rate 0. From here on ``time`` is a timestamp: a
    double key would be normalised, and shuffled, at every step.

    The entries of a client are spread over the chunks of its samples. The last
    sample of a chunk is also sent to the next one, so that every entry finds
    its predecessor beside it, whatever the number of samples.
    """
    return rates_of_placed(entries.join(steps_of(accepted), [*_SAMPLE]))


def steps_of(accepted: DataFrame) -> DataFrame:
    """What the entries of an accepted sample need to find those of the one before."""
    return accepted.withColumn("__dt", F.col("time") - F.col("prev_time")).drop("time", "prev_time")


STEP = ("sample_no", "chunk", "next_chunk", "__dt")


def rates_of_placed(entries: DataFrame, first: int | None = None) -> DataFrame:
    """:func:`rates_of` for entries that carry the columns ``STEP`` of their sample.

    ``first`` leaves out the rates of reports that arrived earlier.
    """
    cpu = F.col("stats_type") == "cpu"
    usable = entries.where(cpu | F.col("client_nid").isNotNull() & F.col("target").isNotNull())
    usable = usable.where("stats is not null").withColumns(
        {c: F.when(~cpu, F.col(c)) for c in ("client_nid", "target")}
    )

    here = F.struct("chunk", "sample_no", F.lit(False).alias("copied"))
    # the successor in another block has number 1
    ahead = F.struct(
        F.col("next_chunk").alias("chunk"),
        F.when(F.col("next_chunk.block") == F.col("chunk.block"), F.col("sample_no"))
        .otherwise(F.lit(0))
        .alias("sample_no"),
        F.lit(True).alias("copied"),
    )
    places = F.when(F.col("next_chunk").isNull(), F.array(here)).otherwise(F.array(here, ahead))
    placed = (
        usable.withColumn("__places", places)
        .drop("chunk", "next_chunk", "sample_no")
        .select("*", F.inline("__places"))
        .repartition("host", "client_nid", "chunk")
    )
    previous = (
        Window.partitionBy("host", "client_nid", "chunk", "target", "stats_type")
        .orderBy("sample_no")
        .rangeBetween(-1, -1)
    )
    matched = placed.withColumn(
        "__old", F.max_by("stats", "entry_idx").over(previous)
    ).where("not copied and __old is not null")
    if first is not None:
        matched = matched.where(F.col("arrival_seq") >= first)

    per_second = F.lit(1.0) / F.col("__dt")
    rate = F.transform_values(
        "stats",
        lambda event, new: F.greatest(
            F.coalesce(F.try_subtract(new, F.col("__old")[event]), F.lit(0)), F.lit(0)
        ).cast("double")
        * per_second,
    )
    tags = [c for c in ("client", *TAGS) if c in entries.columns]
    return matched.select(
        F.col("host").alias("server"), F.timestamp_seconds("time").alias("time"), "chunk", "obdclass",
        "entry_idx", "stats_type", "client_nid", "target", *tags, rate.alias("rates"),
    )


def _tag_rows(rate_rows: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Sums ``(server, time, cpu, *tags, event, value)`` of the class entries and the cpu.

    Every event is summed; ``nclients`` counts each client of a server's sample
    once, in the group of its first entry.
    """
    cpu = F.col("stats_type") == "cpu"
    own_class = F.col("stats_type").isin(*SERVER_CLASSES) & (
        F.col("stats_type") == F.col("obdclass")
    )
    # same leading keys as the rates' own distribution, so no further shuffle
    client = Window.partitionBy("server", "client_nid", "chunk", "time").orderBy("entry_idx")
    first = F.when(F.row_number().over(client) == 1, F.lit(1.0)).otherwise(F.lit(0.0))
    return (
        rate_rows.where(own_class | cpu)
        .withColumn("__first", first)
        .select(
            "server", "time", cpu.alias("cpu"),
            *[F.when(~cpu, F.col(t)).alias(t) for t in tags],
            F.explode(F.map_concat(_without("rates", "nclients"), F.create_map(F.lit("nclients"), "__first"))).alias(
                "event", "value"
            ),
        )
        .groupBy("server", "time", "cpu", *tags, "event")
        .agg(F.sum("value").alias("value"))
    )


def aggregate_by_tags(rate_rows: DataFrame, tags: Sequence[str] = TAGS) -> DataFrame:
    """Tag groups ``(server, time, *tags, events)`` of the host's own class of entries."""
    rows = _tag_rows(rate_rows.where("stats_type <> 'cpu'"), tags)
    return as_groups(rows.drop("cpu"), tags)


def aggregate_with_load(rate_rows: DataFrame, tags: Sequence[str] = TAGS) -> DataFrame:
    """Tag groups with the server's cpu rate as ``load`` on each.

    Equals ``attach_load(aggregate_by_tags(r), cpu_rates(r))``, but the cpu rate
    travels with the groups instead of computing the rates again for a join.
    """
    groups = as_groups(_tag_rows(rate_rows, tags), ["cpu", *tags])
    report = Window.partitionBy("server", "time")
    system_rate = F.max(F.when(F.col("cpu"), F.coalesce(F.col("events")["system"], F.lit(0.0))))
    return (
        groups.withColumn("__load", system_rate.over(report))
        .where("not cpu")
        .select("server", "time", *tags, _with_load(F.col("__load")).alias("events"))
    )


def _without(events: str, name: str) -> Column:
    """A map without one event: a counter may have the name of a derived one."""
    return F.map_filter(events, lambda e, _: e != name)


def _with_load(rate: Column) -> Column:
    events = _without("events", "load")
    return F.when(rate.isNull(), F.col("events")).otherwise(
        F.map_concat(events, F.create_map(F.lit("load"), rate))
    )


def as_groups(rows: DataFrame, tags: Sequence[str]) -> DataFrame:
    """One row per group with its events as a map, distributed by server and time.

    A (server, time) is one report, so its rows are bounded by the report size.
    """
    return (
        rows.repartition("server", "time")
        .groupBy("server", "time", *tags)
        .agg(F.map_from_entries(F.collect_list(F.struct("event", "value"))).alias("events"))
    )


def group_events(groups: DataFrame) -> DataFrame:
    """Long rows ``(..., event, value)`` of tag groups."""
    keep = [c for c in groups.columns if c != "events"]
    return groups.select(*keep, F.explode("events").alias("event", "value"))


def cpu_rates(rate_rows: DataFrame) -> DataFrame:
    """Kernel cpu rate per server and time."""
    return (
        rate_rows.where("stats_type = 'cpu'")
        .groupBy("server", "time")
        .agg(F.coalesce(F.sum(F.col("rates")["system"]), F.lit(0.0)).alias("system_rate"))
    )


def attach_load(groups: DataFrame, cpu: DataFrame) -> DataFrame:
    """Put the server's cpu rate as ``load`` on each of its tag groups of that time."""
    keep = [c for c in groups.columns if c != "events"]
    return groups.join(cpu, ["server", "time"], "left").select(
        *keep, _with_load(F.col("system_rate")).alias("events")
    )


def latest_samples(samples: DataFrame, asof: dt.datetime | None = None) -> DataFrame:
    """Per server the time of its last sample; only earlier ones count with ``asof``."""
    if asof is not None:
        samples = samples.where(F.col("time") <= asof)
    return samples.groupBy("server").agg(F.max("time").alias("time"))


def host_snapshot(
    groups: DataFrame, latest: DataFrame | None = None, asof: dt.datetime | None = None
) -> DataFrame:
    """Latest groups of every server, however old.

    ``latest`` (server, time) saves computing the groups twice when the samples
    are at hand.
    """
    if latest is None:
        latest = latest_samples(groups, asof)
    return groups.join(latest, ["server", "time"], "left_semi")
