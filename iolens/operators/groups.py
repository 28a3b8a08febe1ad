"""Regrouping, filtering and derived events of tag groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iolens.operators.rates import as_groups, group_events
from iolens.schema import DERIVED, LEVELS

# Factors to MB and to cores, and the events that no sum takes in.
MEGABYTES = 1.0 / (1024 * 1024)
CORES = 0.01
UNCOUNTED = ("read_bytes", "write_bytes", "nclients", "bytes", "iops")


def filter_groups(
    df: DataFrame,
    user: str | None = None,
    job: str | None = None,
    server: str | None = None,
    client: str | None = None,
) -> DataFrame:
    """Keep the rows of one user, job, server and client, where given."""
    wanted = {"uid": user, "jid": job, "server": server, "client": client}
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def own_rows(df: DataFrame, user: str, is_admin: bool) -> DataFrame:
    """What a user may see: all rows for an administrator, else their own."""
    return df if is_admin else df.where(F.col("uid") == user)


def merged_value() -> Column:
    """Merge rule, with ``event`` in the grouping: events add up, load is kept."""
    return F.when(F.col("event") == "load", F.max("value")).otherwise(F.sum("value"))


def group_rates(
    groups: DataFrame,
    level: str | Sequence[str] = "j",
    user: str | None = None,
    job: str | None = None,
    server: str | None = None,
    client: str | None = None,
    compat: bool = False,
) -> DataFrame:
    """Regroup to a level (``f u j c s n``) or tag list, filters first.

    ``compat`` drops a filter on a tag that the level does not have.
    """
    tags = LEVELS[level] if isinstance(level, str) else tuple(level)
    if compat:
        user, job, client = (
            value if tag in tags else None
            for tag, value in (("uid", user), ("jid", job), ("client", client))
        )
    kept = filter_groups(groups, user, job, server, client)
    if set(kept.columns) == {"server", "time", *tags, "events"}:
        return kept
    rows = (
        group_events(kept)
        .groupBy("server", "time", *tags, "event")
        .agg(merged_value().alias("value"))
    )
    return as_groups(rows, tags)


def group_levels(groups: DataFrame, levels: Sequence[str] = tuple(LEVELS)) -> DataFrame:
    """Long rows of several levels at once: one GROUPING SETS pass over the groups.

    Columns a level lacks are null; ``level`` names it. The groups must have the
    tags of every level asked for.
    """
    tags = [t for t in ("system", "fid", "client", "jid", "uid") if t in groups.columns]
    lacking = sorted({t for lv in levels for t in LEVELS[lv]} - set(tags))
    if lacking:
        raise ValueError(f"the groups have no {', '.join(lacking)}")
    sets = [("server", "time", *LEVELS[lv], "event") for lv in levels]
    bits = ["client", "fid", "jid", "system", "uid"]
    used = [t for t in bits if t in tags]
    name = F.lit(None).cast("string")
    for lv in levels:
        match = F.lit(True)
        for t in used:
            match = match & (F.grouping(t) == (0 if t in LEVELS[lv] else 1))
        name = F.when(match, F.lit(lv)).otherwise(name)
    out = (
        group_events(groups)
        .groupingSets([[F.col(c) for c in s] for s in sets], "server", "time", *tags, "event")
        .agg(merged_value().alias("value"), name.alias("level"))
    )
    return out.select("level", "server", "time", *tags, "event", "value")


def derive_events(groups: DataFrame) -> DataFrame:
    """Add nclients, load, load_eff, iops and bytes; byte events become MB/s.

    ``load_eff`` is the load times the group's mean share of the server's
    operations and bytes; a share counts while its total is above 0. The totals
    are those of the rows given, so filter first to share among the filtered.
    """
    byte_event = lambda e: e.contains("[bytes")
    skipped = lambda e: e.contains("[usec") | e.isin(*UNCOUNTED)
    entries = F.map_entries("events")

    def total(wanted) -> Column:
        return F.aggregate(
            F.filter(entries, lambda x: ~skipped(x["key"]) & wanted(x["key"])),
            F.lit(0.0),
            lambda n, x: n + x["value"],
        )

    keys = [c for c in groups.columns if c != "events"]
    summed = groups.select(
        *keys,
        F.transform_values(
            F.map_filter("events", lambda e, _: ~e.isin(*DERIVED)),
            lambda e, v: F.when(byte_event(e) & ~skipped(e), v * MEGABYTES).otherwise(v),
        ).alias("events"),
        F.col("events")["nclients"].alias("nclients"),
        (F.coalesce(F.col("events")["load"], F.lit(0.0)) * CORES).alias("load"),
        total(lambda e: ~byte_event(e) & (e != "load")).alias("iops"),
        (total(byte_event) * MEGABYTES).alias("bytes"),
    )
    server = Window.partitionBy("server", "time")
    totals = summed.withColumns(
        {"__iops": F.sum("iops").over(server), "__bytes": F.sum("bytes").over(server)}
    )
    shares, counted = F.lit(0.0), F.lit(0)
    for name in ("iops", "bytes"):
        there = F.col("__" + name) > 0
        shares += F.when(there, F.col(name) * (F.lit(1.0) / F.col("__" + name))).otherwise(0.0)
        counted += F.when(there, 1).otherwise(0)
    load_eff = F.when(counted > 0, F.col("load") * shares / counted)
    return totals.withColumn("load_eff", load_eff).select(*keys, *DERIVED, "events")
