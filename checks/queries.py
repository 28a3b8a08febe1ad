"""One query per operator over the driver's tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import tables as T
from iolens.functions.blocks import equal_blocks
from iolens.functions.hostlists import collapse_hosts, expand_hosts, expand_tasks_per_node
from iolens.functions.names import epoch_seconds, fs_name, local_time, natural_key, short_host
from iolens.operators import groups as G
from iolens.operators import history as H
from iolens.operators import rates as R
from iolens.operators import tagging as M
from iolens.operators import view as V
from iolens.plans import pages, reports
from iolens.schema import DERIVED, LEVELS, ORDER, TAGS
from iolens.sources import captured, history_days, history_table, mappings
from iolens.sources import reports as P
from iolens.streaming.reports import (
    bucket_sums,
    export_buckets,
    export_stream,
    open_buckets,
    stream_buckets,
    stream_rates,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


def seconds(df: DataFrame) -> DataFrame:
    """Show timestamps as whole epoch seconds, alike in every session zone."""
    return df.withColumn("time", F.unix_seconds("time"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- samples and rates -----------------------------------------------------


@query
def accept_samples(spark, sf):
    out = R.accept_samples(T.table(spark, sf, T.LATE_SAMPLES), block_rows=1024)
    return out.select("host", "arrival_seq", "time", "prev_time")


@query
def coalesce_ticks(spark, sf):
    return R.coalesce_ticks(T.table(spark, sf, T.LATE_SAMPLES), 3600.0).select(
        "host", "arrival_seq", "time"
    )


def rate_rows(spark, sf):
    return R.rates(T.entries(spark, sf))


def tag_groups(spark, sf, tags=TAGS):
    return reports.groups_from_entries(T.entries(spark, sf), tags=tags)


@query
def rates(spark, sf):
    return seconds(
        rate_rows(spark, sf).select(
            "server", "time", "stats_type", "client_nid", "target", F.explode("rates").alias("event", "rate")
        )
    )


@query
def aggregate_by_tags(spark, sf):
    groups = R.aggregate_by_tags(rate_rows(spark, sf))
    return rounded(seconds(R.group_events(groups)), "value")


@query
def nclients(spark, sf):
    groups = R.aggregate_by_tags(rate_rows(spark, sf))
    return seconds(groups).select(
        "server", "time", *TAGS, F.col("events")["nclients"].alias("nclients")
    )


@query
def attach_load(spark, sf):
    return seconds(tag_groups(spark, sf)).select("server", "time", *TAGS, F.col("events")["load"].alias("load"))


@query
def aggregate_with_load(spark, sf):
    return rounded(seconds(R.group_events(tag_groups(spark, sf))), "value")


@query
def host_snapshot(spark, sf):
    samples = T.entries(spark, sf).select(F.col("host").alias("server"), F.timestamp_seconds("time").alias("time"))
    groups = R.host_snapshot(tag_groups(spark, sf), R.latest_samples(samples))
    return rounded(seconds(R.group_events(groups)), "value")


# --- grouping, filters, derived events -------------------------------------


def level(name: str) -> Query:
    def run(spark, sf):
        tags = ("system", "fid", "client", "jid", "uid") if name == "c" else TAGS
        grouped = G.group_rates(tag_groups(spark, sf, tags), name)
        return rounded(seconds(R.group_events(grouped)), "value")

    return run


for _level in "fujcsn":
    QUERIES[f"group_{_level}"] = level(_level)


@query
def group_levels(spark, sf):
    return rounded(seconds(G.group_levels(tag_groups(spark, sf, LEVELS["c"]))), "value")


def derived_columns(derived: DataFrame) -> DataFrame:
    tags = [c for c in derived.columns if c not in (*DERIVED, "events")]
    return rounded(seconds(derived).select(*tags, *DERIVED), *DERIVED)


def filtered(**wanted) -> Query:
    def run(spark, sf):
        tags = ("system", "fid", "client", "jid", "uid") if "client" in wanted else TAGS
        level = "c" if "client" in wanted else "j"
        return derived_columns(
            G.derive_events(G.group_rates(tag_groups(spark, sf, tags), level, **wanted))
        )

    return run


QUERIES["filter_user"] = filtered(user="u3")
QUERIES["filter_job"] = filtered(job="j4")
QUERIES["filter_server"] = filtered(server="oss1")
QUERIES["filter_client"] = filtered(client="c5")


@query
def filter_compat(spark, sf):
    groups = G.group_rates(tag_groups(spark, sf), "f", user="u3", compat=True)
    return derived_columns(G.derive_events(groups))


@query
def own_rows(spark, sf):
    return rounded(seconds(R.group_events(G.own_rows(tag_groups(spark, sf), "u2", False))), "value")


@query
def derive_events(spark, sf):
    derived = G.derive_events(tag_groups(spark, sf))
    rows = derived.select("server", "time", *TAGS, F.explode("events").alias("event", "value"))
    return rounded(seconds(rows), "value")


@query
def load_eff(spark, sf):
    derived = G.derive_events(G.group_rates(tag_groups(spark, sf), "u"))
    return rounded(seconds(derived).select("server", "time", "system", "fid", "uid", "load_eff"), "load_eff")


@query
def top_summary(spark, sf):
    return derived_columns(V.top_view(G.derive_events(tag_groups(spark, sf))))


@query
def top_detailed(spark, sf):
    derived = G.derive_events(G.group_rates(tag_groups(spark, sf), "n"))
    names = ["click", "error", "purchase", "signup", "view", "read_bytes_[bytes]", "write_bytes_[bytes]"]
    out = V.top_view(derived, detailed=True, events=names)
    out = out.withColumnsRenamed({"read_bytes_[bytes]": "read_mb", "write_bytes_[bytes]": "write_mb"})
    return rounded(seconds(out), *DERIVED, "read_mb", "write_mb")


@query
def top_events(spark, sf):
    derived = G.derive_events(G.group_rates(tag_groups(spark, sf), "n"))
    return rounded(seconds(V.top_events(derived)), *DERIVED, "value")


@query
def rank_load_eff(spark, sf):
    return rounded(seconds(reports.top_report(tag_groups(spark, sf), "s")), *DERIVED)


@query
def page(spark, sf):
    view = V.top_view(G.derive_events(G.group_rates(tag_groups(spark, sf), "n")))
    return rounded(seconds(V.page(view, "bytes", 20, 20, total=True)), *DERIVED)


@query
def totals_all(spark, sf):
    return rounded(seconds(reports.top_report(tag_groups(spark, sf), "j", totals="all", user="u3")), *DERIVED)


# --- history ----------------------------------------------------------------


@query
def to_history(spark, sf):
    rows = H.to_history(G.derive_events(tag_groups(spark, sf)))
    return rounded(seconds(rows), "value")


def history(spark, sf):
    return T.table(spark, sf, T.HISTORY)


def recent(spark, sf):
    return T.table(spark, sf, T.RECENT)


START, END = dt.datetime(2024, 1, 5, 6, 30), dt.datetime(2024, 1, 8, 18, 0)


@query
def recent_rows(spark, sf):
    return H.recent_rows(history(spark, sf))


@query
def migrate_raw(spark, sf):
    raw = P.flatten_raw(T.messages(spark, sf))
    return seconds(P.migrate_raw(raw))


@query
def in_range(spark, sf):
    return H.in_range(recent(spark, sf), START, END)


@query
def last_interval(spark, sf):
    return H.last_interval(recent(spark, sf), "1d", END)


@query
def bucket_sum_by_tag(spark, sf):
    return rounded(H.bucket_sum_by_tag(history(spark, sf), "1d", "uid", "iops"), "value")


@query
def bucket_sum_by_tag_host(spark, sf):
    out = H.bucket_sum_by_tag(recent(spark, sf), "30m", "jid", "load_eff", "srv3.cluster")
    return rounded(out, "value")


@query
def gapfill_avg(spark, sf):
    return rounded(H.gapfill(recent(spark, sf), "1h", START, END), "value")


@query
def gapfill_last(spark, sf):
    return H.gapfill(recent(spark, sf), "30m", START, END, keys=("host", "system", "event"), agg="last")


@query
def distinct_dims(spark, sf):
    return H.distinct_dims(history(spark, sf))


def uid_series(spark, sf):
    return H.bucket_sum_by_tag(history(spark, sf), "1d", "uid", "bytes")


@query
def focus_tag(spark, sf):
    return rounded(H.focus_tag(uid_series(spark, sf), "uid", "u7"), "value")


@query
def pivot_series(spark, sf):
    series = H.bucket_sum_by_tag(history(spark, sf), "1d", "fid", "bytes")
    return H.pivot_series(series, "fid", ["fsF", "fsO"])


@query
def axis_limit(spark, sf):
    return rounded(H.axis_limit(uid_series(spark, sf)), "limit")


@query
def axis_limit_stacked(spark, sf):
    return rounded(H.axis_limit(uid_series(spark, sf), stacked=True), "limit")


@query
def latest_active_share(spark, sf):
    out = H.latest_active_share(history(spark, sf), "jid", "load_eff")
    return rounded(out, "value", "total", "share", "angle")


@query
def bucket_sum_by_host(spark, sf):
    return rounded(H.bucket_sum_by_host(history(spark, sf), "1d", "open"), "value")


@query
def colour_range(spark, sf):
    return rounded(H.colour_range(H.bucket_sum_by_host(history(spark, sf), "1d", "open")), "low", "high")


@query
def bucket_width(spark, sf):
    return H.bucket_width(uid_series(spark, sf))


@query
def job_extent(spark, sf):
    return H.job_extent(history(spark, sf), "j77")


@query
def job_detail(spark, sf):
    return rounded(pages.job_detail(recent(spark, sf), "j7"), "value")


HOST = "srv2.cluster"


@query
def overview_shares(spark, sf):
    return rounded(pages.overview(history(spark, sf))["shares"], "value", "total", "share", "angle")


@query
def overview_heat_map(spark, sf):
    return rounded(pages.overview(recent(spark, sf))["heat_map"], "value")


@query
def host_page_shares(spark, sf):
    return rounded(pages.host_page(history(spark, sf), HOST)["shares"], "value", "total", "share", "angle")


@query
def host_page_series(spark, sf):
    return rounded(pages.host_page(recent(spark, sf), HOST)["series"], "value")


@query
def with_units(spark, sf):
    return H.with_units(history(spark, sf)).groupBy("event", "unit").agg(F.count(F.lit(1)).alias("n"))


@query
def raw_lookup(spark, sf):
    return H.raw_lookup(history(spark, sf), "1998-12-04 00:00:00", "srv0.cluster", ["open", "bytes"])


@query
def host_prefix(spark, sf):
    return H.host_prefix(history(spark, sf), "srv1").groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query
def host_total_overlay(spark, sf):
    return rounded(H.host_total_overlay(uid_series(spark, sf)), "value", "total")


@query
def host_rate_series(spark, sf):
    return rounded(H.host_rate_series(recent(spark, sf), "srv", "load_eff", "1h", START, END), "value")


@query
def local_time_query(spark, sf):
    rows = recent(spark, sf)
    return rows.select(local_time("time", "America/Chicago").alias("local"), "host", "event", "value")


@query
def short_host_query(spark, sf):
    return history(spark, sf).groupBy(short_host("host").alias("name")).agg(F.count(F.lit(1)).alias("n"))



# --- messages and tags -------------------------------------------------------


@query
def parse_reports(spark, sf):
    good, rejected = P.parse_reports(T.report_lines(spark, sf))
    fields = ["hostname", "time", "nid", "system", "jid", "uid"]
    empty = {c: F.lit(None).cast(good.schema[c].dataType) for c in ("msg_idx", *fields)}
    good = good.select("arrival_seq", "msg_idx", *fields, F.array_size("data").alias("entries"), F.lit(None).cast("string").alias("reason"))
    bad = rejected.select("arrival_seq", *[v.alias(c) for c, v in empty.items()], F.lit(None).cast("int").alias("entries"), "reason")
    return good.unionByName(bad)


@query
def classify_messages(spark, sf):
    return P.classify_messages(T.messages(spark, sf)).select("arrival_seq", "hostname", "kind")


@query
def explode_entries(spark, sf):
    good, _ = P.parse_reports(T.report_lines(spark, sf, broken=False))
    return P.explode_entries(good).select(
        "host", "arrival_seq", "time", "entry_idx", "client_nid", "target", F.explode("stats").alias("event", "value")
    )


@query
def flatten_raw(spark, sf):
    good, _ = P.parse_reports(T.report_lines(spark, sf, broken=False))
    return seconds(P.flatten_raw(good))


@query
def host_state(spark, sf):
    return M.host_state(T.messages(spark, sf))


@query
def host_state_history(spark, sf):
    out = M.host_state_history(T.messages(spark, sf), block_rows=1024)
    return out.select("hostname", "arrival_seq", "system", "jid", "uid")


@query
def node_map(spark, sf):
    return M.node_map(T.messages(spark, sf))


def message_entries(spark, sf):
    return P.explode_entries(T.messages(spark, sf))


_TAGGED = ["arrival_seq", "client_nid", "client", "system", "jid", "uid", "fid"]


@query
def tag_entries_latest(spark, sf):
    tagged = M.tag_entries(message_entries(spark, sf), M.node_map(T.messages(spark, sf)))
    return tagged.select(*_TAGGED)


@query
def tag_entries_asof(spark, sf):
    messages = T.messages(spark, sf)
    return M.tag_entries_asof(P.explode_entries(messages), messages, block_rows=1024).select(*_TAGGED)


@query
def tag_entries_asof_sparse(spark, sf):
    """The same on an order like nanoseconds, with most of the rows near its end; blocks hold equal rows."""
    messages = T.messages(spark, sf).withColumn("arrival_seq", F.col("arrival_seq") * 1_000_003 + F.lit(1_700_000_000 * 10**9))
    entries = P.explode_entries(messages)
    tagged = M.tag_entries_asof(entries, messages, block_rows=equal_blocks(entries, "arrival_seq", 500))
    place = F.floor((F.col("arrival_seq") - F.lit(1_700_000_000 * 10**9)) / 1_000_003)
    return tagged.withColumn("arrival_seq", place).select(*_TAGGED)


@query
def fs_name_query(spark, sf):
    return message_entries(spark, sf).groupBy(fs_name("target").alias("fid")).agg(F.count(F.lit(1)).alias("n"))



# --- text, mapping tables, host lists ----------------------------------------


@query
def parse_stats_text(spark, sf):
    return captured.parse_stats_text(T.table(spark, sf, T.STATS_LINES)).select("host", "line_no", "key", "value")


@query
def stats_maps(spark, sf):
    maps = captured.stats_maps(captured.parse_stats_text(T.table(spark, sf, T.STATS_LINES)))
    return maps.select("host", "time", F.explode("stats").alias("key", "value"))


@query
def parse_cpu_text(spark, sf):
    return captured.parse_cpu_text(T.table(spark, sf, T.CPU_LINES))


@query
def load_node_map(spark, sf):
    return mappings.load_node_map(T.table(spark, sf, T.NODE_LINES))


@query
def load_job_table(spark, sf):
    jobs, inventory = T.table(spark, sf, T.JOB_LINES), T.table(spark, sf, T.INVENTORY_LINES)
    return mappings.load_job_table(jobs, inventory)[0]


@query
def expand_hosts_query(spark, sf):
    return expand_hosts(T.table(spark, sf, T.HOST_EXPRESSIONS), "expr", ["job"]).select("job", "host", "error")


@query
def collapse_hosts_query(spark, sf):
    return collapse_hosts(T.table(spark, sf, T.MIXED_HOSTS), ["job"], "host", numeric_fields=2, block=64)


@query
def natural_sort(spark, sf):
    """The place of each name among those of its last digit, by the operator's own key."""
    names = T.table(spark, sf, T.HOST_NAMES).withColumn("part", F.right("host", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(natural_key("host")))
    return names.select("part", "host", place.alias("place"))


@query
def expand_tasks_per_node_query(spark, sf):
    return expand_tasks_per_node(T.table(spark, sf, T.TASK_LISTS), "expr", ["job"])



# --- whole feeds, the stored table, streams -----------------------------------

FEED_PARTS, FEED_BLOCK = 3, 64


def feed(spark, sf, late=True):
    lines = T.feed_lines(spark, sf, late).select(F.split("value", "\t", 2).alias("__p"), "arrival_seq")
    parsed = P.parse_reports(lines.select("arrival_seq", F.get("__p", F.lit(1)).alias("msg")))[0]
    return P.store_messages(parsed, T.work_dir(spark), block=FEED_BLOCK)


@query
def reports_to_groups(spark, sf):
    return rounded(seconds(R.group_events(reports.groups_from_messages(feed(spark, sf)))), "value")


@query
def reports_to_groups_range(spark, sf):
    """The reports of some arrivals, from a store of two loads of which one came twice."""
    path, messages = T.work_dir(spark), feed(spark, sf).drop("load", "block")
    for load, part in (("a", "arrival_seq < 480"), ("b", "arrival_seq >= 480"), ("a", "arrival_seq < 480")):
        stored = P.store_messages(messages.where(part), path, load, FEED_BLOCK)
    groups = reports.groups_from_messages(stored, first=400, last=640, lookback=200, block=FEED_BLOCK)
    return rounded(seconds(R.group_events(groups)), "value")


@query
def reports_to_groups_tenth(spark, sf):
    """The reports of a tenth of the feed, from what the blocks before it leave."""
    path, messages = T.work_dir(spark), feed(spark, sf).drop("load", "block")
    end = int(messages.agg(F.max("time")).first()[0] - 1704067200) // 16384 * 8 + 8  # a round of reports has 8 places
    for load, part in (("a", F.col("arrival_seq") < end // 2), ("b", F.col("arrival_seq") >= end // 2)):
        stored = P.store_messages(messages.where(part), path, load, FEED_BLOCK)
    first, last = end * 6 // 10, end * 7 // 10 - 1
    carry = P.read_carry(spark, path)
    groups = reports.groups_from_messages(stored, first=first, last=last, block=FEED_BLOCK, carry=carry)
    return rounded(seconds(R.group_events(groups)), "value")


@query
def reports_to_groups_ticks(spark, sf):
    groups = reports.groups_from_messages(feed(spark, sf, late=False), every=40000.0)
    return rounded(seconds(R.group_events(groups)), "value")


@query
def current_top(spark, sf):
    groups = reports.current_groups(feed(spark, sf), mode="asof")
    return rounded(seconds(reports.top_report(groups, "u", by="iops")), *DERIVED)


def stored_history(spark, sf):
    """The history of the counters, written to a new folder."""
    path = T.work_dir(spark)
    history_table.write_history(H.to_history(G.derive_events(tag_groups(spark, sf))), path)
    return path


@query
def write_history(spark, sf):
    table = history_table.read_history(spark, stored_history(spark, sf))
    return rounded(seconds(table.drop("date")), "value")


COMPACT_NOW = dt.datetime(2024, 1, 12, 13, 0)


@query
def compact_history(spark, sf):
    path = stored_history(spark, sf)
    border = history_table.compact_history(spark, path, path + "-compact", COMPACT_NOW)
    table = history_table.read_history(spark, path, path + "-compact", border)
    old = F.col("date") < F.lit(border)
    return table.groupBy("date", old.alias("compacted")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")
    )


@query
def compact_again(spark, sf):
    """Files of a second run: there is nothing left to do for it."""
    path = stored_history(spark, sf)
    for _ in range(2):
        history_table.compact_history(spark, path, path + "-compact", COMPACT_NOW)
        files = spark.read.parquet(path + "-compact").select(F.col("_metadata.file_path").alias("file")).distinct()
        files.write.mode("append").parquet(path + "-files")
    seen = spark.read.parquet(path + "-files").groupBy("file").agg(F.count(F.lit(1)).alias("runs"))
    return seen.agg(F.count_if(F.col("runs") != 2).alias("new_files"))


@query
def compaction_report(spark, sf):
    path = stored_history(spark, sf)
    history_table.compact_history(spark, path, path + "-compact", COMPACT_NOW)
    report = history_table.compaction_report(spark, path, path + "-compact")
    sized = lambda c: (F.coalesce(c, F.lit(0)) > 0).alias(c.removesuffix("_bytes"))
    return report.select("date", sized("before_bytes"), sized("after_bytes"))


def stored_recent(spark, sf):
    """Some days of history in a new folder, in two writes, with the older days also as segments."""
    path = T.work_dir(spark)
    rows = recent(spark, sf)
    for half in (0, 1):
        history_table.write_history(rows.where(F.pmod(F.unix_seconds(F.col("time").cast("timestamp")), 2) == half), path)
    return path


def packed_recent(spark, sf):
    """The same, read from segments as far as there are any."""
    path = stored_recent(spark, sf)
    border = history_table.compact_history(spark, path, path + "-compact", PACKED_NOW)
    return history_table.read_history(spark, path, path + "-compact", border)


PACKED_NOW = dt.datetime(2024, 1, 20)


@query
def stored_raw_lookup(spark, sf):
    table = history_table.read_history(spark, stored_recent(spark, sf))
    return H.raw_lookup(table, "2024-01-05 00:00:00", HOST, ["nclients", "load_eff"]).drop("date")


@query
def stored_distinct_dims(spark, sf):
    return history_days.distinct_dims(history_days.read_days(spark, stored_recent(spark, sf)))


@query
def stored_active_share(spark, sf):
    path = stored_recent(spark, sf)
    table, days = history_table.read_history(spark, path), history_days.read_days(spark, path)
    out = history_days.latest_active_share(table, days, "jid", "load_eff")
    return rounded(out, "value", "total", "share", "angle")


@query
def stored_job_extent(spark, sf):
    return history_days.job_extent(history_days.read_days(spark, stored_recent(spark, sf)), "j7")


@query
def stored_recent_rows(spark, sf):
    path = stored_recent(spark, sf)
    return history_days.recent_rows(history_table.read_history(spark, path), history_days.read_days(spark, path))


@query
def packed_rows(spark, sf):
    return rounded(packed_recent(spark, sf).drop("date"), "value")


@query
def packed_raw_lookup(spark, sf):
    return H.raw_lookup(packed_recent(spark, sf), "2024-01-05 00:00:00", HOST, ["nclients", "load_eff"]).drop("date")


@query
def packed_gapfill(spark, sf):
    filled = H.gapfill(packed_recent(spark, sf), "1h", START, END)
    return rounded(filled, "value")


@query
def packed_job_detail(spark, sf):
    return rounded(pages.job_detail(packed_recent(spark, sf), "j7"), "value")


@query
def total_bytes(spark, sf):
    return history_table.total_bytes(spark, stored_history(spark, sf)).select((F.col("bytes") > 0).alias("sized"))


@query
def stored_in_range(spark, sf):
    table = history_table.read_history(spark, stored_history(spark, sf))
    return rounded(seconds(H.in_range(table, START, END).drop("date")), "value")


@query
def stored_gapfill(spark, sf):
    table = history_table.read_history(spark, stored_history(spark, sf))
    filled = H.gapfill(table, "6h", START, END, keys=("host", "event"), agg="sum")
    return filled.select(F.unix_seconds("t").alias("t"), "host", "event", F.round("value", 3).alias("value"))


@query
def storage_report(spark, sf):
    report = history_table.storage_report(spark, stored_history(spark, sf))
    return report.select(
        "date", F.col("rows").alias("n"), (F.col("bytes") > 0).alias("sized"),
        F.unix_seconds("first_time").alias("first_time"), F.unix_seconds("last_time").alias("last_time"),
    )


def run_feed(spark, sf, writer_of, without="false"):
    """Run a stream over the feed, one micro-batch for each third of it in arrival order.

    ``without`` tells of a line whether it is left out of the last third.
    """
    path = T.work_dir(spark)
    # a line holds a whole report: text is written and read line by line, and no batch of lines is held
    T.feed_lines(spark, sf).select("value").write.text(path + "/lines")
    seq = F.substring_index(F.left("value", F.lit(20)), "\t", 1).cast("bigint")
    lines = spark.read.text(path + "/lines").withColumn("arrival_seq", seq)
    span = lines.agg(F.max("arrival_seq")).first()[0] + 1
    for n in range(FEED_PARTS):
        part = lines.where(F.floor(F.col("arrival_seq") * FEED_PARTS / span) == n)
        part = part.where(f"not ({without})") if n == FEED_PARTS - 1 else part
        part.select("value").write.mode("append").text(path + "/feed")
        messages = P.parse_reports(P.read_reports(spark, path + "/feed", streaming=True))[0]
        finish(writer_of(messages, path), path)
    return path


def finish(writer, path):
    writer.option("checkpointLocation", path + "/offsets").trigger(availableNow=True).start().awaitTermination()


@query
def stream_rates_query(spark, sf):
    path = run_feed(spark, sf, lambda messages, path: stream_rates(messages, path + "/rates"))
    rows = spark.read.option("basePath", path + "/rates").parquet(path + "/rates")
    rows = seconds(rows).select(
        "server", "time", "client_nid", "target", "client", "system", "jid", "uid", "fid",
        F.explode("rates").alias("event", "rate"),
    )
    return rows.where(~F.col("event").isin(*T.ODD_COUNTERS))


@query
def export_stream_query(spark, sf):
    path = run_feed(spark, sf, lambda messages, path: export_stream(messages, path + "/history"))
    return rounded(seconds(spark.read.parquet(path + "/history").drop("date", "batch_id")), "value")


@query
def export_stream_repeat(spark, sf):
    """The export with the last groups of silent servers; one server sends nothing in the last third."""
    silent = """contains(value, '"hostname":"oss2","time"')"""
    no_data = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(no_data)
    spark.conf.set(no_data, "false")  # timers fire in the next third, not in batches of their own
    try:
        path = run_feed(
            spark, sf,
            lambda messages, path: export_stream(messages, path + "/history", dedupe=False, repeat_after=0.001),
            silent,
        )
    finally:
        spark.conf.set(no_data, before)
    rows = rounded(seconds(spark.read.parquet(path + "/history").drop("date")), "value")
    return rows.withColumnRenamed("batch_id", "part").withColumn("part", F.col("part").cast("int"))


@query
def stream_buckets_late(spark, sf):
    """Sums of a stream whose batches each have rows of all hours."""
    path = T.work_dir(spark)
    rows = recent(spark, sf).withColumn("time", F.timestamp_seconds(epoch_seconds("time")))
    for n in range(3):
        rows.where(F.pmod(F.hash("time", "value"), F.lit(3)) == n).write.mode("append").parquet(path + "/history")
        stream = spark.readStream.schema(rows.schema).parquet(path + "/history")
        finish(export_buckets(stream, "1h", path + "/sums"), path)
    return rounded(bucket_sums(spark, path + "/sums").drop("date").withColumn("t", F.unix_seconds("t")), "value")


@query
def stream_buckets_query(spark, sf):
    path = T.work_dir(spark)
    rows = recent(spark, sf).withColumn("time", F.timestamp_seconds(epoch_seconds("time")))
    rows.write.parquet(path + "/history")
    stream = spark.readStream.schema(rows.schema).parquet(path + "/history")
    writer = stream_buckets(stream, "1h", "0 seconds").writeStream.format("parquet")
    finish(writer.option("path", path + "/sums"), path)
    sums = spark.read.parquet(path + "/sums")
    sums = sums.unionByName(open_buckets(rows, sums, "1h"))
    return rounded(sums.withColumn("t", F.unix_seconds("t")), "value")
