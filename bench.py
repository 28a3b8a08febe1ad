"""Time the headline jobs and print one JSON line.

Inputs are shaped from the driver's tables once, as stored Parquet or text; that
time is given as ``prepare`` and is not part of the total.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import tables as T
from iolens.functions.hostlists import collapse_hosts, expand_hosts
from iolens.operators import groups as G
from iolens.operators import history as H
from iolens.operators import rates as R
from iolens.operators import tagging as M
from iolens.plans import pages, reports
from iolens.sources import captured, history_table
from iolens.sources import reports as P
from iolens.streaming.reports import stream_rates

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("iolens-bench")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="iolens-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession, root: str) -> dict[str, DataFrame]:

    def stored(name: str, df: DataFrame) -> DataFrame:
        # as many files as cores; the driver's tables are one file each
        df.repartition(CPUS).write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    tables = {
        "entries": stored("entries", T.entries(spark, SF_DIR)),
        "feed": P.store_messages(T.feed_messages(spark, SF_DIR).repartition(CPUS), f"{root}/feed"),
        "messages": stored("messages", T.messages(spark, SF_DIR)),
        "stats_lines": stored("stats_lines", T.table(spark, SF_DIR, T.STATS_LINES)),
        "history": T.table(spark, SF_DIR, T.HISTORY),
        "recent": T.table(spark, SF_DIR, T.RECENT),
        "expressions": stored("expressions", T.table(spark, SF_DIR, T.HOST_EXPRESSIONS)),
        "group_hosts": stored("group_hosts", T.table(spark, SF_DIR, T.GROUP_HOSTS)),
    }
    fields = ["hostname", "time", "obdclass", "nid", "system", "jid", "uid", "data"]
    tables["feed_text"] = stored(
        "feed_text", tables["feed"].select("arrival_seq", F.to_json(F.struct(*fields)).alias("msg"))
    )
    tables["groups"] = stored("groups", reports.groups_from_entries(tables["entries"]))
    history_table.write_history(H.to_history(G.derive_events(tables["groups"])), f"{root}/history")
    tables["stored_history"] = history_table.read_history(spark, f"{root}/history")
    return tables


def jobs(spark: SparkSession, t: dict[str, DataFrame], root: str) -> dict:
    start, end = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25)
    return {
        "parse_reports": lambda: P.parse_reports(t["feed_text"])[0],
        "accept_samples": lambda: R.accept_samples(P.samples_of(t["feed"])),
        "tag_entries_latest": lambda: M.tag_entries(P.explode_entries(t["feed"]), M.node_map(t["feed"])),
        "tag_entries_asof": lambda: M.tag_entries_asof(
            P.explode_entries(t["feed"]), t["feed"], clients=P.clients_of(t["feed"])
        ),
        "host_state": lambda: M.host_state(t["messages"]),
        "rates": lambda: R.rates(t["entries"]),
        "rates_to_groups": lambda: reports.groups_from_entries(t["entries"]),
        "reports_to_groups": lambda: reports.groups_from_messages(t["feed"]),
        "current_groups": lambda: reports.current_groups(t["feed"]),
        "group_levels": lambda: G.group_levels(t["groups"], "fujsn"),
        "top_report": lambda: reports.top_report(t["groups"], "u"),
        "to_history": lambda: H.to_history(G.derive_events(t["groups"])),
        "stored_history_day": lambda: H.bucket_sum_by_host(
            H.in_range(t["stored_history"], dt.datetime(2024, 1, 9), dt.datetime(2024, 1, 10)), "1h", "iops"
        ),
        "bucket_sum_by_tag": lambda: H.bucket_sum_by_tag(t["history"], "1d", "uid", "iops"),
        "latest_active_share": lambda: H.latest_active_share(t["history"], "jid", "load_eff"),
        "gapfill_avg": lambda: H.gapfill(t["recent"], "1h", start, end),
        "job_detail": lambda: pages.job_detail(t["recent"], "j7"),
        "parse_stats_text": lambda: captured.parse_stats_text(t["stats_lines"]),
        "reports_to_groups_range": lambda: reports.groups_from_messages(t["feed"], first=400, last=480, lookback=64),
        "compact_history": lambda: compacted(spark, f"{root}/history"),
        "stream_rates": lambda: streamed(spark, f"{root}/feed_text"),
        "expand_hosts": lambda: expand_hosts(t["expressions"], "expr", ["job"]),
        "collapse_hosts": lambda: collapse_hosts(t["group_hosts"], ["job"], "host", numeric_fields=1),
    }


def compacted(spark: SparkSession, history: str) -> DataFrame:
    """Compact the stored history into a new folder."""
    path = T.work_dir(spark)
    border = history_table.compact_history(spark, history, path, dt.datetime(2024, 3, 1))
    return history_table.read_history(spark, history, path, border)


def streamed(spark: SparkSession, feed: str) -> DataFrame:
    """One micro-batch of rates over the whole feed."""
    path = T.work_dir(spark)
    stream = spark.readStream.schema("arrival_seq bigint, msg string").parquet(feed)
    writer = stream_rates(P.parse_reports(stream)[0], f"{path}/rates")
    writer.option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rates")


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    begin = time.perf_counter()
    root = T.work_dir(spark)
    tables = prepare(spark, root)
    prepared = time.perf_counter() - begin
    times = {}
    wanted = sys.argv[1:]
    for name, job in jobs(spark, tables, root).items():
        if wanted and name not in wanted:
            continue
        begin = time.perf_counter()
        run(job())
        times[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline jobs",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": CPUS,
                "prepare": round(prepared, 3),
            }
        )
    )


if __name__ == "__main__":
    main()
