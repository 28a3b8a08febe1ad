"""A feed read as a stream gives what one batch run over it gives."""

import json
import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from iolens.operators.rates import rates
from iolens.operators.tagging import tag_entries_asof
from iolens.sources import reports as P
from iolens.streaming.steps import _EVENT, PARTS, REPORTS, HostOfNode, events_of
from iolens.streaming.reports import (
    _latest_rates,
    bucket_sums,
    export_buckets,
    export_stream,
    open_buckets,
    stream_buckets,
    stream_rates,
)


def feed(n=24, seed=2):
    """Reports of two servers, some late, with node and job messages between them."""
    rng, out = random.Random(seed), []
    for seq in range(n):
        kind = rng.choice(["sample", "sample", "sample", "node", "host"])
        if kind == "sample":
            host = rng.choice(["oss0", "oss0", "oss1"])
            data = [{"stats_type": "cpu", "stats": {"system": seq * 10}}] + [
                {"stats_type": "oss", "client_nid": f"n{c}", "target": "fs0-OST0000", "stats": {"open": rng.randint(0, 99)}}
                for c in rng.sample(range(3), 2)
            ]
            out.append({"hostname": host, "time": float(seq * 10 - rng.choice([0, 0, 0, 45])), "obdclass": "oss", "data": data})
        elif kind == "node":
            out.append({"hostname": f"c{rng.randint(0, 1)}", "nid": f"n{rng.randint(0, 2)}", "system": "s"})
        else:
            out.append({"hostname": f"c{rng.randint(0, 1)}", "jid": rng.choice(["-", str(seq)]), "uid": "u"})
    return out


def write_feed(path, messages, per_file):
    path.mkdir()
    for n in range(0, len(messages), per_file):
        text = "".join(f"{i}\t{json.dumps(m)}\n" for i, m in enumerate(messages[n : n + per_file], n))
        (path / f"{n:05d}.txt").write_text(text)
        # the file source goes by modification time
        os.utime(path / f"{n:05d}.txt", (1_700_000_000 + n, 1_700_000_000 + n))


def start(spark, tmp_path, make, per_file=12):
    write_feed(tmp_path / "feed", feed(), per_file)
    lines = P.read_reports(spark, str(tmp_path / "feed"), streaming=True, maxFilesPerTrigger=1)
    writer = make(P.parse_reports(lines)[0])
    writer.option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()


def batch_rates(spark, tmp_path):
    messages = P.parse_reports(P.read_reports(spark, str(tmp_path / "feed")))[0].persist()
    tagged = tag_entries_asof(P.explode_entries(messages), messages)
    return rates(tagged, P.samples_of(messages))


def plain(df):
    rows = df.select("server", F.unix_micros("time").alias("t"), "client_nid", "client", "jid", "uid", F.explode("rates").alias("e", "v"))
    return sorted((tuple(r) for r in rows.collect()), key=str)


def test_stream_equals_batch(spark, tmp_path):
    out = str(tmp_path / "rates")
    start(spark, tmp_path, lambda m: stream_rates(m, out))
    got = plain(spark.read.option("basePath", out).parquet(out))
    assert got and got == plain(batch_rates(spark, tmp_path))


def sample(seq, host, time, client="n", opens=None):
    data = [{"stats_type": "oss", "client_nid": client, "target": "fs0-OST0000", "stats": {"open": seq if opens is None else opens}}]
    return {"hostname": host, "time": float(time), "obdclass": "oss", "data": data}


def in_steps(spark, tmp_path, parts, make, wait=0.0):
    """One run of the stream for each part of a feed, with the same checkpoint; without batches that have no data."""
    (tmp_path / "feed").mkdir()
    seq, before = 0, spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for n, part in enumerate(parts):
            (tmp_path / "feed" / f"{n}.txt").write_text("".join(f"{i}\t{json.dumps(m)}\n" for i, m in enumerate(part, seq)))
            seq += len(part)
            writer = make(P.parse_reports(P.read_reports(spark, str(tmp_path / "feed"), streaming=True))[0])
            writer.option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()
            time.sleep(wait)
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", before)


def test_mappings_change_across_restarts(spark, tmp_path):
    """A node id moves to another host, and a host to another job, each in a run of its own."""
    node = lambda host: {"hostname": host, "nid": "n"}
    tags = lambda host, job: {"hostname": host, "jid": job, "uid": "u"}
    parts = [
        [sample(0, "oss0", 1), node("c0"), tags("c0", "1"), sample(3, "oss0", 2)],
        [sample(4, "oss0", 3), node("c1"), sample(6, "oss0", 4), tags("c1", "2"), tags("c0", "9")],
        [sample(9, "oss0", 4), sample(10, "oss0", 5), node("c0"), {"hostname": "c0", "uid": "v"}, sample(13, "oss0", 6)],
    ]
    out = str(tmp_path / "rates")
    in_steps(spark, tmp_path, parts, lambda m: stream_rates(m, out))
    rows = spark.read.parquet(out).orderBy("time")
    got = [(r.t, r.client, r.jid, r.uid) for r in rows.select(F.unix_seconds("time").alias("t"), "*").collect()]
    assert got == [(2, "c0", "1", "u"), (3, "c0", "1", "u"), (4, "c1", "*", "*"), (5, "c1", "2", "u"), (6, "c0", "9", "v")]
    assert plain(rows) == plain(batch_rates(spark, tmp_path))


def test_replayed_batch_gives_the_same_rows(spark, tmp_path):
    """The last run ends before its commit is noted, and is done again."""
    parts, out = [feed()[:8], feed()[8:16], feed()[16:]], str(tmp_path / "rates")
    in_steps(spark, tmp_path, parts, lambda m: stream_rates(m, out))
    want = plain(batch_rates(spark, tmp_path))
    assert want and plain(spark.read.parquet(out)) == want
    last = max(int(f.name) for f in (tmp_path / "offsets/commits").iterdir() if f.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "offsets/commits" / name).unlink(missing_ok=True)
    messages = P.parse_reports(P.read_reports(spark, str(tmp_path / "feed"), streaming=True))[0]
    writer = stream_rates(messages, out).option("checkpointLocation", str(tmp_path / "offsets"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert plain(spark.read.parquet(out)) == want


@pytest.mark.parametrize("idle", [None, 0.05])
def test_idle_hosts_are_forgotten(spark, tmp_path, idle):
    parts = [
        [sample(0, "old", 1), sample(1, "new", 100)],
        [sample(2, "new", 200)],
        [sample(3, "new", 300)],
        [sample(4, "old", 310), sample(5, "new", 320)],
    ]
    out = str(tmp_path / "rates")
    in_steps(spark, tmp_path, parts, lambda m: stream_rates(m, out, idle_after=idle), wait=0.2 if idle else 0)
    servers = {r.server for r in spark.read.parquet(out).select("server").distinct().collect()}
    # with so short a time each host is idle whenever it is not in a batch; a host in the batch goes on
    assert servers == ({"new"} if idle else {"old", "new"})


@pytest.mark.parametrize("dedupe", [True, False])
def test_export_appends_the_latest_groups(spark, tmp_path, dedupe):
    out = str(tmp_path / "history")
    parts = [
        [sample(0, "oss0", 1), sample(1, "oss0", 2), sample(2, "oss1", 1), sample(3, "oss1", 3)],
        [sample(4, "oss0", 5), sample(5, "oss1", 3), sample(6, "oss2", 1)],
        [sample(7, "oss0", 6), sample(8, "oss0", 8)],
    ]
    in_steps(spark, tmp_path, parts, lambda m: export_stream(m, out, dedupe=dedupe, repeat_after=0.001))
    rows = spark.read.parquet(out).where("event = 'open'")
    got = sorted((r.batch_id, r.host, r.t, r.value) for r in rows.select(F.unix_seconds("time").alias("t"), "*").collect())
    want = [(0, "oss0", 2, 1.0), (0, "oss1", 3, 0.5), (1, "oss0", 5, 1.0), (2, "oss0", 8, 0.5)]
    repeated = [(1, "oss1", 3, 0.5), (2, "oss1", 3, 0.5)]
    assert got == (want if dedupe else sorted(want + repeated))


def test_buckets_close_after_the_delay(spark, tmp_path):
    rows = [(m * 60.0, "oss0", 1.0) for m in range(0, 95)]
    df = spark.createDataFrame(rows, "s double, host string, value double").select(
        F.timestamp_seconds("s").alias("time"), "host",
        *[F.lit("*").alias(c) for c in ("system", "fid", "jid", "uid", "client")], F.lit("iops").alias("event"), "value",
    )
    df.write.parquet(str(tmp_path / "h"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "h"))
    writer = stream_buckets(stream, "30m", "5 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()
    got = {r.t.hour * 60 + r.t.minute: r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: 30.0, 30: 30.0}
    rest = open_buckets(df, spark.read.parquet(str(tmp_path / "out")), "30m")
    assert {r.t.hour * 60 + r.t.minute: r.value for r in rest.collect()} == {60: 30.0, 90: 5.0}
    whole = open_buckets(df, spark.read.parquet(str(tmp_path / "out")).limit(0), "30m")
    assert whole.agg(F.sum("value")).first()[0] == 95.0


def test_late_rows_correct_their_buckets(spark, tmp_path):
    """Rows of a bucket in three batches, the last long after; the second batch is run again."""
    columns = [F.lit("*").alias(c) for c in ("system", "fid", "jid", "uid", "client")]
    make = lambda rows: spark.createDataFrame(rows, "s double, host string, value double").select(
        F.timestamp_seconds("s").alias("time"), "host", *columns, F.lit("iops").alias("event"), "value")
    parts = [[(60.0, "a", 1.0), (86_000.0, "a", 2.0)], [(3_700.0, "a", 4.0), (90_000.0, "b", 8.0)], [(120.0, "a", 16.0), (90_060.0, "b", 32.0)]]
    sums, feed_ = str(tmp_path / "sums"), str(tmp_path / "h")
    for n, part in enumerate(parts):
        make(part).coalesce(1).write.mode("append").parquet(feed_)
        stream = spark.readStream.schema(make(part).schema).parquet(feed_)
        writer = export_buckets(stream, "1h", sums).option("checkpointLocation", str(tmp_path / "offsets"))
        writer.trigger(availableNow=True).start().awaitTermination()
        if n == 1:  # as if the run had ended before its commit was noted
            (tmp_path / "offsets/commits/1").unlink()
            (tmp_path / "offsets/commits/.1.crc").unlink(missing_ok=True)
    got = {(r.host, r.t.timestamp()): r.value for r in bucket_sums(spark, sums).collect()}
    assert got == {("a", 0.0): 17.0, ("a", 3600.0): 4.0, ("a", 82_800.0): 2.0, ("b", 90_000.0): 40.0}


def test_parts_of_a_report(spark, tmp_path):
    """No event holds more than a part of a report; entries keep their numbers, and the last of equal ones counts."""
    rng = random.Random(5)
    entry = lambda c, v: {"stats_type": "oss", "client_nid": f"n{c}", "target": "fs0-OST0000", "stats": {"open": v}}
    parts = []
    for n in range(3):
        data = [{"stats_type": "cpu", "client_nid": "n7", "stats": {"system": n}}, {"stats_type": "cpu", "stats": {"system": 10 * n}}]
        data += [entry(c, rng.randint(0, 99)) for c in range(200)] + [entry(3, n)]
        parts.append([{"hostname": "oss0", "time": float(n + 1), "obdclass": "oss", "data": data}, {"hostname": f"c{n}", "nid": "n3"}])
    out = str(tmp_path / "rates")
    in_steps(spark, tmp_path, parts, lambda m: stream_rates(m, out))
    numbered = lambda df: sorted((r.t, r.entry_idx, r.client or "", r.rates["open"] if "open" in r.rates else r.rates["system"])
                                 for r in df.select(F.unix_micros("time").alias("t"), "*").collect())
    got = numbered(spark.read.parquet(out))
    assert len(got) == 2 * 203 and got == numbered(batch_rates(spark, tmp_path))
    messages = P.parse_reports(P.read_reports(spark, str(tmp_path / "feed")))[0]
    found = [r for r in events_of(messages).collect() if r.what == "sample"]
    assert len(found) == 3 * PARTS and max(len(json.loads(r.report)) for r in found) < 60


class Held:
    """A list state, and the handle that gives it."""

    def __init__(self):
        self.rows = []

    def getListState(self, name, schema):
        return self

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows


def test_many_names_of_a_key():
    """A step handles all names of a key at once, each with what was told of it before, in this batch or an earlier one."""
    step, held = HostOfNode(), Held()
    step.init(held)
    columns = ["what", "arrival_seq", "nid", "client"]
    run = lambda rows: [tuple(r) for part in step.handleInputRows((3,), iter([pd.DataFrame(rows, columns=columns).assign(msg_idx=0).reindex(columns=list(_EVENT))]), None)
                        for r in part[["arrival_seq", "nid", "client"]].astype(object).where(part.notna(), None).itertuples(index=False)]
    first = run([("ask", 0, "a", None), ("node", 1, "a", "c0"), ("node", 1, "b", "c1"), ("ask", 3, "b", None), ("ask", 2, "a", None), ("ask", 4, "x", None)])
    assert first == [(0, "a", None), (2, "a", "c0"), (3, "b", "c1"), (4, "x", None)]
    assert sorted(held.rows) == [("a", "c0"), ("b", "c1")]
    assert run([("node", 6, "a", "c9"), ("ask", 5, "a", None), ("ask", 7, "a", None), ("ask", 8, "b", None)]) == [(5, "a", "c0"), (7, "a", "c9"), (8, "b", "c1")]
    assert sorted(held.rows) == [("a", "c9"), ("b", "c1")]


def test_latest_rates_read_the_last_reports(spark):
    """Of most hosts the last two; of one whose last two have no client in common the last that go together."""
    def rows(host, clients):
        entry = lambda n, c: {"at": 0, "stats_type": "oss", "client_nid": c, "target": "fs0-OST0000", "stats": {"open": str(n * n)}}
        return [(host, n, 0, float(n), float(n - 1) if n else None, n, "oss", json.dumps([entry(n, c)]), "{}") for n, c in enumerate(clients)]

    reports = spark.createDataFrame(rows("same", "aaaa") + rows("other", "aaab") + rows("none", "abcd"), REPORTS)
    found, latest = _latest_rates(reports)
    got = {(r.server, r.t, r.v) for r in found.select("server", F.unix_seconds("time").alias("t"), F.col("rates")["open"].alias("v")).collect()}
    assert got == {("same", 3, 5.0), ("other", 1, 1.0), ("other", 2, 3.0)}
    assert {(r.server, r.t) for r in latest.select("server", F.unix_seconds("time").alias("t")).collect()} == {("same", 3), ("other", 2)}
