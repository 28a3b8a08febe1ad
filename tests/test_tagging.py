"""Messages, host state, node map and as-of tags."""

import random

import pytest
from pyspark.sql import functions as F

from iolens.functions.blocks import Blocks, equal_blocks
from iolens.functions.names import fs_name
from iolens.operators import tagging as M
from iolens.plans.reports import groups_from_messages
from iolens.schema import MESSAGE_SCHEMA
from iolens.sources import mappings
from iolens.sources import reports as P


def parse(spark, *texts):
    lines = spark.createDataFrame(list(enumerate(texts)), "arrival_seq bigint, msg string")
    return P.parse_reports(lines)


def test_rejects(spark):
    good, bad = parse(
        spark,
        '{"hostname": "a"}',
        '[{"hostname": "b"}, {"jid": "1"}, {"hostname": "c"}]',
        '{"hostname": ',
        'hello {"hostname": "d"}',
        "",
        ' {"hostname": "e"}',
    )
    assert sorted((r.arrival_seq, r.msg_idx, r.hostname) for r in good.collect()) == [(0, 0, "a"), (1, 0, "b"), (1, 2, "c")]
    assert sorted((r.arrival_seq, r.reason) for r in bad.collect()) == [
        (1, "no hostname"), (2, "bad json"), (3, "not a report"), (4, "not a report"), (5, "not a report"),
    ]


def test_every_element_is_a_message_or_a_reject(spark):
    """One odd field or element spoils nothing else."""
    entries = '"data": [{"stats_type": "oss", "stats": {"a": 1}}, 7]'
    good, bad = parse(
        spark,
        '[{"hostname": "a", "jid": "1"}, 5, null, "x", [1], {"hostname": 2}]',
        f'{{"hostname": "b", "time": "12.5", {entries}}}',
        f'{{"hostname": "c", "time": "soon", {entries}}}',
        f'{{"hostname": "d", {entries}}}',
        '{"hostname": "e", "time": 1, "data": {"x": 1}}',
        "[]",
        "[1, 2",
        None,
    )
    got = sorted((r.arrival_seq, r.msg_idx, r.hostname, r.time, r.data and len(r.data)) for r in good.collect())
    assert got == [(0, 0, "a", None, None), (0, 5, "2", None, None), (1, 0, "b", 12.5, 1)]
    assert sorted((r.arrival_seq, r.reason) for r in bad.collect()) == [
        *[(0, "not a report")] * 4, (2, "bad time"), (3, "no time"), (4, "bad data"), (5, "not a report"),
        (6, "bad json"), (7, "not a report"),
    ]


def test_odd_counters_kill_no_job(spark):
    text = '{{"hostname": "o", "time": {0}, "obdclass": "oss", "data": [{{"stats_type": "oss", "client_nid": "n", "target": "fs0-OST0000", "stats": {{"a": 1, "a": {1}, "nclients": 5, "big": 18446744073709551615, "low": -1e30}}}}]}}'
    good, _ = parse(spark, text.format(1, 10), text.format(2, 30))
    stats = [dict(r.stats) for r in P.explode_entries(good).orderBy("time").collect()]
    assert stats[0] == {"a": 10, "nclients": 5, "big": 2**63 - 1, "low": -(2**63)}
    (group,) = groups_from_messages(good).collect()
    assert dict(group.events) == {"a": 20.0, "big": 0.0, "low": 0.0, "nclients": 1.0}
    assert {r.event_name: r.value for r in P.flatten_raw(good).where("time = timestamp_seconds(1)").collect()}["a"] == 10.0


def test_counters_stay_exact(spark):
    good, _ = parse(spark, '{"hostname": "o", "time": 1.5, "data": [{"stats_type": "oss", "stats": {"a": 9007199254740993, "b": 2.9, "c": "x"}}]}')
    (row,) = P.explode_entries(good).collect()
    assert dict(row.stats) == {"a": 9007199254740993, "b": 2, "c": 0}


def test_remap_last_wins(spark):
    good, _ = parse(
        spark,
        '{"hostname": "c1", "jid": "101", "uid": "test1", "nid": "192.168.0.1@o2ib"}',
        '{"hostname": "c1", "jid": "101", "uid": "test2", "nid": "192.168.0.1@o2ib"}',
        '{"hostname": "c0", "jid": "102", "uid": "test2", "nid": "192.168.0.2@o2ib"}',
    )
    got = {r.nid: (r.client, r.jid, r.uid) for r in M.node_map(good).collect()}
    assert got == {"192.168.0.1@o2ib": ("c1", "101", "test2"), "192.168.0.2@o2ib": ("c0", "102", "test2")}


def test_sample_does_not_map_its_node(spark):
    good, _ = parse(spark, '{"hostname": "o", "nid": "n1", "time": 1, "data": []}', '{"hostname": "h", "jid": "3"}')
    assert M.node_map(good).count() == 0
    kinds = {r.hostname: r.kind for r in P.classify_messages(good).collect()}
    assert kinds == {"o": "sample", "h": "host"}
    state = {r.hostname: (r.time, r.jid, r.uid) for r in M.host_state(good).collect()}
    assert state == {"o": (1.0, "*", "*"), "h": (None, "3", "*")}


SAMPLE = '{{"hostname": "oss0", "time": {0}, "obdclass": "oss", "data": [{{"stats_type": "oss", "client_nid": "n1", "target": "blue-OST0000", "stats": {{"a": 1}}}}]}}'


def test_job_begin_and_end(spark):
    good, _ = parse(
        spark,
        SAMPLE.format(1),
        '{"hostname": "c1", "jid": "7", "uid": "ann", "nid": "n1"}',
        SAMPLE.format(2),
        '{"hostname": "c1", "jid": "-", "uid": "-"}',
        SAMPLE.format(3),
    )
    tagged = M.tag_entries_asof(P.explode_entries(good), good, block_rows=2)
    got = [(r.client, r.jid, r.uid, r.system, r.fid) for r in tagged.orderBy("arrival_seq").collect()]
    assert got == [("n1", "*", "*", "*", "blue"), ("c1", "7", "ann", "*", "blue"), ("c1", "-", "-", "*", "blue")]
    latest = M.tag_entries(P.explode_entries(good), M.node_map(good))
    assert {(r.client, r.jid) for r in latest.collect()} == {("c1", "-")}


@pytest.mark.parametrize("block", [3, 1000])
def test_asof_tags_equal_a_replay(spark, block):
    rng = random.Random(block)
    rows, want, nodes, hosts = [], [], {}, {}
    for seq in range(150):
        kind = rng.choice(["sample", "sample", "node", "host"])
        host, nid = rng.choice("abc"), rng.choice(["n1", "n1", "n1", "n2"])
        system, jid = rng.choice([None, "s1", "s2"]), rng.choice([None, "-", str(seq)])
        if kind == "sample":
            data = [("oss", "fs0-OST0000", nid, None, {"a": "1"})]
            rows.append((seq, 0, "oss0", float(seq), "oss", "own", None, None, None, data))
            tags = hosts.get(nodes.get(nid), {})
            want.append((seq, nodes.get(nid, nid), tags.get("system", "*"), tags.get("jid", "*")))
            continue
        if kind == "node":
            nodes[nid] = host
        hosts.setdefault(host, {}).update({k: v for k, v in (("system", system), ("jid", jid)) if v is not None})
        rows.append((seq, 0, host, None, None, nid if kind == "node" else None, system, jid, None, None))
    element = MESSAGE_SCHEMA.removeprefix("array<struct<").removesuffix(">>")
    order = "arrival_seq bigint, msg_idx int, " + element
    messages = spark.createDataFrame(rows, order)
    tagged = M.tag_entries_asof(P.explode_entries(messages), messages, block_rows=block)
    got = sorted((r.arrival_seq, r.client, r.system, r.jid) for r in tagged.collect())
    assert got == want


def test_fs_name(spark):
    names = ["blue-OST0000", "short", "12345678", "x" * 40, None]
    df = spark.createDataFrame([(n,) for n in names], "t string").select(fs_name("t").alias("f"))
    assert [r.f for r in df.collect()] == ["blue", "*", "", "x" * 32, "*"]


def test_flatten_and_migrate(spark):
    good, _ = parse(spark, SAMPLE.format(2))
    (raw,) = P.flatten_raw(good).collect()
    assert (raw.hostname, raw.client_nid, raw.event_name, raw.value) == ("oss0", "n1", "a", 1.0)
    (row,) = P.migrate_raw(P.flatten_raw(good)).collect()
    assert (row.client, row.fid, row.event_name) == ("n1", None, "a")
    (row,) = P.migrate_raw(P.flatten_raw(good), derive_fid=True).collect()
    assert row.fid == "blue"


def test_node_file(spark):
    lines = ["n1 c1.sys1.org", "n2 nodot", "n3 f.x.y c3.sys3", "n4 f.sys4 c4", "n5", ""]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")
    two = {(r.hostname, r.nid, r.system) for r in mappings.load_node_map(df).collect()}
    assert two == {("c1.sys1.org", "n1", "sys1")}
    three = {(r.hostname, r.nid, r.system) for r in mappings.load_node_map(df, three_col=True).collect()}
    assert three == {("c1.sys1.org", "n1", "sys1"), ("c3.sys3", "n3", "sys3"), ("c4", "n4", "sys4")}


def test_job_listing(spark):
    jobs = ["11 ann run c[1-2]", "12 bob run c2,c9", "13 short", "14 eve run c[2-1]"]
    inventory = ["c[1-3]"]
    as_lines = lambda x: spark.createDataFrame(list(enumerate(x)), "line_no bigint, line string")
    table, bad = mappings.load_job_table(as_lines(jobs), as_lines(inventory))
    got = {r.hostname: (r.jid, r.uid) for r in table.collect()}
    assert got == {"c1": ("11", "ann"), "c2": ("12", "bob"), "c3": ("-", "-"), "c9": ("12", "bob")}
    assert {(r.line_no, r.error) for r in bad.collect()} == {(2, "too few columns"), (3, "start > stop")}


def test_blocks_of_a_sparse_order_hold_equal_rows(spark):
    """Nanoseconds of which most are in one second, and one host with 90 % of the rows: no block is far over the median."""
    start = 1_700_000_000 * 10**9
    sparse = F.when(F.col("id") % 10 == 0, start + F.col("id") * 10**12).otherwise(start + F.col("id") * 7)
    df = spark.range(200_000).select(sparse.alias("at"), F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("h"), F.col("id") % 7)).alias("host"))
    for rows, factor in ((2_000, 2), (100, 5)):  # the second has more blocks than quantiles
        blocks = equal_blocks(df, "at", rows)
        sizes = sorted(r["count"] for r in df.groupBy(blocks.of(F.col("at")).alias("b")).count().collect())
        assert sum(sizes) == 200_000 and sizes[-1] <= factor * max(rows, sizes[len(sizes) // 2])
    assert equal_blocks(df.limit(0), "at", 10) == Blocks([0, 0]) and len(equal_blocks(df, "at", 10**6).borders) == 2
