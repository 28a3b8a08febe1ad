"""What the physical plans of the registered queries must and must not hold."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from checks import compare  # noqa: E402
from checks.oracles import ORACLES  # noqa: E402
from checks.queries import QUERIES  # noqa: E402
from checks import tables as T  # noqa: E402
from iolens.operators import tagging as M  # noqa: E402
from iolens.operators.rates import aggregate_with_load, rates  # noqa: E402
from iolens.plans.reports import current_groups, groups_from_messages  # noqa: E402
from iolens.sources import reports as P  # noqa: E402

SF = "/root/testdata/sf0.001"
WRITING = {
    "write_history", "compact_history", "storage_report", "stream_rates", "export_stream", "stream_buckets",
    "export_stream_repeat", "stream_buckets_late",
    "reports_to_groups", "current_top", "reports_to_groups_range", "reports_to_groups_ticks",
    "compact_again", "compaction_report", "total_bytes", "stored_in_range", "stored_gapfill",
}
# variants of a plan that is looked at already
ALIKE = {*(f"group_{x}" for x in "fujsn"), "filter_user", "filter_job", "filter_server", "own_rows", "derive_events",
         "load_eff", "top_detailed", "nclients", "aggregate_by_tags", "rank_load_eff", "to_history", "top_events"}

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not there")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_agree():
    assert set(ORACLES) == set(QUERIES)
    assert set(queries()) >= set(QUERIES) and set(oracle_sql()) <= set(queries())


def test_entry_without_the_part_that_may_be_absent(monkeypatch):
    """Without the folder of the training-text operators the rest is registered as before."""
    import importlib
    import importlib.util

    import __spark_entry__

    found = importlib.util.find_spec
    absent = ("iolens.llm", "corpus_pipeline")
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in absent else found(name, *a))
    assert set(importlib.reload(__spark_entry__).queries()) == set(QUERIES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_no_cross_join_python_or_single_task(spark):
    for name, query in QUERIES.items():
        if name in WRITING | ALIKE:
            continue
        text = plan(query(spark, SF))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
            assert bad not in text, (name, bad)
        # one task only for a total or a top-k
        if "SinglePartition" in text:
            assert name in {"colour_range", "bucket_width", "job_extent", "page", "recent_rows", "job_detail",
                            "stored_job_extent", "stored_recent_rows", "packed_job_detail"}, name


def test_rate_plan_shuffles(spark):
    """Entries move once, for the samples of a client; then only summed rows move."""
    path = T.work_dir(spark)
    T.entries(spark, SF).write.parquet(path)
    stored = spark.read.parquet(path)
    samples = stored.select("host", "arrival_seq", "msg_idx", "time").distinct()
    text = plan(aggregate_with_load(rates(stored, samples)))
    wide = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text) if "client_nid" in x]
    assert len(wide) == 1
    by_report = re.findall(r"Exchange hashpartitioning\(server#\d+, time#\d+, \d+\)", text)
    assert len(by_report) == 1
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    assert sorted("stats#" in s for s in scans) == [False] * (len(scans) - 1) + [True]


def test_stored_messages_are_read_in_part(spark):
    """Only the entries themselves read the counters; node messages have their own files."""
    stored = P.store_messages(T.feed_messages(spark, SF), T.work_dir(spark))
    assert "stats" not in plan(P.samples_of(stored)) and "data#" not in plan(P.samples_of(stored))
    assert "stats:map" not in plan(P.clients_of(stored))
    assert "data#" not in plan(M.node_map(stored))
    assert "PartitionFilters: [isnotnull(kind" in plan(M.node_map(stored))
    text = plan(groups_from_messages(stored))
    assert text.count("stats:map") == 1


def test_reports_move_twice_at_most(spark):
    """Where nothing can be broadcast: counters move once as reports, once as entries."""
    stored = P.store_messages(T.feed_messages(spark, SF), T.work_dir(spark))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame, scans in ((groups_from_messages(stored), 1), (current_groups(stored), 2)):
            mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
            text = frame._jdf.queryExecution().explainString(mode)
            moved = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", text)
            assert moved
            wide = [c for c in moved if re.search(r"\b(stats|data)#", c)]
            assert len(wide) <= 2, wide
            reads = re.findall(r"Output \[\d+\]: \[([^\]]*)\]\s*\nBatched: \w+\s*\nLocation", text)
            assert sum("data#" in c for c in reads) <= scans, reads
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_store_is_read_in_part(spark):
    path = T.work_dir(spark)
    feed = T.feed_messages(spark, SF)
    for load, part in (("a", "arrival_seq < 300"), ("b", "arrival_seq >= 300"), ("a", "arrival_seq < 300")):
        stored = P.store_messages(feed.where(part), path, load, block=64)
    assert stored.count() == feed.count()
    near = P.messages_between(stored, 400, 500, lookback=50, block=64)
    assert "block" in plan(near).split("PartitionFilters")[1].split("]")[0]
    samples = P.samples_of(near).agg({"arrival_seq": "min"}).first()[0], P.samples_of(near).agg({"arrival_seq": "max"}).first()[0]
    assert 350 <= samples[0] and samples[1] <= 500
    assert M.node_map(near).count() == M.node_map(stored.where("arrival_seq <= 500")).count()


@pytest.mark.parametrize("first,last", [(0, 20), (17, 33), (32, 63), (70, 10_000), (100_000, 100_001)])
def test_range_from_the_carry_of_older_blocks(spark, first, last):
    """The rows of the whole feed; before the block of the range only one report a host is read."""
    path = T.work_dir(spark)
    feed = T.feed_messages(spark, SF).where("arrival_seq < 120")
    quiet = feed.where("arrival_seq >= 16 or hostname <> 'oss1'")  # a host that is silent for blocks
    for load, part in (("a", "arrival_seq % 3 = 0"), ("b", "arrival_seq % 3 > 0")):
        stored = P.store_messages(quiet.where(part), path, load, block=16)
    carry = P.read_carry(spark, path)
    want = groups_from_messages(stored, first=first, last=last, lookback=1 << 20, block=16)
    got = groups_from_messages(stored, first=first, last=last, block=16, carry=carry)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want)
    text = plan(P.carried_between(stored, carry, first, last, 16))
    assert "block" in text.split("PartitionFilters")[1].split("]")[0] and "CartesianProduct" not in text
    taken = P.carried_between(stored, carry, first, last, 16).where("data is not null and arrival_seq < %d" % first)
    assert taken.groupBy("hostname").count().where("count > 1").count() == 0


@pytest.mark.parametrize("every", [None, 10.0])
def test_range_goes_on_from_older_reports(spark, every):
    """A host silent for longer than the look-back has its rate, and its late report is rejected."""
    report = lambda host, time, n: (
        f'{{"hostname":"{host}","obdclass":"mds","time":{time},"jid":"j{n}","data":[{{"stats_type":"mds","target":"fs-MDT0000",'
        f'"client_nid":"c@tcp","stats":{{"open":"{n}"}}}}]}}'
    )
    feed = [(1, report("quiet", 100, 5)), (2, report("quiet", 90, 3)), (3, report("late", 200, 7))]
    feed += [(10 + i, report("busy", 100 + 20 * i, i)) for i in range(30)]
    feed += [(41, report("quiet", 140, 25)), (42, report("late", 150, 9)), (43, report("late", 240, 47))]
    messages = P.parse_reports(spark.createDataFrame(feed, "arrival_seq long, msg string"))[0]
    stored = P.store_messages(messages, T.work_dir(spark), block=8)
    rows = lambda df: sorted((r.server, r.time, r.jid, sorted(r.events.items())) for r in df.collect())
    want = [r for r in rows(groups_from_messages(stored, every=every)) if r[0] != "busy"]
    got = rows(groups_from_messages(stored, every=every, first=40, last=50, lookback=4, block=8))
    assert len(want) == 2 and got == want


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:2] == ["server", "time"] and 0 < df.count() <= 20


@pytest.mark.parametrize(
    "name",
    ["accept_samples", "top_summary", "gapfill_avg", "latest_active_share", "parse_reports", "tag_entries_asof", "load_job_table",
     "collapse_hosts"],
)
def test_query_equals_sql(spark, name):
    """A few of them; ``python -m checks.compare`` runs all."""
    text, n = compare.difference(spark, compare.duck(SF), SF, queries()[name], oracle_sql()[name])
    assert not text and n


def test_large_reports_are_stored_in_pieces(spark):
    """No stored row has more than a piece of a report; groups are those of the whole reports."""
    entry = lambda c, n: f'{{"stats_type":"oss","target":"fs{c % 3}-OST0000","client_nid":"n{c % 700}@tcp","stats":{{"open":"{c * n}"}}}}'
    feed = [(10 * n + 5, '{"hostname":"oss0","obdclass":"oss","time":%d,"data":[%s]}' % (
        100 * n, ",".join(['{"stats_type":"cpu","stats":{"system":"%d"}}' % n] + [entry(c, n) for c in range(900)]))) for n in range(1, 5)]
    feed += [(8 * c % 30, f'{{"hostname":"h{c}","nid":"n{c}@tcp","jid":"j{c % 4}","uid":"u"}}') for c in range(0, 700, 7)]
    messages = P.parse_reports(spark.createDataFrame(feed, "arrival_seq long, msg string"))[0]
    stored = P.store_messages(messages, T.work_dir(spark), block=16)
    assert stored.selectExpr("max(size(data))").first()[0] <= P.PIECE and stored.where("data is not null").count() == 4 * 4
    again = P.store_messages(stored.drop("load", "block"), T.work_dir(spark), block=16)
    rows = lambda df: sorted((r.server, r.time, r.jid, r.fid, sorted(r.events.items())) for r in df.collect())
    want = rows(groups_from_messages(messages))
    assert want and rows(groups_from_messages(stored)) == want == rows(groups_from_messages(again))
    assert P.samples_of(stored).count() == 4
    numbers = P.explode_entries(stored).groupBy("arrival_seq").agg({"entry_idx": "max", "*": "count"}).collect()
    assert [tuple(r)[1:] for r in numbers] in ([(900, 901)] * 4, [(901, 900)] * 4)
