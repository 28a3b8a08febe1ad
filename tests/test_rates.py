"""Sample acceptance, rates, tag groups and derived events."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from iolens.operators import groups as G
from iolens.operators import rates as R

ENTRY = (
    "host string, arrival_seq bigint, msg_idx int, time double, obdclass string, entry_idx int, "
    "stats_type string, client_nid string, target string, client string, system string, jid string, "
    "uid string, fid string, stats map<string,bigint>"
)
GROUP = "server string, time timestamp, system string, fid string, jid string, uid string, events map<string,double>"


def entry(seq, time, stats, nid="n1", target="fs0-OST0000", idx=0, host="oss0", kind="oss", tags=None, cls="oss"):
    tags = {"client": nid, "system": "*", "jid": "*", "uid": "*", "fid": (target or "")[:-8], **(tags or {})}
    return (host, seq, 0, float(time), cls, idx, kind, nid, target, *[tags[c] for c in ("client", "system", "jid", "uid", "fid")], stats)


def rows(spark, entries, **options):
    df = R.rates(spark.createDataFrame(entries, ENTRY), **options)
    return df.withColumn("time", F.col("time").cast("double"))


def as_dict(df):
    return {(r.server, r.time, r.client_nid, r.target): dict(r.rates) for r in df.collect()}


def test_rate_and_reset(spark):
    got = as_dict(rows(spark, [entry(1, 0, {"a": 10}), entry(2, 4, {"a": 30}), entry(3, 6, {"a": 5})]))
    assert [v for _, v in sorted(got.items())] == [{"a": 5.0}, {"a": 0.0}]


def test_stale_and_tied_samples_are_dropped(spark):
    times = [10, 12, 11, 12, 13]
    df = spark.createDataFrame([("h", i, 0, float(t)) for i, t in enumerate(times)], "host string, arrival_seq bigint, msg_idx int, time double")
    got = {(r.time, r.prev_time) for r in R.accept_samples(df).collect()}
    assert got == {(10.0, None), (12.0, 10.0), (13.0, 12.0)}


def test_key_missing_from_one_sample_has_no_rate_on_return(spark):
    data = [entry(1, 0, {"a": 1}), entry(2, 1, {"a": 1}, nid="n2"), entry(3, 2, {"a": 9}), entry(3, 2, {"a": 2}, nid="n2", idx=1)]
    assert set(as_dict(rows(spark, data))) == {("oss0", 2.0, "n2", "fs0-OST0000")}


def test_sample_without_entries_breaks_the_pair(spark):
    data = [entry(1, 0, {"a": 1}), entry(3, 2, {"a": 9})]
    samples = spark.createDataFrame([("oss0", i, 0, float(i - 1)) for i in (1, 2, 3)], "host string, arrival_seq bigint, msg_idx int, time double")
    assert rows(spark, data, samples=samples).count() == 0


def test_large_counters_and_new_events(spark):
    big = 9007199254740992
    got = as_dict(rows(spark, [entry(1, 0, {"a": big}), entry(2, 1, {"a": big + 1, "b": 7})]))
    assert list(got.values()) == [{"a": 1.0, "b": 0.0}]


def test_repeated_key_compares_with_the_last_of_the_old_sample(spark):
    data = [entry(1, 0, {"a": 1}), entry(1, 0, {"a": 4}, idx=1), entry(2, 1, {"a": 6}), entry(2, 1, {"a": 9}, idx=1)]
    got = sorted(r.rates["a"] for r in rows(spark, data).collect())
    assert got == [2.0, 5.0]


def model(entries):
    """Rates by going through the reports of each host one after the other."""
    out, reports = {}, defaultdict(dict)
    for e in entries:
        reports[e[0], e[1]].setdefault((e[7], e[8], e[6]), []).append((e[5], e))
    last = {}
    for (host, _seq), keys in sorted(reports.items(), key=lambda x: x[0]):
        time = next(iter(keys.values()))[0][1][3]
        if host in last and time <= last[host][0]:
            continue
        if host in last:
            for key, found in keys.items():
                if key in last[host][1]:
                    old = max(last[host][1][key], key=lambda x: x[0])[1][-1]
                    for idx, e in found:
                        step = 1.0 / (time - last[host][0])
                        out[host, time, key, idx] = {k: max(0, v - old.get(k, v)) * step for k, v in e[-1].items()}
        last[host] = (time, keys)
    return out


@pytest.mark.parametrize("chunk,block", [(2, 3), (3, 7), (4, 1000), (256, 5)])
def test_rates_equal_a_step_by_step_model(spark, chunk, block):
    rng = random.Random(chunk * 100 + block)
    data = []
    for seq in range(120):
        # one host sends most of the reports, some of them late
        host = rng.choice(["oss0"] * 8 + ["oss1", "oss2"])
        time = seq + rng.choice([0, 0, 0, -3, 0.5])
        for idx, nid in enumerate(rng.choices(["n1", "n2", "n3"], k=rng.randint(1, 4))):
            data.append(entry(seq, time, {e: rng.randint(0, 50) for e in rng.sample("abcd", 3)}, nid=nid, idx=idx, host=host))
    df = rows(spark, data, samples_per_chunk=chunk, block_rows=block)
    got = {(r.server, r.time, (r.client_nid, r.target, r.stats_type), r.entry_idx): dict(r.rates) for r in df.collect()}
    want = model(data)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key])


def snapshot(spark, entries, tags=("system", "fid", "jid", "uid")):
    rate_rows = R.rates(spark.createDataFrame(entries, ENTRY))
    fused = R.aggregate_with_load(rate_rows, tags)
    joined = R.attach_load(R.aggregate_by_tags(rate_rows, tags), R.cpu_rates(rate_rows))
    plain = lambda df: sorted((*r[:-1], tuple(sorted(r[-1].items()))) for r in df.collect())
    assert plain(fused) == plain(joined)
    return {r[2:-1]: dict(r[-1]) for r in fused.collect()}


def test_groups_class_clients_and_load(spark):
    def report(seq, time, k):
        return [
            entry(seq, time, {"user": 0, "system": 400 * k}, nid=None, target=None, kind="cpu"),
            entry(seq, time, {"open": 10 * k}, target="fsA-OST0000", idx=1),
            entry(seq, time, {"open": 20 * k}, target="fsA-OST0001", idx=2),
            entry(seq, time, {"open": 30 * k}, target="fsB-OST0000", idx=3),
            entry(seq, time, {"open": 70 * k}, target="fsB-OST0000", idx=4, kind="osc"),
        ]

    got = snapshot(spark, report(1, 0, 0) + report(2, 1, 1), ("fid",))
    assert got == {
        ("fsA",): {"open": 30.0, "nclients": 1.0, "load": 400.0},
        ("fsB",): {"open": 30.0, "nclients": 0.0, "load": 400.0},
    }


def test_no_cpu_means_no_load(spark):
    got = snapshot(spark, [entry(1, 0, {"open": 0}), entry(2, 1, {"open": 3})], ("fid",))
    assert got == {("fs0",): {"open": 3.0, "nclients": 1.0}}


def groups(spark, events):
    import datetime as dt

    rows = [("oss0", dt.datetime(2024, 1, 1), "s", f, "j", "u", e) for f, e in events.items()]
    return spark.createDataFrame(rows, GROUP)


def derived(spark, events):
    return {r.fid: r for r in G.derive_events(groups(spark, events)).collect()}


def test_load_eff_by_iops_only(spark):
    got = derived(spark, {"a": {"open": 30.0, "load": 400.0}, "b": {"open": 10.0, "load": 400.0}})
    assert (got["a"].load_eff, got["b"].load_eff) == pytest.approx((3.0, 1.0))


def test_load_eff_by_iops_and_bytes(spark):
    mb = 1048576.0
    got = derived(
        spark,
        {
            "a": {"open": 30.0, "x_[bytes]": mb, "x_[usec]": 9.0, "read_bytes": 5.0, "load": 400.0},
            "b": {"open": 10.0, "x_[bytes]": mb, "load": 400.0},
        },
    )
    assert (got["a"].load_eff, got["b"].load_eff) == pytest.approx((2.5, 1.5))
    assert (got["a"].iops, got["a"].bytes, got["a"].load) == (30.0, 1.0, 4.0)
    assert dict(got["a"].events) == {"open": 30.0, "x_[bytes]": 1.0, "x_[usec]": 9.0, "read_bytes": 5.0}


def test_load_eff_is_null_when_nothing_happens(spark):
    got = derived(spark, {"a": {"open": 0.0, "load": 400.0}})
    assert got["a"].load_eff is None


def test_levels_keep_the_sums_and_the_load(spark):
    data = groups(spark, {"a": {"open": 1.0, "load": 5.0}, "b": {"open": 2.0, "load": 5.0}})
    for level in "fujsn":
        grouped = G.group_rates(data, level)
        rows = [dict(r.events) for r in grouped.collect()]
        assert sum(r["open"] for r in rows) == 3.0
        assert {r["load"] for r in rows} == {5.0}
    with pytest.raises(ValueError, match="client"):
        G.group_levels(data)
    levels = G.group_levels(data, "fujsn").where("event = 'open'").groupBy("level").agg(F.sum("value").alias("v"))
    assert {r.level: r.v for r in levels.collect()} == dict.fromkeys("fujsn", 3.0)


def test_filters_and_compat(spark):
    data = groups(spark, {"a": {"open": 1.0}, "b": {"open": 2.0}})
    assert G.group_rates(data, "f", user="nobody").count() == 0
    assert G.group_rates(data, "f", user="nobody", compat=True).count() == 2
    assert G.own_rows(data, "u", False).count() == 2 and G.own_rows(data, "x", False).count() == 0


def test_newest_samples_are_the_last_two_accepted(spark):
    rng = random.Random(5)
    rows = [(f"h{rng.randint(0, 3)}", i, 0, float(i // 3 + rng.choice([0, -4, 1]))) for i in range(90)] + [("lone", 91, 0, 1.0)]
    df = spark.createDataFrame(rows, "host string, arrival_seq bigint, msg_idx int, time double")
    want = defaultdict(list)
    for r in sorted(R.accept_samples(df, 2, 10).collect(), key=lambda r: r.time):
        want[r.host].append((r.arrival_seq, r.time))
    got = defaultdict(list)
    for r in sorted(R.newest_samples(df).collect(), key=lambda r: r.sample_no):
        got[r.host].append((r.arrival_seq, r.time))
    assert got == {h: v[-2:] for h, v in want.items()}
