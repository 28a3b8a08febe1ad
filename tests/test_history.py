"""History queries, the stored table and its upkeep."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from iolens.operators import groups as G
from iolens.operators import history as H
from iolens.operators import view as V
from iolens.plans.pages import job_detail
from iolens.plans.reports import top_report
from iolens.sources import history_days
from iolens.sources import history_table as S

ROW = "time timestamp, host string, system string, fid string, jid string, uid string, client string, event string, value double"
T0 = dt.datetime(2024, 1, 10)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def row(minutes, value, host="oss0", jid="j1", event="iops", system="s"):
    return (at(minutes), host, system, "fs", jid, "u", "*", event, float(value))


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def random_rows(n, seed, days=3):
    rng = random.Random(seed)
    # one host has most of the rows
    return [
        row(rng.randint(0, days * 1440 - 1), rng.randint(1, 9), rng.choice(["oss0"] * 6 + ["oss1"]), f"j{rng.randint(0, 3)}",
            rng.choice(["iops", "nclients"]))
        for _ in range(n)
    ]


def test_range_is_open_below_and_closed_above(spark):
    df = frame(spark, [row(m, 1) for m in (0, 1, 2, 3)])
    assert [r.time for r in H.in_range(df, at(1), at(3)).collect()] == [at(2), at(3)]
    assert H.last_interval(df, "1m", at(3)).count() == 1


def test_widths():
    assert [H.seconds_of(w) for w in ("30s", "15m", "1h", "1d")] == [30, 900, 3600, 86400]
    with pytest.raises(ValueError):
        H.seconds_of("1 week")
    with pytest.raises(ValueError):
        H.bucket_of("7h")


@pytest.mark.parametrize("agg", ["avg", "last", "sum"])
def test_gapfill_has_every_bucket_of_every_key(spark, agg):
    rows = random_rows(60, 1, days=1)
    start, end = at(95), at(1300)
    got = {(r.t, r.host, r.jid): r.value for r in H.gapfill(frame(spark, rows), "30m", start, end, ("host", "jid"), agg).collect()}
    data = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[-1])):  # the largest of a time is its last
        if start < r[0] <= end:
            data[r[1], r[4], (r[0] - T0) // dt.timedelta(minutes=30)].append(r[-1])
    keys = {(h, j) for h, j, _ in data}
    assert got.keys() == {(at(30 * b), h, j) for h, j in keys for b in range(3, 44)}
    for (t, h, j), value in got.items():
        found = data.get((h, j, (t - T0) // dt.timedelta(minutes=30)))
        want = 0 if not found else found[-1] if agg == "last" else sum(found) / (len(found) if agg == "avg" else 1)
        assert value == pytest.approx(want)


@pytest.fixture(params=["UTC", "America/Chicago", "Asia/Kolkata"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def instants(spark, seconds):
    """History rows at seconds since 1970, worth 1, 2, 3 ..."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(s, float(i + 1)) for i, s in enumerate(seconds)], "s bigint, value double")
    tags = [F.lit("x").alias(c) for c in ("host", "system", "fid", "jid", "uid", "client", "event")]
    return df.select(F.timestamp_seconds("s").alias("time"), *tags, "value").select(*S.HISTORY_COLUMNS)


# 10 March 2024 is the clock change in Chicago
DAY = int(dt.datetime(2024, 3, 10, tzinfo=dt.UTC).timestamp())


def test_stored_range_is_the_same_in_every_zone(spark, zone, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "h")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")  # written elsewhere
    S.write_history(instants(spark, [DAY - 1, DAY + 2 * 3600, DAY + 9 * 3600, DAY + 86399, DAY + 86400]), path)
    spark.conf.set("spark.sql.session.timeZone", zone)
    start, end = dt.datetime(2024, 3, 10), dt.datetime(2024, 3, 10, 23, 59, 59)
    tokyo = dt.timezone(dt.timedelta(hours=9))
    table = S.read_history(spark, path)
    for low, high in (
        (start, end), ("2024-03-10 00:00:00", "2024-03-10T23:59:59"), (start.replace(tzinfo=dt.UTC), end.replace(tzinfo=dt.UTC)),
        (dt.datetime(2024, 3, 10, 9, tzinfo=tokyo), dt.datetime(2024, 3, 11, 8, 59, 59, tzinfo=tokyo)),
    ):
        rows = H.in_range(table, low, high)
        assert sorted(r.s for r in rows.select(F.unix_seconds("time").alias("s")).collect()) == [DAY + 7200, DAY + 32400, DAY + 86399]
    days = {r.date: r.rows for r in S.storage_report(spark, path).collect()}
    assert days == {dt.date(2024, 3, 9): 1, dt.date(2024, 3, 10): 3, dt.date(2024, 3, 11): 1}
    assert S.compaction_border(dt.datetime(2024, 3, 10, 15, tzinfo=tokyo)) == dt.date(2024, 3, 9)


@pytest.mark.parametrize("width,step", [("1h", 3600), ("1d", 86400), ("30m", 1800)])
def test_gapfill_is_the_same_in_every_zone(spark, zone, width, step):
    from pyspark.sql import functions as F

    seconds = [DAY + 60, DAY + 8 * 3600 - 1, DAY + 8 * 3600, DAY + 30 * 3600]
    filled = H.gapfill(instants(spark, seconds), width, dt.datetime(2024, 3, 10), dt.datetime(2024, 3, 11, 12), ("host",), "sum")
    got = {r.s: r.value for r in filled.select(F.unix_seconds("t").alias("s"), "value").collect()}
    want = dict.fromkeys(range(DAY, DAY + 36 * 3600 + 1, step), 0.0)
    for i, s in enumerate(seconds):
        want[s // step * step] += i + 1
    assert got == want


def test_gapfill_of_a_long_range(spark):
    rows = [row(0, 5), row(10 * 1440, 7)]
    got = H.gapfill(frame(spark, rows), "1s", at(-1), at(10 * 1440), ("host",), "sum")
    total = got.selectExpr("count(*)", "count(distinct t)", "sum(value)", "count_if(value > 0)").first()
    assert tuple(total) == (10 * 86400 + 61, 10 * 86400 + 61, 12.0, 2)


def test_last_takes_the_largest_of_a_time(spark):
    rows = [row(5, 3), row(5, 1), row(5, 2), row(4, 9)]
    for order in (rows, rows[::-1]):
        got = H.gapfill(frame(spark, order), "30m", at(0), at(29), ("host",), "last").collect()
        assert [r.value for r in got] == [3.0]


def test_focus_pivot_limit_and_width(spark):
    df = frame(spark, [row(0, 1), row(10, 2, jid="j2"), row(40, 4, jid="j3"), row(100, 8)])
    series = H.bucket_sum_by_tag(df, "30m", "jid", "iops")
    focus = {(r.t, r.jid): r.value for r in H.focus_tag(series, "jid", "j1").collect()}
    assert focus == {(at(0), "j1"): 1, (at(0), "*"): 2, (at(30), "*"): 4, (at(90), "j1"): 8}
    wide = H.pivot_series(series, "jid", ["j1", "j2", "j3"]).orderBy("t").collect()
    assert [(r.j1, r.j2, r.j3) for r in wide] == [(1, 2, None), (None, None, 4), (8, None, None)]
    assert H.axis_limit(series).first().limit == pytest.approx(8.8)
    stacked = H.axis_limit(series.where("t < timestamp '2024-01-10 00:30:00'"), stacked=True)
    assert stacked.first().limit == pytest.approx(3.3)
    assert H.bucket_width(series).first().seconds == 1800
    assert H.bucket_width(series.where("jid = 'j2'")).first().seconds is None


def test_share_at_the_last_active_time(spark):
    df = frame(
        spark,
        [row(0, 1, event="nclients"), row(0, 6, jid="a"), row(0, 2, jid="b"), row(5, 9, jid="a"),
         row(7, 1, host="oss1", event="nclients"), row(7, 5, host="oss1", jid="a")],
    )
    got = {(r.host, r.jid): (r.total, r.share, r.angle) for r in H.latest_active_share(df, "jid", "iops").collect()}
    assert got == {
        ("oss0", "a"): pytest.approx((8, 0.75, 4.71238898)),
        ("oss0", "b"): pytest.approx((8, 0.25, 1.57079633)),
        ("oss1", "a"): pytest.approx((5, 1, 6.28318531)),
    }


def test_job_detail_keeps_the_first_row(spark):
    rows = [row(5, 1, jid="x", event="nclients"), row(10, 2, event="nclients"), row(70, 3, jid="x", event="nclients"), row(95, 4, event="nclients")]
    got = {(r.t, r.jid): r.value for r in job_detail(frame(spark, rows), "x").collect()}
    assert got == {(at(0), "x"): 1, (at(0), "*"): 2, (at(60), "x"): 3}


def test_history_keeps_positive_values_only(spark):
    groups = spark.createDataFrame(
        [("oss0", T0, "s", None, "j", "u", {"open": 4.0, "idle": 0.0, "load": 100.0, "nclients": 0.0})],
        "server string, time timestamp, system string, fid string, jid string, uid string, events map<string,double>",
    )
    got = {r.event: (r.value, r.fid, r.client) for r in H.to_history(G.derive_events(groups)).collect()}
    assert got == {"open": (4, "*", "*"), "load": (1, "*", "*"), "iops": (4, "*", "*"), "load_eff": (1, "*", "*")}


def test_ranking_and_pages(spark):
    groups = spark.createDataFrame(
        [("oss0", T0, f, {"open": v, "load": 100.0, "rare": 1.0}) for f, v in (("a", 1.0), ("b", 5.0), ("c", 3.0))]
        + [("oss1", T0, "d", {"open": 0.0, "load": 100.0})],
        "server string, time timestamp, fid string, events map<string,double>",
    )
    derived = G.derive_events(groups)
    with pytest.raises(ValueError):
        V.top_view(derived, detailed=True)
    rows = V.top_events(derived).collect()
    assert sorted((r.fid, r.event, r.value) for r in rows) == [("b", "open", 5.0), ("c", "open", 3.0)]
    ranked = V.rank(V.top_view(derived, detailed=True, events=["open"])).collect()
    assert [r.fid for r in ranked] == ["b", "c", "a", "d"]
    assert [r.open for r in ranked] == [5.0, 3.0, 0.0, 0.0] and "rare" not in ranked[0].asDict()
    second = V.page(V.top_view(derived), "iops", offset=1, limit=2, total=True).collect()
    assert [(r.fid, r.total) for r in second] == [("c", 4), ("a", 4)]


def test_totals_before_or_after_the_filter(spark):
    groups = spark.createDataFrame(
        [("oss0", T0, "s", "f", "j", u, {"open": v, "load": 400.0}) for u, v in (("ann", 1.0), ("bob", 3.0))],
        "server string, time timestamp, system string, fid string, jid string, uid string, events map<string,double>",
    )
    assert top_report(groups, user="ann").first().load_eff == pytest.approx(4.0)
    assert top_report(groups, user="ann", totals="all").first().load_eff == pytest.approx(1.0)


def plain(df):
    return sorted(tuple(r) for r in df.select(*S.HISTORY_COLUMNS).collect())


def test_table_round_trip_pruning_and_compaction(spark, tmp_path):
    path, compacted = str(tmp_path / "h"), str(tmp_path / "c")
    rows = random_rows(300, 7)
    S.write_history(frame(spark, rows[:150]), path)
    S.write_history(frame(spark, rows[150:]), path)
    assert plain(S.read_history(spark, path)) == sorted(rows)

    one_day = H.in_range(S.read_history(spark, path), at(1450), at(1500))
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "2024-01-11" in plan
    assert "PushedFilters: [IsNotNull(time), GreaterThan(time" in plan

    now = T0 + dt.timedelta(days=2, hours=13)
    for _ in range(2):  # running it again changes nothing
        border = S.compact_history(spark, path, compacted, now)
        assert border == dt.date(2024, 1, 12)
        assert plain(S.read_history(spark, path, compacted, border)) == sorted(rows)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "c").rglob("*.parquet")}
    before = files()
    S.compact_history(spark, path, compacted, now)
    assert files() == before
    late = row(30, 99.0)  # a day that is written to again is taken again, and no other
    S.write_history(frame(spark, [late]), path)
    S.compact_history(spark, path, compacted, now)
    assert plain(S.read_history(spark, path, compacted, border)) == sorted([*rows, late])
    changed = {f for f in files().items() if f not in before.items()}
    assert changed and all("date=2024-01-10" in f for f, _ in changed)
    rows = [*rows, late]
    assert S.compaction_border(T0 + dt.timedelta(hours=11)) == dt.date(2024, 1, 9)

    report = {r.date: r for r in S.storage_report(spark, path).collect()}
    assert sum(r.rows for r in report.values()) == 301
    assert all(r.files >= 1 and r.bytes > 0 and r.first_time <= r.last_time for r in report.values())
    sizes = {r.date: r.after_bytes for r in S.compaction_report(spark, path, compacted).collect()}
    assert sizes[dt.date(2024, 1, 12)] is None and sizes[dt.date(2024, 1, 10)] > 0


def test_repeated_batch_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "h")
    for batch in (0, 1, 1):
        S.write_history(frame(spark, [row(batch, 1)]), path, batch_id=batch)
    assert plain(S.read_history(spark, path)) == [row(0, 1), row(1, 1)]


def test_float_values_on_request(spark, tmp_path):
    S.write_history(frame(spark, [row(0, 0.1)]), str(tmp_path / "h"), compat_real=True)
    assert dict(spark.read.parquet(str(tmp_path / "h")).dtypes)["value"] == "float"


def test_any_tag_leaves_most_files_alone(spark, tmp_path):
    """A lookup by one tag, whichever, touches a part of a day's files; times and values come back as they were."""
    rng = random.Random(3)
    rows = [
        (dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(seconds=i), f"h{rng.randrange(40):02}", f"s{rng.randrange(40):02}", "f", f"job{rng.randrange(400):04}",
         f"u{rng.randrange(40):02}", "*", f"e{rng.randrange(40):02}", float(i))
        for i in range(20_000)
    ]
    df = spark.createDataFrame(rows, "time timestamp, host string, system string, fid string, jid string, uid string, client string, event string, value double")
    path = str(tmp_path / "h")
    S.write_history(df, path, parts=512)
    table = S.read_history(spark, path)
    files = lambda d: d.select("_metadata.file_path").distinct().count()
    whole = files(spark.read.parquet(path))
    assert whole > 300 and table.count() == len(rows)
    for tag, value in (("host", "h07"), ("system", "s11"), ("uid", "u39"), ("jid", "job0123"), ("event", "e00")):
        found = spark.read.parquet(path).where(F.col(tag) == value)
        assert 0 < files(found) < whole / 3, tag


def test_segments_hold_the_rows(spark, tmp_path):
    """Times to the microsecond, whole and other values, repeated times, and odd numbers."""
    base = dt.datetime(2024, 1, 1, 0, 0, 0, 1)
    values = [1.0, 2.5, 1e300, 2.0**60, float("inf"), 0.0, 3.0]
    rows = [(base + dt.timedelta(microseconds=m * 700_001), "h", "s", "f", None if m % 2 else "j", "u", "*", f"e{m % 3}", values[m % 7]) for m in range(60)]
    df = spark.createDataFrame(rows + rows[:5], "time timestamp, host string, system string, fid string, jid string, uid string, client string, event string, value double")
    df = df.withColumn("date", F.to_date("time"))
    packed = S.segments_of(df)
    assert packed.count() == 6 and packed.agg(F.sum("rows")).first()[0] == 65
    back = S.rows_of_segments(packed)
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))
    path = str(tmp_path / "p")
    packed.write.partitionBy("date").parquet(path)
    found = H.in_range(S.rows_of_segments(spark.read.parquet(path)), dt.datetime(2024, 1, 1)).where("host = 'h'")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = found._jdf.queryExecution().explainString(mode)
    assert "EqualTo(host,h)" in text and "date" in text.split("PartitionFilters")[1].split("]")[0]


def test_summaries_replace_reading_the_rows(spark, tmp_path):
    path = str(tmp_path / "h")
    df = frame(spark, random_rows(400, 5))
    for half in (0, 1):
        S.write_history(df.where(F.pmod(F.hash("value"), F.lit(2)) == half), path)
    table, days = S.read_history(spark, path), history_days.read_days(spark, path)
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(history_days.distinct_dims(days)) == rows(H.distinct_dims(df))
    assert rows(history_days.job_extent(days, "j1")) == rows(H.job_extent(df, "j1"))
    assert rows(history_days.recent_rows(table, days, 7)) == rows(H.recent_rows(df.select(*S.HISTORY_COLUMNS), 7))
    assert history_days.recent_rows(table, days, 10_000).count() == 400
    active = df.withColumn("event", F.when(F.hash("value") % 3 == 0, "nclients").otherwise("load"))
    other = str(tmp_path / "a")
    S.write_history(active, other)
    table, days = S.read_history(spark, other), history_days.read_days(spark, other)
    got = history_days.latest_active_share(table, days, "jid", "load")
    assert rows(got) == rows(H.latest_active_share(active, "jid", "load"))
    for made in (history_days.distinct_dims(days), history_days.job_extent(days, "j1"), history_days.latest_active(days)):
        assert all("_days" in f for f in made.inputFiles())


def test_summaries_of_a_repeated_batch(spark, tmp_path):
    path = str(tmp_path / "h")
    for n, rows in ((0, random_rows(50, 1)), (1, random_rows(20, 2)), (0, random_rows(50, 1))):
        S.write_history(frame(spark, rows), path, batch_id=n)
    days = history_days.read_days(spark, path)
    assert days.where("dim is null").agg(F.sum("rows")).first()[0] == 70
