"""Captured counter files, host lists, task lists, natural order."""

import random
from collections import defaultdict

import pytest

from pyspark.sql.functions import spark_partition_id

from iolens.functions import hostlists as L
from iolens.functions.names import natural_key
from iolens.sources import captured


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")


def expand(spark, texts, **options):
    out = defaultdict(list)
    df = L.expand_hosts(frame(spark, texts), "text", ["id"], **options)
    for r in sorted(df.collect(), key=lambda r: (r.id, r.part_no or 0, r.item_no or 0)):
        out[r.id].append(r.error or r.host)
    return [out[i] for i in range(len(texts))]


def collapse(spark, groups, **options):
    df = spark.createDataFrame([(i, h) for i, g in enumerate(groups) for h in g], "id int, h string")
    return {r.id: (r.hostlist, r.error) for r in L.collapse_hosts(df, ["id"], "h", **options).collect()}


def test_expand(spark):
    got = expand(spark, ["n[9-11],d[01-02]", "x[1-2]y[1-3][1-3]", "b,a,,b", "q[1,5-6]z", "[098-101]", ""])
    assert got[0] == ["n9", "n10", "n11", "d01", "d02"]
    assert len(got[1]) == 18 and got[1][:2] == ["x1y11", "x1y12"]
    assert got[2:] == [["b", "a"], ["q1z", "q5z", "q6z"], ["098", "099", "100", "101"], []]


def test_expand_keeps_duplicates_when_told(spark):
    assert expand(spark, ["b,a[1,1],b"], allow_duplicates=True) == [["b", "a1", "a1", "b"]]


def test_expand_errors(spark):
    texts = ["a[[1]]", "a]", "a[", "a[3-1]", "a[x]", "a[]", "a[0-100001]", "a[0-100000]", "a[1-400]b[1-400]"]
    assert expand(spark, texts, max_size=L.MAX_SIZE) == [
        [e] for e in (
            L.NESTED, L.UNBALANCED, L.UNBALANCED, L.BACKWARDS, L.BAD_RANGE, L.BAD_RANGE, L.LONG_RANGE, L.LARGE, L.LARGE,
        )
    ]


def test_large_expressions_are_no_errors(spark):
    got = L.expand_hosts(frame(spark, ["a[0-200000],b[1-500]c[001-500]"]), "text", ["id"])
    assert got.selectExpr("count(*)", "count(distinct host)", "count(error)").first()[:] == (450_001, 450_001, 0)
    assert {r.host for r in got.where("item_no = 4097 and part_no = 0 or item_no = 249999 and part_no = 1").collect()} == {"a4097", "b500c500"}
    tasks = L.expand_tasks_per_node(frame(spark, ["3(x150000),2"]), "text", ["id"])
    assert tasks.selectExpr("count(*)", "max(node_idx)", "sum(tasks)").first()[:] == (150_001, 150_000, 450_002)
    assert expand(spark, ["a[0-99999999999999999999]", "a[0-9999999999999999]"]) == [[L.LONG_RANGE], [L.LONG_RANGE]]


def test_any_number_of_numbers_and_of_digits_is_folded(spark):
    base = 9_999_999_999_999_999_999_999_998  # 25 digits, and one more
    groups = [[f"a{i}b{i}c{i}d{i}e1" for i in (1, 2, 3)], [f"a1b2c3d4e{i}f1" for i in (1, 2, 3)], [f"n{base + i}" for i in range(4)]]
    groups += [[f"n{999_999_999_999_999_998 + i}" for i in range(4)], [f"a{i}b1c1d1e1f1" for i in range(5)]]
    got = collapse(spark, groups)
    assert got[0] == ("a1b1c1d1e1,a2b2c2d2e1,a3b3c3d3e1", None) and got[1] == ("a1b2c3d4e[1-3]f1", None)
    assert got[2] == (f"n[{base}-{base + 3}]", None)
    assert got[3] == ("n[999999999999999998-1000000000000000001]", None) and got[4] == ("a[0-4]b1c1d1e1f1", None)


def test_long_numbers_are_folded(spark):
    base = 1234567890123456789012345
    names = [f"h{base + i}" for i in range(3)]
    assert collapse(spark, [names]) == {0: ("h[1234567890123456789012345-1234567890123456789012347]", None)}
    longer = "9" * 20 + "0" * 36  # of more digits the last 37 are folded
    assert collapse(spark, [[f"h{longer}{i}" for i in range(3)]]) == {0: (f"h{longer[:20]}[{longer[20:]}0-{longer[20:]}2]", None)}
    edge = ["h1999999999999999999", "h2000000000000000000", "h2000000000000000001"]
    assert collapse(spark, [edge]) == {0: ("h[1999999999999999999-2000000000000000001]", None)}


def test_alternating_numbers(spark):
    names = [f"n{i}" for i in range(1, 400, 2)] + [f"m{i}" for i in range(60, 70)]
    (text, error), = collapse(spark, [names], block=8).values()
    assert error is None and text == "m[60-69],n[" + ",".join(str(i) for i in range(1, 400, 2)) + "]"


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_collapse(spark, block):
    groups = {
        "d[01-02],n[9-11]": ["n9", "n10", "n11", "d01", "d02"],
        "n[9-11,14]": ["n14", "n9", "n10", "n11"],
        "x[1-2]y[11-13,21-23]": [f"x{a}y{b}{c}" for a in "12" for b in "12" for c in "123"],
        "n[08-11,099-100]": ["n08", "n09", "n10", "n11", "n099", "n100"],
        "n[9-10,09]": ["n9", "n09", "n10"],
        "n[098-101,99]": ["n99", "n098", "n099", "n100", "n101"],
        "n[08-100,098-099]": [f"n{i:02d}" for i in range(8, 101)] + ["n098", "n099"],
        "a,b[1-2]": ["a", "b1", "b1", " b2 ", "", "  "],
        "r3-n1,r[1-2]-n[1-2]": ["r1-n1", "r1-n2", "r2-n1", "r2-n2", "r3-n1"],
        "h12345678901234567890": ["h12345678901234567890"],
        "n[0-1,00-02]": ["n0", "n1", "n00", "n01", "n02"],
    }
    got = collapse(spark, list(groups.values()), block=block)
    assert [got[i][0] for i in range(len(groups))] == list(groups)


def test_collapse_reports_bad_names(spark):
    assert collapse(spark, [["bad[1]", "ok1"], ["a,b"]]) == {0: ("ok1", L.FORBIDDEN), 1: (None, L.FORBIDDEN)}


def test_expand_undoes_collapse(spark):
    rng = random.Random(3)
    groups = []
    for _ in range(30):
        pad = rng.choice([0, 0, 2, 3])
        groups.append({f"{rng.choice('ab')}{rng.randint(0, 25):0{pad}d}{rng.choice(['', '-r', 'x'])}{rng.choice(['', 1, 2])}" for _ in range(40)})
    texts = collapse(spark, [sorted(g) for g in groups], block=8)
    assert [set(x) for x in expand(spark, [texts[i][0] for i in range(len(groups))])] == groups


def test_tasks_per_node(spark):
    df = L.expand_tasks_per_node(frame(spark, ["2(x3),1", "2(x0),7,3(x2)", "a", "1(x100001)", ""]), "text", ["id"], L.MAX_SIZE)
    got = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.id, r.node_idx or 0)):
        got[r.id].append(r.error or r.tasks)
    assert dict(got) == {0: [2, 2, 2, 1], 1: [7, 3, 3], 2: [L.BAD_TASKS], 3: [L.LONG_TASKS], 4: [L.BAD_TASKS]}


def test_natural_order(spark):
    names = ["n10", "n2", "n1", "a", "1", "n99999999999999999999", "n1x2", "n1x10"]
    got = [r.text for r in frame(spark, names).orderBy(natural_key("text")).collect()]
    assert got == ["1", "a", "n1", "n1x2", "n1x10", "n2", "n10", "n99999999999999999999"]


def lines(spark, texts, start=0):
    return spark.createDataFrame([("h", 1.0, "p", start + i, t) for i, t in enumerate(texts)], "host string, time double, path string, line_no bigint, line string")


def test_stats_text(spark):
    texts = [
        "snapshot_time 1 secs", "open 5 samples [reqs]", "read_bytes 12 samples [bytes] 4096 1048576 12345", "x 7",
        "max_cached_mb: 128", "odd : 5", "word", "name text", "few 3 samples [u] 1 2",
    ]
    df = captured.parse_stats_text(lines(spark, texts))
    assert {r.key: r.value for r in df.collect()} == {
        "open": 5, "read_bytes": 12, "read_bytes_[bytes]": 12345, "x": 7, "max_cached_mb": 128, "few": 3,
    }


def test_repeated_key_keeps_its_last_line(spark):
    df = captured.stats_maps(captured.parse_stats_text(lines(spark, ["x 7", "x 9"])))
    assert [dict(r.stats) for r in df.collect()] == [{"x": 9}]


def test_cpu_text(spark):
    first = captured.parse_cpu_text(lines(spark, ["intr 1", "cpu0 9 9 9", "cpu  1 2 3 4 5 6 7 8 9 0", "cpu  0 0"]))
    assert [tuple(r[2:]) for r in first.collect()] == [(1, 2, 3, 4, 5, 6, 7)]
    short = captured.parse_cpu_text(lines(spark, ["cpu  1 2 x 4"]))
    assert [tuple(r[2:]) for r in short.collect()] == [(1, 2, 0, 0, 0, 0, 0)]
    none = captured.parse_cpu_text(lines(spark, ["cpu0 1"]))
    assert [tuple(r[2:]) for r in none.collect()] == [(0,) * 7]


def test_expressions_of_one_split_are_dealt_out(spark):
    """A small table is expanded by all cores, not by the one task that reads it."""
    df = spark.createDataFrame([(i, f"n[1-{i % 9 + 1}]") for i in range(900)], "job int, expr string").coalesce(1)
    out = L.expand_hosts(df, "expr", ["job"], allow_duplicates=True)
    tasks = out.select(spark_partition_id().alias("p")).distinct().count()
    assert tasks > 4 and out.count() == sum(i % 9 + 1 for i in range(900))
