import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from iolens.llm import mixing
from iolens.llm.common import stored


def run(docs):
    keys = mixing.keys(F.col("doc_id"), F.col("source"), F.col("text"))
    sized = stored(docs.select("doc_id", "source", *keys), "sized")
    copies = mixing.copies_of(F.col("each"), F.col("upto"), F.col("h"))
    return sized.drop("source").join(mixing.mix(sized), ["skey", "size"]).withColumn("copies", copies)


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, stop at most times the size, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        left = total - sum(done.values())
        free = [s for s in names if s not in done]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return done | share
        done |= {s: most * sizes[s] for s in over}


def check(rows, got, exact=False):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = defaultdict(int)
    for _, source, text in rows:
        by_source[source] += size(text)
    want = brute_targets(by_source)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((i is None, i or 0, size(t)) for i, _, t in rows)
    taken, largest, aims = defaultdict(int), defaultdict(int), {}
    for r in got:
        source = r.skey[1:] if r.skey else None
        assert r.source_size == by_source[source]
        assert 0 <= r.copies <= 3
        taken[source] += r.copies * r["size"]
        largest[source] = max(largest[source], r["size"])
        aims[source] = r.target
    for source, aim in aims.items():
        assert aim == pytest.approx(want[source], abs=1e-6)
        assert abs(taken[source] - aim) <= max(largest[source] / 2, 1)
    return taken, aims


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = run(docs).collect()
    taken, aims = check([(r.doc_id, r.source, r.text) for r in docs.collect()], got)
    assert all(abs(taken[s] - a) <= 0.01 * a for s, a in aims.items())


def test_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, again = ({r.doc_id: r.copies for r in run(d).collect()} for d in (docs, docs.orderBy("text")))
    assert first == again


def test_rates_solve_the_dual(spark):
    """Newton's multipliers against bisection of the same constraint."""
    rng = np.random.default_rng(2)
    sizes = {s: rng.lognormal(5, 1.2, 400).astype(int) + 1 for s in ("=a", "=b", "=c", "=d")}
    aims = {"=a": 2.9, "=b": 1.7, "=c": 0.2, "=d": 1.0}
    groups = [(s, int(v), int(n)) for s, x in sizes.items() for v, n in zip(*np.unique(x, return_counts=True))]
    groups = spark.createDataFrame(groups, "skey string, size long, n long")
    rows = [(s, int(x.sum()), float(aims[s] * x.sum())) for s, x in sizes.items()]
    table = spark.createDataFrame(rows, "skey string, source_size long, target double")
    solved = {r.skey: r for r in mixing.multipliers(groups, table).collect()}
    for s, x in sizes.items():
        unit, target = x.mean(), aims[s] * x.sum()
        low, high = -1e4, 1e4
        for _ in range(200):
            mid = (low + high) / 2
            got = (x * np.minimum(3, np.exp(np.minimum(mid * x / unit, 2)))).sum()
            low, high = (mid, high) if got < target else (low, mid)
        assert solved[s].unit == pytest.approx(unit)
        rate = np.exp(np.minimum(solved[s].l * x / unit, np.log(3)))
        assert (x * rate).sum() == pytest.approx(target, rel=2e-7)
        assert solved[s].l == pytest.approx(low, rel=1e-3, abs=1e-4)


def test_odd_rows(frame):
    words = lambda n: "w " * n
    rows = [(1, "b", words(10)), (2, "b", None), (None, "b", words(4)), (3, None, words(7)), (4, None, ""), (5, "é", words(30))]
    rows += [(6, "", words(3)), (7, "z", words(20000)), (8, "z", words(5)), (8, "z", words(5)), (9, "empty", " ")]
    got = run(frame(rows, "doc_id long, source string, text string")).collect()
    check(rows, got)
    assert {r.copies for r in got if r["size"] == 0} == {1}


def test_one_source_and_none(frame):
    rows = [(i, "only", "a b c d") for i in range(50)]
    got = run(frame(rows, "doc_id long, source string, text string")).collect()
    assert {r.copies for r in got} == {1}
    silent = run(frame([(1, "a", None), (2, "b", "")], "doc_id long, source string, text string")).collect()
    assert [(r.target, r.copies) for r in silent] == [(0.0, 1), (0.0, 1)]


def test_empty(frame):
    assert run(frame([], "doc_id long, source string, text string")).collect() == []


def test_a_stopped_source_is_taken_whole(frame):
    rows = [(i, "a", "x y") for i in range(4)] + [(10 + i, "b", "x y") for i in range(100)]
    got = run(frame(rows, "doc_id long, source string, text string")).collect()
    check(rows, got)
    assert {r.copies for r in got if r.skey == "=a"} == {3}
