import random
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from iolens.llm import packing
from iolens.llm.common import stored


def plain_best_fit(sizes, capacity):
    """Best fit by looking at every open bin."""
    rest, out = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(rest) if r >= s]
        if fits:
            i = min(fits)[1]
            rest[i] -= s
        else:
            i = len(rest)
            rest.append(max(capacity, s) - s)
        out.append(i)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_tree_gives_the_tightest_bin(seed):
    rng = random.Random(seed)
    sizes = sorted((int(rng.lognormvariate(4, 1)) + 1 for _ in range(600)), reverse=True)
    for capacity in (1, 150, 400, 5000):
        assert list(packing.best_fit_decreasing(sizes, capacity)) == plain_best_fit(sizes, capacity)


def test_pack_uses_no_more_bins_and_levels_them():
    rng = random.Random(1)
    sizes = sorted((rng.randrange(1, 500) for _ in range(3000)), reverse=True)
    placed = packing.pack(sizes, 8)
    loads = [sum(s for s, b in zip(sizes, placed) if b == k) for k in range(8)]
    assert max(loads) - min(loads) <= 0.01 * sum(sizes) / 8
    assert packing.pack([], 8) == []
    assert packing.pack([7], 3) == [0]


def run(docs, bins=8):
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), packing.group_key(F.col("text")).alias("group_key"))
    return packing.slots(packing.shards(stored(sized, "sized"), bins), ["doc_id", "crc"]).collect()


def check(rows, got, bins=8, even=None):
    size = lambda t: len((t or "").encode()) + 1
    want = sorted(((i is None, i or 0, size(t), crc32((t or "").encode())) for i, t in rows))
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.crc) for r in got) == want
    shards, loads, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for r in got:
        shards[bytes(r.group_key)].add(r.shard)
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in shards.values())
    assert all(0 <= s < bins for s in slots)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if even is not None:
        assert max(loads.values()) - min(loads.get(b, 0) for b in range(bins)) <= even * sum(loads.values()) / bins
    return loads


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    check([tuple(r) for r in docs.collect()], run(docs), even=0.01)


def test_numbering_in_parts(spark, monkeypatch, sf):
    monkeypatch.setattr(packing, "NUMBERED", 16)
    monkeypatch.setattr(packing, "GRAIN", 4)  # most groups share bundles
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    check([tuple(r) for r in docs.collect()], run(docs))


def test_odd_rows(frame):
    rows = [(1, None), (2, ""), (3, "a" * 100_000), (4, "b"), (4, "b"), (None, "é"), (None, None), (5, "b")]
    got = run(frame(rows))
    loads = check(rows, got)
    assert max(loads.values()) == 100_001  # the large text has a shard to itself
    assert run(frame([])) == []
