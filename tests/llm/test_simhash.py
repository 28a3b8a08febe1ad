import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from iolens.llm.components import connected_components
from iolens.llm.simhash import simhash, star, with_components


def reference_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reference_components(prints, bits=2):
    """Smallest id reachable, by brute force over all pairs."""
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


TEXTS = [None, "", " \t\n", "One", "one two", "One TWO three", "a b c d", "Éa É é Ü x", "  nbsp x y", "w " * 5000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash(text) % (1 << 64) == reference_print(text)


def test_spark_hash_agrees(spark):
    words = ["a b c", "", "é ü ñ", "x" * 100]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w")).collect()
    assert [r[1] % (1 << 64) for r in rows] == [xxhash.xxh64_intdigest(r[0].encode(), 42) for r in rows]


def test_components_of_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = with_components(docs).collect()
    prints = {r.doc_id: reference_print(r.text) for r in docs.collect()}
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == reference_components(prints)


def test_dense_postings():
    """A crowd of values that differ in two bytes: the star links what brute force links."""
    rng = np.random.default_rng(3)
    for count in (60, 400, 3000):
        base = np.uint64(0xF00DFACE12345678)
        fps = np.unique(np.array([base ^ np.uint64(int(x)) for x in rng.choice(1 << 16, count, replace=False)]).view(np.int64))
        pairs = star(fps, 2)
        ids = {i: int(f) % (1 << 64) for i, f in enumerate(fps)}
        if count <= 400:
            at = {int(f): i for i, f in enumerate(fps)}
            label = {i: i for i in ids}
            label.update({at[int(a)]: at[int(b)] for a, b in pairs})
            groups, brute = {}, {}
            for i, c in reference_components(ids).items():
                brute.setdefault(c, set()).add(i)
            for i, c in label.items():
                groups.setdefault(c, set()).add(i)
            assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))
        assert len(pairs) < len(fps)


def test_nulls_ties_and_other_columns(frame):
    docs = frame([(3, None), (1, ""), (None, " "), (7, "q w e"), (7, "q w e"), (None, "lone text here"), (9, "Q W E")])
    rows = sorted(((r.doc_id, r.component_id) for r in with_components(docs).collect()), key=str)
    assert rows == sorted([(3, 1), (1, 1), (None, 1), (7, 7), (7, 7), (None, None), (9, 7)], key=str)


def test_empty(frame):
    assert with_components(frame([])).collect() == []


def test_connected_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    loose = [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(250)]
    edges = chain + hub + loose + [(None, 3), (4, None), (8, 8), (0, 1)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in parent if root(i) != i}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
