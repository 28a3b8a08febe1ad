import hashlib
import random
import zlib

from iolens.llm import periodic_runs as P
from iolens.llm.queries import QUERIES


def brute(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def words_like(rng, longest):
    n, k, out = rng.randrange(longest), rng.choice([1, 2, 3, 5, 40]), []
    while len(out) < n:
        piece = [b"%d" % rng.randrange(k) for _ in range(rng.randrange(1, 7))]
        out += piece * rng.choice([1, 1, 2, 5, 9])
    return out


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(4000):
        words = words_like(rng, 70)
        assert P.runs_of(words) == brute(words), words
    for _ in range(20):
        words = words_like(rng, 1500)
        assert P.runs_of(words) == brute(words)


def test_borders_of_the_definition():
    assert P.runs_of([b"a"] * 5) == [] and P.runs_of([b"a"] * 6) == [(0, 6, 1)]
    assert P.runs_of([b"a", b"b"] * 4) == [(0, 8, 2)] and P.runs_of(([b"a", b"b"] * 4)[:7]) == []
    assert P.runs_of([b"a", b"a", b"b"] * 4 + [b"a"]) == [(0, 13, 3)]  # not lag 6, nor the pairs of a
    words = [b"x"] + [b"a"] * 7 + [b"b", b"a"] * 5
    assert P.runs_of(words) == [(1, 7, 1), (7, 11, 2)]
    assert P.collapsed(words, P.runs_of(words)) == [b"x", b"a", b"b"]


def test_rare_words_split_until_nothing_splits():
    ids = P.word_ids([b"a", b"b"] * 4 + [b"z"] + [b"a", b"c"] * 2 + [b"z"] + [b"b"] * 6)
    assert P.segments(ids) == [(0, 8), (14, 20)]
    assert P.segments(P.word_ids([])) == []


def test_long_texts_of_few_words_end():
    rng = random.Random(1)
    P.runs_of([b"%d" % rng.randrange(2) for _ in range(60_000)])
    assert P.runs_of([b"a"] * 100_000) == [(0, 100_000, 1)]


def test_rows_of_all_kinds(frame):
    rows = [(1, "a b " * 6), (1, "a b " * 6), (None, "A A a A A A A A A"), (2, None), (3, ""), (4, " \n "), (5, "a a " * 7)]
    got = {}
    for r in P.periodic_runs(frame(rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert got[1] == [(12, [(0, 12, 2)], "a b")] * 2
    assert got[None] == [(9, [(3, 6, 1)], "A A a A")]
    assert got[2] == got[3] == got[4] == [(0, [], "")]
    assert got[5] == [(7, [(0, 7, 1)], "a a")]
    assert P.periodic_runs(frame([])).count() == 0


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    found = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *found, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_query_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert got == {i: expected(i, t) for i, t in texts.items()}
    assert sum(v[0] for v in got.values()) > 5
