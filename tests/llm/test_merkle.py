import hashlib
import random
import zlib

from pyspark.sql import functions as F

from iolens.llm import merkle as M
from iolens.llm.queries import MANIFEST_FIELDS, QUERIES


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        out.append(level[i ^ 1] if i ^ 1 < len(level) else "")
        i >>= 1
    return out


def test_multiproof_is_enough_and_nothing_in_it_is_superfluous():
    rng = random.Random(2)
    for n in [1, 2, 3, 5, 8, 13, 64, 100]:
        leaves = [h(str(i)) for i in range(n)]
        levels = levels_of(leaves)
        for _ in range(10):
            places = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
            need = M.missing(places, n)
            fetched = {(a, p): levels[a][p] for a, p in need}
            known = M.derive({p: leaves[p] for p in places}, n, fetched)
            assert known[-1][0] == levels[-1][0]
            for p in places:
                path = M.siblings(p, n, known)
                assert path == path_of(levels, p)
                assert M.folded(leaves[p], p, path) == levels[-1][0]
            for c in need:  # without any of them the top stays unknown
                assert not M.derive({p: leaves[p] for p in places}, n, {k: v for k, v in fetched.items() if k != c})[-1]


def test_a_run_of_leaves_needs_a_few_nodes_per_level():
    assert len(M.missing(range(4096, 8192), 10**9)) == M.depth(10**9) - 12
    assert len(M.missing(range(5000, 9000), 10**9)) <= 2 * M.depth(10**9)


def brute(rows, tree, order, leaf):
    """Of each row (as a dict) its proof, by a tree in memory."""
    rows = sorted(rows, key=lambda r: ((r[tree] is not None, (r[tree] or "").encode()), (r[order] is not None, r[order] or 0), r[leaf]))
    names = list(dict.fromkeys(r[tree] for r in rows))
    trees = {t: levels_of([r[leaf] for r in rows if r[tree] == t]) for t in names}
    top = levels_of([trees[t][-1][0] for t in names]) if names else []
    out, at = [], dict.fromkeys(names, 0)
    for r in rows:
        t, i = r[tree], at[r[tree]]
        at[t] += 1
        out.append((r, i, path_of(trees[t], i), names.index(t), trees[t][-1][0], path_of(top, names.index(t)), top[-1][0]))
    return out


def test_trees_of_many_sizes(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "", "b", "é", "z"]) if i % 3 else "hot", rng.choice([None, i % 37]), h(str(i % 50))) for i in range(700)]
    df = spark.createDataFrame(rows, "tree string, id long, leaf string")
    extra = df.selectExpr("*", *[f"'x' as {c}" for c in ("place", "hash", "name", "row", "at", "nodes", "leaves", "part", "ord")])
    want = brute([dict(zip(("tree", "id", "leaf"), r)) for r in rows], "tree", "id", "leaf")
    for height in (1, 2, 12):
        got = M.manifest(extra, "tree", ["id"], "leaf", height=height).collect()
        key = lambda r: (r[3], r[0])
        assert sorted(map(tuple, got), key=key) == sorted(((i, r["leaf"], p, t, s, tp, root) for r, i, p, t, s, tp, root in want), key=key)
    assert M.manifest(extra.where("false"), "tree", ["id"], "leaf").count() == 0


def test_row_hash_of_nulls_and_bytes(spark):
    df = spark.createDataFrame([(1, None, "é"), (None, "", None)], "a long, b string, c string")
    got = [r[0] for r in df.select(M.row_hash([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert got == [h("1:1-2:é"), h("-0:-")]


def expected(rows):
    def leaf(r, more=0):
        values = [r[f] if f != "n_chars" or r[f] is None else r[f] + more for f in MANIFEST_FIELDS]
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    rows = [r | {"leaf": leaf(r)} for r in rows]
    out = []
    for r, i, path, t, subroot, top_path, root in brute(rows, "lang", "doc_id", "leaf"):
        touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        up = M.folded(M.folded(leaf(r, 1) if touched else r["leaf"], i, path), t, top_path)
        out.append((r["doc_id"], r["leaf"], subroot, root, h(*path, *top_path), up, up == root))
    return out


def test_query_equals_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op12_merkle_manifest"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(expected([r.asDict() for r in docs.collect()]))
    assert any(not r.verified for r in got)
    # nulls in every column, repeated rows, a largest number, and a clashing column
    rows = [(1, None, "s", "en", 1), (1, None, "s", "en", 1), (None, "t", None, None, None), (7, "", "", "", 2**63 - 1), (18, "x", "s", "en", None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").withColumn("leaf", F.lit("x"))
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()
    key = lambda r: tuple(map(str, r))
    want = [dict(zip(("doc_id", "text", "source", "lang", "n_chars"), r)) for r in rows]
    assert sorted(map(tuple, got), key=key) == sorted(expected(want), key=key)
