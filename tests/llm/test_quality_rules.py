import re
from collections import defaultdict
from math import comb

import pytest
from pyspark.sql import functions as F

from iolens.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w, lines = WORD.findall(text), [s for s in text.split("\n") if WORD.search(s)]
    windows, covered = defaultdict(list), set()
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    for places in windows.values():
        if len(places) > 1:
            covered |= {k for i in places for k in range(i, i + 8)}
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)),
        len(covered), sum(a == b for a, b in zip(w, w[1:])),
    )


TEXTS = [
    None, "", " \n\t ", "one", "é ü x # $", "a b c d e f g h " * 3, "a b c d e f g h", "x " * 9, "x " * 8,
    "l1 a\nl1 a\n\n \nl1 a \nl2", "a\x0bb\x0cc\rd", " lead and trail ", "p q r s t u v w x y p q r s t u v w z",
    "w1 w2 w3 w4 w5 w6 w7 w8 " * 4000, "**bold** <b>&amp;</b> 100%",
]


def test_counts(frame):
    docs = frame(list(enumerate(TEXTS)))
    got = {r.doc_id: tuple(r[c] for c in Q.COUNTS) for r in Q.measures(docs).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter")
    assert Q.COUNTS == names
    assert got == {i: counts(t) for i, t in enumerate(TEXTS)}


def test_counts_of_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: tuple(r[c] for c in Q.COUNTS) for r in Q.measures(docs).collect()}
    assert got == {r.doc_id: counts(r.text) for r in docs.collect()}


@pytest.mark.parametrize("share", [0.001, 0.0083, 0.05, 0.4])
def test_exact_binomial_bound(spark, share):
    pairs = [(n, k) for n in (0, 1, 5, 40, 300, 900) for k in (0, 1, 3, 17, 120) if k <= n]
    rows = spark.createDataFrame(pairs, "n long, k long").select("n", "k", Q.at_most(F.col("n"), F.col("k"), share).alias("p"))
    for n, k, p in rows.collect():
        exact = sum(comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1))
        assert p == (1.0 if k >= n * share else pytest.approx(exact, rel=1e-6))


def test_bound_beyond_the_terms_errs_upwards(spark, monkeypatch):
    rows = spark.createDataFrame([(4000, 150)], "n long, k long")
    whole = rows.select(Q.at_most(F.col("n"), F.col("k"), 0.05)).first()[0]
    monkeypatch.setattr(Q, "TERMS", 3)
    cut = rows.select(Q.at_most(F.col("n"), F.col("k"), 0.05)).first()[0]
    assert whole <= cut < 10 * whole


def labelled(spark, noisy):
    """Good texts without symbols, but for ``noisy`` of them, and bad texts full of them."""
    good = " ".join(f"word{i}" for i in range(30))
    bad = " ".join(f"w{i}#" for i in range(30))
    rows = [(i, bad if i % 10 == 0 or i in noisy else good, "en", int(i % 10 != 0)) for i in range(6000)]
    rows += [(10_000 + i, bad if i % 2 else good, "fr", i % 2 ^ 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    return df.drop("quality"), df.select("doc_id", "quality")


def test_cutoffs_are_certified_by_stratum(spark):
    docs, labels = labelled(spark, noisy=set())
    measured = Q.with_rules(docs)
    cuts = Q.thresholds(measured, labels).collect()
    assert [r.stratum for r in cuts] == ["en"]  # too few labels in the other
    assert cuts[0].cut_symbols is not None and cuts[0].cut_stutter is None
    kept = Q.judged(measured, Q.thresholds(measured, labels)).join(labels, "doc_id")
    counted = {(r.stratum, r.quality, r.kept): r["count"] for r in kept.groupBy("stratum", "quality", "kept").count().collect()}
    assert counted == {("en", 1, True): 5400, ("en", 0, False): 600, ("fr", 1, True): 30, ("fr", 0, True): 30}


def test_a_rule_that_rejects_good_texts_is_not_certified(spark):
    docs, labels = labelled(spark, noisy=set(range(1, 6000, 40)))  # 2.5 % of the good, over the share of a rule
    assert Q.thresholds(Q.with_rules(docs), labels).where("cut_symbols is not null").count() == 0


def test_labels_with_nulls_and_repeats(spark):
    docs, labels = labelled(spark, noisy=set())
    odd = spark.createDataFrame([(None, 1), (3, None), (5, 0), (999_999, 0)], "doc_id long, quality int")
    once = Q.thresholds(Q.with_rules(docs), labels).collect()
    assert Q.thresholds(Q.with_rules(docs), labels.union(odd).union(labels)).collect() == once
    assert Q.thresholds(Q.with_rules(docs), labels.limit(0)).collect() == []
    measured = Q.with_rules(docs.limit(40))
    assert Q.judged(measured, Q.thresholds(measured, labels.limit(0))).where("kept").count() == 40


def test_base_and_odd_rows(frame):
    docs = frame([(1, None), (None, "a " * 30), (2, " ".join(map(str, range(25)))), (2, " ".join(map(str, range(25)))), (3, "")])
    measured = Q.with_rules(docs)
    none = Q.thresholds(measured, docs.selectExpr("doc_id", "1 as quality").limit(0))
    rows = sorted(((r.doc_id, r.base_failed, r.kept) for r in Q.judged(measured, none).collect()), key=str)
    want = [(1, True, False), (None, True, False), (2, False, True), (2, False, True), (3, True, False)]
    assert rows == sorted(want, key=str)
    assert Q.judged(Q.with_rules(frame([])), none).collect() == []


def test_columns_with_the_names_of_its_own(spark):
    names = ["stratum", "base_failed", "bin_symbols", "kept", "cut_symbols", "n_words"]
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "en"), (2, None, None), (None, "", "xx")], "doc_id long, text string, lang string")
    measured = Q.with_rules(df.selectExpr("*", *[f"'x' as {c}" for c in names]))
    labels = spark.createDataFrame([(1, 1), (1, None)], "doc_id long, quality int")
    got = Q.judged(measured, Q.thresholds(measured, labels)).select("doc_id", "stratum", "n_words", "base_failed", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "en", 30, False, True), (2, "other", 0, True, False), (None, "other", 0, True, False)], key=str)
