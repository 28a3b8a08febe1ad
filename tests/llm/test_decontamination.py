import re

import pytest

from iolens.llm.decontamination import Matcher, clean, contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        size = min(10, len(iw))
        for k in range(len(iw) - size + 1 if iw else 0):
            for i in range(len(w) - size + 1):
                if w[i : i + size] == iw[k : k + size]:
                    hit |= set(range(i, i + size))
                    found.add(item)
    return len(w), len(hit), sorted(found)


LONG = " ".join(f"w{i}" for i in range(25))
ITEMS = [(1, LONG), (2, "Short item, here"), (3, "w3 w4"), (4, None), (None, "not an item"), (5, " ... "), (1, "second text of one"), (6, "a a a")]


def texts():
    return [
        (0, None), (1, ""), (2, "nothing at all"), (3, f"before {LONG.upper()} after"), (4, "SHORT--item: HERE! short item here"),
        (5, " ".join(f"w{i}" for i in range(5, 16))), (6, " ".join(f"w{i}" for i in range(5, 14))), (7, "second\ntext, of\tone"),
        (8, "a a a a b a a"), (9, "not an item"), (9, "not an item"), (None, "x w3 w4 é"), (10, "é" * 3 + " w3  W4"),
        (11, " ".join(f"w{i}" for i in range(25)) * 2 + " short item here"), (12, "y " * 20000 + LONG),
    ]


@pytest.mark.parametrize("max_bytes", [10_000_000, 60])
def test_against_brute_force(frame, spark, max_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    known = [(i, t) for i, t in ITEMS if i is not None and t is not None]
    got = contamination(frame(texts()), items, max_bytes=max_bytes).collect()
    mine = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str)
    assert mine == sorted(((i, *brute(t, known)) for i, t in texts()), key=str)
    by_id = {i: t for i, t in texts()}
    for r in got:
        covered = [w for s in r.spans for w in words(by_id[r.doc_id][s.start : s.end])]
        assert len(covered) == r.n_hit


@pytest.mark.parametrize("max_bytes", [10_000_000, 60])
def test_clean_keeps_rows_whole(frame, spark, max_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(texts())
    known = [(i, t) for i, t in ITEMS if i is not None and t is not None]
    kept = clean(docs, items, max_bytes=max_bytes)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if not brute(r.text, known)[1])


def test_empty_tables(frame, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in contamination(frame([(1, "a b")]), none).collect()] == [(2, 0, [])]
    some = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination(frame([]), some).collect() == []


def test_spans_point_into_the_text():
    text = "Ünï — Short,  ITEM\there; tail"
    _, hit, found, spans = Matcher([("q", "short item here")], 10).scan(text)
    assert (hit, found) == (3, ["q"])
    assert text[spans[0]["start"] : spans[0]["end"]] == "Short,  ITEM\there"
