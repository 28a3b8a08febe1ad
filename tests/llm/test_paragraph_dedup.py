import random
from collections import defaultdict

import numpy as np
import pytest

from iolens.llm import paragraph_dedup as P


def brute(rows, min_words=P.MIN_WORDS):
    """Class of each line and lone sentence: all pairs of lines compared, sentences by their words."""
    occurrences, lines = [], {}
    for name, text in rows:
        for number, start, _, _, sentence, words in P.units(text, min_words):
            key = b" ".join(words)
            occurrences.append(((name, number, start, sentence), key))
            if not sentence:
                lines.setdefault(key, P.shingles(words))
    keys, parent = list(lines), {k: k for _, k in occurrences}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(lines[a] & lines[b])
            if both >= P.SIMILARITY * (len(lines[a]) + len(lines[b]) - both):
                parent[root(a)] = root(b)
    classes = defaultdict(list)
    for place, key in occurrences:
        classes[root(key)].append(place)
    out = {}
    for places in classes.values():
        if len(places) > 1:
            first = min(places, key=lambda p: (p[0] is not None, p))
            out.update((p, first[:2]) for p in places)
    whole = {p[:2] for p in out if not p[3]}
    return {p[:3]: c for p, c in out.items() if not p[3] or p[:2] not in whole}


def classes_of(result):
    return {(r.doc_id, r.paragraph, r.start): (r.class_doc_id, r.class_paragraph) for r in result}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return words


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + str(rng.randrange(60))
    lines = [[word() for _ in range(rng.choice([12, 30, 60, 100]))] for _ in range(60)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(4):
            line = rng.choice(lines) if rng.random() < 0.4 else [word() for _ in range(rng.choice([5, 25, 80]))]
            parts.append(" ".join(edited(rng, line, rng.choice([0, 0, 1, 2]))))
        rows.append((i, "\n".join(parts)))
    return rows


def test_against_all_pairs(frame):
    rows = corpus()
    got = P.repeated_paragraphs(frame(rows)).collect()
    want = brute(rows)
    assert len(want) > 100
    mine = classes_of(got)
    assert len(mine.keys() & want.keys()) >= 0.99 * len(want) and mine.keys() <= want.keys()
    assert sum(mine[k] == want[k] for k in mine) >= 0.99 * len(mine)
    texts = dict(rows)
    for r in got:
        assert texts[r.doc_id][r.start : r.end] in texts[r.doc_id].split("\n")[r.paragraph]
        assert r.removed or (r.doc_id, r.paragraph) == (r.class_doc_id, r.class_paragraph)


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows)
    got = classes_of(P.repeated_paragraphs(docs).collect())
    assert got.keys() <= want.keys() and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize("block", [512, 4])
def test_crowded_bands(frame, monkeypatch, block):
    """Drifting versions: far ends are unlike, neighbours are alike, all share bands with some."""
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(4)
    line, rows = [f"v{i}" for i in range(120)], []
    for i in range(40):
        rows.append((i, " ".join(line)))
        line = edited(rng, line, 1)
    got = classes_of(P.repeated_paragraphs(frame(rows)).collect())
    assert got == brute(rows)


def test_size_of_a_band_is_that_of_its_paragraphs(spark):
    """However many tasks gave a paragraph, it counts once; the hub is what meets most in all of its bands."""
    signed = [(7, p) for p in range(3)] + [(7, 1)] * 240 + [(8, 5)] * 9 + [(9, 2), (9, 6), (9, 8)]
    crowded = P._crowded(spark.createDataFrame(signed, "band long, para long").repartition(16))
    assert sorted(map(tuple, crowded.collect())) == [(7, 0, 2), (7, 1, 2), (7, 2, 2), (9, 2, 2), (9, 6, 2), (9, 8, 2)]


@pytest.mark.parametrize("block", [512, 16])
def test_all_of_a_crowded_band_is_compared(spark, frame, monkeypatch, block):
    """A band of 130 paragraphs, most of which differ from all others, with some like pairs among them."""
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(6)
    fresh = lambda: [f"w{rng.randrange(10**9)}" for _ in range(60)]
    lines = [fresh() for _ in range(100)]
    lines += [edited(rng, line, 1) for line in lines[:30]]
    texts = [" ".join(line) for line in lines]
    keys = [P.paragraph_id(t.encode().split()) for t in texts]
    band = P._crowded(spark.createDataFrame([(3, k) for k in keys], "band long, para long"))
    members = {r.node: r.component for r in P._members(frame(list(enumerate(texts))), band, P.MIN_WORDS).collect()}
    sets = dict(zip(keys, (P.shingles(t.encode().split()) for t in texts)))
    like = lambda a, b: len(sets[a] & sets[b]) >= P.SIMILARITY * len(sets[a] | sets[b])
    want = {max(a, b): min(a, b) for a, b in zip(keys, keys[100:]) if like(a, b)}
    assert len(want) > 10 and members == want


def test_recall_in_a_crowd_of_near_copies(frame):
    """Copies of one text with edits of their own, unlike each other but like their origin, are one class."""
    rng = random.Random(8)
    line = [f"v{i}" for i in range(100)]
    rows = [(i, " ".join(edited(rng, line, 2 if i else 0))) for i in range(400)]
    got = P.repeated_paragraphs(frame(rows)).collect()
    want = brute(rows)
    assert len(want) > 380 and len(got) >= 0.99 * len(want)
    assert len({(r.class_doc_id, r.class_paragraph) for r in got}) == 1


def test_stretches_of_enough_words(frame):
    """Units in a row count together; a lone sentence and a license line do not."""
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n)) + "."
    passage = f"{words('p', 15)} {words('q', 4)} {words('r', 24)}"
    rows = [(1, f"{words('a', 30)} {passage} {words('b', 30)}"), (2, f"{words('c', 30)} {passage} {words('d', 30)}")]
    rows += [(3, f"{words('e', 30)} {words('p', 15)} {words('f', 30)}"), (4, f"{words('l', 12)}\n{words('g', 50)}")]
    rows += [(5, f"{words('l', 12)}\n{words('h', 50)}"), (None, words("z", 50)), (None, words("z", 50))]
    got = sorted(((r.doc_id, r.n_words, r.removed) for r in P.repeated_paragraphs(frame(rows), kept_lines=True, min_passage=40).collect()), key=str)
    assert got == sorted([(1, 15, False), (1, 24, False), (2, 15, True), (2, 24, True), (None, 50, False), (None, 50, False)], key=str)
    assert P.repeated_paragraphs(frame([]), min_passage=40).collect() == []


def test_odd_rows(frame):
    line = " ".join(f"w{i}" for i in range(20))
    rows = [(None, line), (5, None), (6, ""), (7, f"\n\n{line.upper()}  \nshort line\n{line}"), (8, "short line"), (8, "short line"), (9, line), (9, line)]
    rows += [(10, "alone " + " ".join(f"u{i}" for i in range(30_000)))]
    got = P.repeated_paragraphs(frame(rows)).collect()
    places = sorted(((r.doc_id, r.paragraph, r.class_doc_id, r.class_paragraph, r.removed) for r in got), key=str)
    want = [(None, 0, None, 0, False), (7, 2, None, 0, True), (7, 4, None, 0, True), (9, 0, None, 0, True), (9, 0, None, 0, True)]
    assert places == sorted(want, key=str)
    assert P.repeated_paragraphs(frame([])).collect() == []
    with pytest.raises(ValueError):
        P.repeated_paragraphs(frame(rows), min_words=3)


def test_passages_inside_other_lines(frame):
    """A passage of some sentences in the middle of unlike lines, and as a line of its own."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    prose = lambda k: " ".join(" ".join(word() for _ in range(rng.randrange(3, 16))) + "." for _ in range(k))
    passage = prose(7)
    rows = [(i, f"{prose(20)} {passage} {prose(20)}\n{prose(9)}") for i in range(6)] + [(6, passage), (7, prose(30))]
    got = P.repeated_paragraphs(frame(rows)).collect()
    assert classes_of(got) == brute(rows)
    assert {r.doc_id for r in got} >= set(range(6)) and 7 not in {r.doc_id for r in got}
    sentences = [s + "." for s in passage.rstrip(".").split(". ")]
    long = {s for s in sentences if len(s.split()) >= P.MIN_WORDS}
    texts = dict(rows)
    assert {texts[r.doc_id][r.start : r.end] for r in got} == long
    cleaned = {r.doc_id: r.text for r in P.remove_paragraphs(frame(rows), P.repeated_paragraphs(frame(rows))).collect()}
    assert cleaned[0] == texts[0] and all(s not in cleaned[i] for s in long for i in range(1, 6))
    assert len(cleaned[3].split()) == len(texts[3].split()) - sum(len(s.split()) for s in long)


def test_sentences_of_a_line_that_stays(frame):
    """A passage of document 1 goes from the line of document 5 that stays, and one occurrence stays of each."""
    words = lambda c, n=14: " ".join(f"{c}{i}" for i in range(n)) + "."
    passage, line = words("p"), f"{words('a')} {words('p')} {words('b')}"
    rows = [(1, f"{words('x')} {passage} {words('y')}"), (5, line), (9, line)]
    rows += [(10, f"{words('u')} {words('only')}"), (2, f"{words('u')} {words('only')}")]
    rows += [(3, f"{words('c')} {words('s')}"), (4, words("s"))]
    found = P.repeated_paragraphs(frame(rows), kept_lines=True)
    cleaned = {r.doc_id: r.text for r in P.remove_paragraphs(frame(rows), found).collect()}
    assert cleaned[1] == rows[0][1] and cleaned[5] == f"{words('a')} {words('b')}" and cleaned[9] == ""
    assert cleaned[2] == rows[3][1] and cleaned[10] == "" and cleaned[3] == rows[5][1] and cleaned[4] == ""
    got = sorted((r.doc_id, r.paragraph, r.start, r.class_doc_id, r.removed) for r in found.collect())
    at = len(words("x")) + 1
    assert got == sorted([(1, 0, at, 1, False), (5, 0, 0, 5, False), (5, 0, len(words("a")) + 1, 1, True), (9, 0, 0, 5, True),
                          (2, 0, 0, 2, False), (10, 0, 0, 2, True), (3, 0, len(words("c")) + 1, 3, False), (4, 0, 0, 3, True)])


def test_removal(frame):
    line = " ".join(f"w{i}" for i in range(20))
    docs = frame([(1, line), (2, f"a\n{line}\nb"), (3, None)])
    cleaned = P.remove_paragraphs(docs, P.repeated_paragraphs(docs))
    assert "sentence" not in cleaned.columns and cleaned.columns == docs.columns
    assert {r.doc_id: r.text for r in cleaned.collect()} == {1: line, 2: "a\nb", 3: None}


def test_recall_of_the_bands():
    """Pairs just over the similarity share a band, as the band sizes promise."""
    rng = random.Random(9)
    found = total = 0
    while total < 1500:
        words = [str(rng.randrange(10**6)).encode() for _ in range(130)]
        other = [str(w).encode() for w in edited(rng, [w.decode() for w in words], 3)]
        a, b = P.shingles(words), P.shingles(other)
        if len(a & b) / len(a | b) < P.SIMILARITY:
            continue
        x, y = P.bands_of([words, other])
        total, found = total + 1, found + bool(np.any(x == y))
    assert found >= 0.995 * total


def holding(passages, rng, word):
    """Texts of unlike lines and short sentences; each passage stands in the middle of sentences of two or three."""
    prose = lambda n: " ".join(word() + rng.choice(["", "", "", ".", ".\n"]) for _ in range(n))
    texts = [prose(rng.randrange(60, 200)) for _ in range(40)]
    places = []
    for n, p in enumerate(passages):
        for i in rng.sample(range(5, 40), 2 + n % 2):
            texts[i] = f"{texts[i]} {word()} {p} {word()} {prose(30)}"
            places.append((i, n))
    return texts, places


def test_passages_that_cut_sentences(spark, tmp_path):
    """Runs of 51 words that two documents share are found wherever they begin and end, also over lines."""
    from iolens.llm.queries import QUERIES

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopé") for _ in range(6))
    passages = [" ".join(word() + rng.choice(["", "", ".", ",", ".\n" if n % 3 == 0 else ""]) for _ in range(51 + n)) for n in range(12)]
    texts, places = holding(passages, rng, word)
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).write.parquet(path)
    got = QUERIES["op3_paragraph_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in places}
    firsts = {n: min(i for i, m in places if m == n) for _, n in places}
    for i, n in places:
        at = texts[i].index(passages[n])
        end = at + len(passages[n])
        inside = [r for r in got if r.doc_id == i and at < r.end and r.start < end]  # or lines that are little longer
        assert any(r.removed == (i != firsts[n]) and r.class_doc_id == firsts[n] for r in inside)
        assert i != firsts[n] or not any(r.removed for r in inside)
        for r in inside:
            assert r.n_words == len(texts[i][r.start : r.end].split()) and r.paragraph == texts[i][: r.start].count("\n")
        found = texts[i][max(at, min(r.start for r in inside)) : min(end, max(r.end for r in inside))]
        assert len(found.split()) >= P.RUN
    docs = spark.read.parquet(path)
    cleaned = {r.doc_id: r.text for r in P.remove_paragraphs(docs, spark.createDataFrame(got)).collect()}
    kept = " ".join(cleaned.values())
    assert all(passages[n] in cleaned[i] for n, i in firsts.items()) and all(kept.count(p) == 1 for p in passages)


def test_chosen_runs():
    rng = random.Random(3)
    digests = lambda words: P._digests([w.encode() for w in words])
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for n in range(60):
        passage = fresh(P.RUN + P.REACH - 1)
        a, b = fresh(n) + passage + fresh(30), fresh(2 * n) + passage + fresh(n // 2)
        (at, mine), (other, theirs) = P.runs_of(digests(a), P.RUN), P.runs_of(digests(b), P.RUN)
        same = set(mine.tolist()) & set(theirs.tolist())
        assert same
        for h in same:
            i, j = at[mine.tolist().index(h)], other[theirs.tolist().index(h)]
            assert a[i : i + P.RUN] == b[j : j + P.RUN]
    assert not len(P.runs_of(digests(fresh(P.RUN - 1)), P.RUN)[0]) and P.runs_of(digests(fresh(P.RUN)), P.RUN)[0].tolist() == [0]
    again = P.runs_of(digests(["for"] * 1000), P.RUN)[0]
    assert len(again) <= 100 and max(np.diff(again)) <= P.RUN


def test_passages_in_lines_that_go(frame):
    """Lines that go take their passages along; one that stays gives up what an earlier text holds; nothing is lost."""
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    passage = words("p", 60)
    line = f"{words('a', 20)} {passage} {words('b', 20)}"
    rows = [(1, f"{words('x', 9)} {passage} {words('y', 9)}"), (5, line), (9, line), (9, line), (None, words("n", 60)), (None, f"m {words('n', 60)} o")]
    found = P.repeated_paragraphs(frame(rows), kept_lines=True, min_passage=40, run_words=P.RUN)
    got = sorted(((r.doc_id, r.class_doc_id, r.removed, r.n_words >= 100) for r in found.collect()), key=str)
    want = [(1, 1, False, False), (5, 1, True, False), (5, 5, False, True), (9, 5, True, True), (9, 5, True, True)]
    assert got == sorted([*want, (None, None, False, False), (None, None, False, False)], key=str)
    cleaned = {r.doc_id: r.text for r in P.remove_paragraphs(frame(rows[:4]), found).collect()}
    assert cleaned[1] == rows[0][1] and cleaned[9] == "" and line.startswith(cleaned[5][:70]) and cleaned[5].endswith(words("b", 20))
    assert P.repeated_paragraphs(frame([]), run_words=P.RUN).collect() == []
    assert P.repeated_paragraphs(frame([(1, "w " * 600), (2, None), (3, "")]), run_words=P.RUN).collect() == []
