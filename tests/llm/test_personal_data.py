import hashlib
import re
from itertools import product

import numpy as np
import pytest

from iolens.llm import personal_data as P
from iolens.llm.queries import QUERIES


def kinds(rows):
    return [(t, [(P.KINDS.index(k), a, b) for k, a, b in s]) for t, s in rows]


@pytest.fixture(scope="module")
def field():
    return P.fit(kinds(P.labelled_rows()))


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def brute_base(text):
    return [
        (P.KINDS.index(kind), m.start(), m.end())
        for kind, pattern, good in PATTERNS
        for m in re.finditer(pattern, text or "")
        if good(m.group())
    ]


TEXTS = [
    "", "a@b.c", "a@b.c@d.e", "@b.c x@ y@z", "a@@b.c", "é.x%+-9@a-b.c.d.", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1", "+1 (663) 555-6869",
    "4111 1111 1111 1111 and 4111111111111111 4111111111111111", "+12345678", "+1 2", "++12345678-", "1234567890123456", "1.1.1",
]


def test_patterns_equal_the_plain_expressions():
    random = np.random.default_rng(3)
    alphabet = list("aB9@.+-() 4101\n%é")
    texts = TEXTS + ["".join(random.choice(alphabet, 40)) for _ in range(3000)]
    for text in texts:
        assert P.base_spans(text) == brute_base(text), text


def test_long_runs_are_read_once():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + "(" * 300_000, "1 " * 60_000):
        P.base_spans(text)


def test_viterbi_gives_the_best_of_all_paths(field):
    text = "x@ 12 +3 (4) a.b@c.d 55"
    chain = [c for c in P.chains(text)][0][:5]
    scores = field.scores(chain)
    may_move, may_begin = P._allowed()

    def total(path):
        if not may_begin[path[0]] or not all(may_move[a, b] for a, b in zip(path, path[1:])):
            return -np.inf
        moves = sum(field.move[a, b] for a, b in zip(path, path[1:]))
        return field.begin[path[0]] + moves + sum(s[p] for s, p in zip(scores, path))

    best = max(product(range(P.LABELS), repeat=len(chain)), key=total)
    assert P.viterbi(field, [scores])[0].tolist() == list(best)


def test_chains_side_by_side_decode_as_alone(field):
    scores = [field.scores(c) for t, _ in P.labelled_rows(2, "other") for c in P.chains(t)]
    together = P.viterbi(field, scores)
    for s, labels in zip(scores, together):
        assert P.viterbi(field, [s])[0].tolist() == labels.tolist()


def test_field_on_held_out_rows(field):
    rows = kinds(P.labelled_rows(6, "held out"))
    missed = wrong = wanted = 0
    for (_, spans), (base, got) in zip(rows, P.all_spans(field, [t for t, _ in rows])):
        missed, wanted = missed + len(set(spans) - set(got)), wanted + len(spans)
        wrong += len(set(got) - set(base) - set(spans))
    assert missed <= 0.05 * wanted and wrong <= 0.05 * wanted


def test_field_adds_what_the_patterns_leave_out(field):
    text = "cards 4111111111111111 5500005555555559 and 1234567890123456; a token 41b1c411a9e4, v. 3.0.1"
    base, spans = P.all_spans(field, [text])[0]
    assert base == []
    assert [text[a:b] for _, a, b in spans] == ["4111111111111111", "5500005555555559"]
    assert all(not P.all_spans(field, [t])[0][1] for t in ("Version 4.0 of 2024-05-01, 3 of 17 pages", "no digits at all"))


def test_rows_of_all_kinds(spark, frame, field):
    rows = [(1, "me@x.org"), (1, "me@x.org"), (None, "+1 (663) 555-6869"), (2, None), (3, ""), (4, "4" * 200_000)]
    got = sorted(P.find(frame(rows), field).collect(), key=str)
    assert len(got) == 6
    assert [(s.kind, s.start, s.end) for r in got if r.doc_id == 1 for s in r.spans] == [("email", 0, 8)] * 2
    assert all(not r.spans for r in got if r.doc_id in (2, 3, 4))
    assert P.find(frame([]), field).count() == 0


def test_labelled_table_of_odd_rows(spark):
    rows = [(None, []), ("a@b.c", None), ("a@b.c", [("other", 0, 5)]), ("1", [])]
    assert P.fit_table(P.labelled_table(spark, rows)).emit.shape[1] == P.LABELS
    assert P.fit_table(P.labelled_table(spark, [])).names == {}


def test_query_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op11_personal_data"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = brute_base(texts[r.doc_id])
        named = [f"{P.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in range(4)]
        assert set(named) <= set(r.spans.split(","))
