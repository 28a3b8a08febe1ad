"""Personal data in texts: exact patterns, and more spans by a linear-chain conditional random field.

The patterns give emails, addresses, cards that pass Luhn's check, and phone numbers with a country code. The
field labels what they leave out, such as numbers without a country code or two cards in a row. It reads the words
that hold a digit or an ``@``; other words are outside any span by definition, and so divide a text into
short chains that are labelled exactly. Tokens of a chain are runs of letters, runs of digits and single signs; their
features are shapes of tokens and words around them, never the words themselves. The weights are fitted to a small
labelled table by maximum likelihood; chains of many texts are decoded side by side by Viterbi's algorithm in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Most rows of the labelled table that are fitted.
MAX_LABELLED = 20_000
ROUNDS, RATE, PENALTY = 100, 0.2, 0.02
#: Tokens decoded side by side at most, if chains are shorter.
DECODED = 100_000
#: Tokens whose features are held as text at a time.
SCORED = 4096

Span = tuple[int, int, int]  # kind, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BACKWARDS = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_NOTABLE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    # from each @ to the left and right, so that a long run of letters is read once
    end, at = 0, text.find("@")
    while at >= 0:
        local = _LOCAL_BACKWARDS.match(text[end:at][::-1])
        domain = local and _DOMAIN.match(text, at + 1)
        if domain:
            yield 0, at - local.end(), domain.end()
        end = domain.end() if domain else at + 1
        at = text.find("@", end)


def valid(kind: int, found: str) -> bool:
    """Whether a span can be what it is labelled as, by its digits or parts."""
    if kind == 0:
        local, _, domain = found.partition("@")
        return bool(local) and "@" not in domain and "." in domain.strip(".")
    if kind == 1:
        parts = [p.lstrip("0") for p in found.split(".")]
        return len(parts) == 4 and all(len(p) <= 3 and (not p or p.isdecimal() and int(p) <= 255) for p in parts)
    digits = _NO_DIGIT.sub("", found)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 8 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end)`` of the patterns, by kind and start; ends are exclusive, in code points."""
    if not _NOTABLE.search(text):
        return []
    out = list(_emails(text))
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return out


# Labels: 0 outside, then for each kind its first token and its other tokens.
LABELS = 1 + 2 * len(KINDS)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)
_RUNS = re.compile(r"[0-9]+|[^\W\d_]+")
_FOUR_PARTS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])")
_SIGNS = set("@._%+-()[]<>/:,;#=\"'")

Token = tuple[int, int, str, str]  # start, end, shape, shape of its word


def _size(n: int) -> str:
    for least in (20, 17, 16, 13, 9, 7, 5):
        if n >= least:
            return f"{least}+"
    return str(n)


def _shape(text: str) -> str:
    c = text[0]
    if "0" <= c <= "9":
        checked = 16 <= len(text) <= 19 and luhn(text)
        return "d" + _size(len(text)) + (">" if len(text) == 3 and text > "255" else "v" if checked else "")
    if c.isalpha():
        case = "x" if text.islower() else "X" if text.isupper() else "Xx"
        return case + str(min(len(text), 4))
    return c if c in _SIGNS else "?"


def _word_shape(word: str) -> str:
    # an edge of signs, as in "(5)," or "5###", says nothing about what the word is
    core = word.strip("\"'<>[]{},;:!?#*$%&|").rstrip(".")
    core = _FOUR_PARTS.sub(lambda m: "b" if valid(1, m[0]) else m[0], core)
    return _RUNS.sub(lambda m: "d" + _size(len(m[0])) if m[0][0] in "0123456789" else m[0] if m[0] == "b" else "x", core)[:40]


def chains(text: str) -> list[list[Token]]:
    """Tokens of neighbouring words of a line that hold a digit or an ``@``."""
    out: list[list[Token]] = []
    if not _NOTABLE.search(text):
        return out
    last, notable = -1, _NOTABLE.search
    for m in _WORD.finditer(text):
        word = m.group()
        if not notable(word):
            continue
        start, end = m.span()
        if last < 0 or start - last > 2 or not text[last:start].isspace() or "\n" in text[last:start]:
            out.append([])
        shape, space = _word_shape(word), " "
        for t in _TOKEN.finditer(word):
            out[-1].append((start + t.start(), start + t.end(), space + _shape(t.group()), shape))
            space = ""
        last = end
    return out


def features(chain: list[Token]) -> Iterator[list[str]]:
    shapes = ["<<", "<", *[t[2] for t in chain], ">", ">>"]
    words = ["<", *[t[3] for t in chain if t[2][0] == " "], ">"]  # a word's first token follows a space
    at = -1
    for i, t in enumerate(chain):
        at += t[2][0] == " "
        a, b, c, d, e = shapes[i : i + 5]
        before, word, after = words[at : at + 3]
        yield [
            f"0{c}", f"-1{b}", f"+1{d}", f"-2{a}", f"+2{e}", f"-10{b}|{c}", f"0+1{c}|{d}",
            f"w{word}", f"wb{before}|{word}", f"wa{word}|{after}", f"w0{word}|{c}",
        ]


@dataclass
class Field:
    """Weights of a linear-chain conditional random field."""

    names: dict[str, int]
    emit: np.ndarray  # feature (the last row is for unknown ones, zero), label
    move: np.ndarray  # label, next label
    begin: np.ndarray

    def scores(self, chain: list[Token]) -> np.ndarray:
        none, rows, out = len(self.emit) - 1, features(chain), []
        while ids := [[self.names.get(f, none) for f in row] for row in islice(rows, SCORED)]:
            out.append(self.emit[np.array(ids)].sum(axis=1))
        return np.concatenate(out)


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """A label inside a span follows a label of the same span only."""
    move, begin = np.ones((LABELS, LABELS), bool), np.ones(LABELS, bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        move[:, inside] = False
        move[[inside - 1, inside], inside] = True
        begin[inside] = False
    return move, begin


def _padded(arrays: list[np.ndarray], fill) -> np.ndarray:
    out = np.full((len(arrays), max(map(len, arrays)), *arrays[0].shape[1:]), fill, arrays[0].dtype)
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    return out


def labels_of(chain: list[Token], spans: list[Span]) -> np.ndarray:
    out, seen = np.zeros(len(chain), np.int64), set()
    for i, (start, end, *_) in enumerate(chain):
        for span in spans:
            if span[1] <= start and end <= span[2]:
                out[i] = 2 + 2 * span[0] if span in seen else 1 + 2 * span[0]
                seen.add(span)
    return out


def fit(rows: list[tuple[str, list[Span]]]) -> Field:
    """Weights of greatest penalised likelihood on labelled texts; the same rows give the same weights."""
    held = [(c, spans) for text, spans in rows for c in chains(text)]
    if not held:
        return Field({}, np.zeros((1, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS))
    held.sort(key=lambda h: -len(h[0]))  # stable
    names: dict[str, int] = {}
    ids = [np.array([[names.setdefault(f, len(names)) for f in row] for row in features(c)]) for c, _ in held]
    want = [labels_of(c, spans) for c, spans in held]
    size = len(names)
    x, y = _padded(ids, size), _padded(want, 0)
    real = _padded([np.ones(len(w), bool) for w in want], False)
    may_move, may_begin = _allowed()
    flat = x[real]
    truth = np.eye(LABELS)[y[real]]
    emit, move, begin = np.zeros((size + 1, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS)
    weights = [emit, move, begin]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    pairs = np.zeros_like(move)
    both = real[:, 1:]
    np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
    starts = np.eye(LABELS)[y[:, 0]].sum(axis=0)
    for step in range(1, ROUNDS + 1):
        local = emit[x].sum(axis=2)
        local = np.exp(local - local.max(axis=2, keepdims=True))
        go, enter = np.exp(move) * may_move, np.exp(begin) * may_begin
        ahead, back = np.zeros_like(local), np.ones_like(local)
        alive = real.sum(axis=0)  # chains are sorted, so those with a token at t come first
        ahead[:, 0] = enter * local[:, 0]
        ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, x.shape[1]):
            n = alive[t]
            ahead[:n, t] = (ahead[:n, t - 1] @ go) * local[:n, t]
            ahead[:n, t] /= ahead[:n, t].sum(axis=1, keepdims=True)
        likely_pairs = np.zeros_like(move)
        for t in range(x.shape[1] - 1, 0, -1):
            n = alive[t]
            right = back[:n, t] * local[:n, t]
            joint = ahead[:n, t - 1, :, None] * go * right[:, None, :]
            likely_pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back[:n, t - 1] = right @ go.T
            back[:n, t - 1] /= back[:n, t - 1].sum(axis=1, keepdims=True)
        share = ahead * back
        share /= np.maximum(share.sum(axis=2, keepdims=True), 1e-300)
        slope = np.zeros_like(emit)
        for j in range(flat.shape[1]):
            np.add.at(slope, flat[:, j], truth - share[real])
        slopes = [slope, pairs - likely_pairs, starts - share[:, 0].sum(axis=0)]
        for w, g, m, v in zip(weights, slopes, first, second):
            g = g - PENALTY * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        emit[size] = 0
    return Field(names, emit, move, begin)


def viterbi(field: Field, scores: list[np.ndarray]) -> list[np.ndarray]:
    """The best labels of each chain, all chains a token further at a time."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list = [None] * len(scores)
    may_move, may_begin = _allowed()
    move = np.where(may_move, field.move, -np.inf)
    begin = np.where(may_begin, field.begin, -np.inf)
    at = 0
    while at < len(order):
        longest = len(scores[order[at]])
        group = order[at : at + max(1, DECODED // longest)]
        at += len(group)
        local = _padded([scores[i] for i in group], 0.0)
        alive = np.array([sum(len(scores[i]) > t for i in group) for t in range(longest)]) if len(group) > 1 else np.ones(longest, int)
        best, came = begin + local[:, 0], np.zeros(local.shape, np.int8)
        for t in range(1, longest):
            n = alive[t]
            ways = best[:n, :, None] + move
            came[:n, t] = ways.argmax(axis=1)
            best[:n] = np.take_along_axis(ways, came[:n, t, None, :].astype(np.int64), axis=1)[:, 0] + local[:n, t]
        label = best.argmax(axis=1)
        labels = np.zeros(local.shape[:2], np.int8)
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            labels[:n, t] = label[:n]
            label[:n] = came[np.arange(n), t, label[:n]]
        for row, i in zip(labels, group):
            out[i] = row[: len(scores[i])]
    return out


def _spans(chain: list[Token], labels: np.ndarray) -> list[Span]:
    out: list[list[int]] = []
    for (start, end, *_), label in zip(chain, labels.tolist()):
        if label and label % 2:
            out.append([(label - 1) // 2, start, end])
        elif label:
            out[-1][2] = end
    return [tuple(s) for s in out]


def all_spans(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """For each text the spans of the patterns, and with them the field's that overlap none of them, by kind and start."""
    owners, held, out = [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text)
        out.append((base, list(base)))
        for chain in chains(text):
            owners.append(i)
            held.append(chain)
    decoded = viterbi(field, [field.scores(c) for c in held])
    for i, chain, labels in zip(owners, held, decoded):
        for kind, start, end in _spans(chain, labels):
            own = texts[i][start:end].rstrip("\"'<>[],:;.!?#*$%&|")
            inner = own.lstrip("\"'<>[],:;.!?#*$%&|")
            span = (kind, start + len(own) - len(inner), start + len(own))
            good = valid(span[0], texts[i][span[1] : span[2]])
            if good and not any(span[1] < b[2] and b[1] < span[2] for b in out[i][0]):
                out[i][1].append(span)
    return [(base, sorted(spans)) for base, spans in out]


_SPAN = "array<struct<kind: string, start: long, end: long>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans`` of each row: spans of the patterns, and all spans, each by kind and start.

    A span has ``kind, start, end`` in code points, the end exclusive; ``spans`` holds all of ``base``, and what the
    field adds overlaps none of those. Null and empty texts have none. Repeated rows have a result each; a null id
    stays null. Other columns are not read. An empty table gives no rows. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def named(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            found = all_spans(shared.value, texts)
            columns = [pa.array([named(f[k]) for f in found], _ARROW) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "base", "spans"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(work, f"doc_id long, base {_SPAN}, spans {_SPAN}")


def fit_table(labelled: DataFrame, most: int = MAX_LABELLED) -> Field:
    """A field fitted to ``text, spans`` rows; of more than ``most`` rows, a sample by hash of the text.

    Rows without a text are left out; null spans are none; kinds that are not ``KINDS`` are outside any span.
    """
    rows = labelled.where("text is not null").select("text", "spans").orderBy(F.xxhash64("text"), "text").limit(most)
    return fit([
        (r.text, [(KINDS.index(s.kind), s.start, s.end) for s in r.spans or () if s.kind in KINDS]) for r in rows.collect()
    ])


# How labelled texts look. d is a digit, b a number up to 255, x a lower-case word, X an upper-case
# letter, h a hexadecimal digit; other characters stand for themselves.
PLACES = ("{}", "{}.", "{},", "({})", "{}###", "{}$$$", '"{}"', "tel: {}", "<{}>", "{};", "id={}", "{} {}", "{} {}", "{}, {}", "{}: {}")
POSITIVE = {
    "email": ("x@x.x", "x.x@x.x", "x.dd@xd.x.x", "x_x@x-x.x", "xd@x.x.x", "x+x@x.x", "X.x@x.x"),
    "ip": ("b.b.b.b", "b.b.b.b"),
    "card": ("dddddddddddddddd", "dddd dddd dddd dddd", "dddd-dddd-dddd-dddd", "dddddddddddddddd"),
    "phone": (
        "+d (ddd) ddd-dddd", "+dd dd dddd dddd", "(ddd) ddd-dddd", "ddd-ddd-dddd", "+ddddddddddd", "ddd.ddd.dddd",
        "+dd ddd ddddddd", "(ddd)ddd-dddd", "+dd (d)dd ddddddd", "ddd ddd dddd",
    ),
}
NEGATIVE = (
    "d", "dd", "ddd", "dddd", "ddddd", "dddddddd", "ddddddddd", "d.d", "d.d.d", "d.d.d.d.d", "dd.dd.dddd", "dddd-dd-dd",
    "dd/dd/dddd", "dd:dd", "dd:dd:dd", "d,ddd.dd", "d,ddd,ddd", "$d.dd", "dd%", "d-d", "dd-dd", "dddd-dddd", "#ddd", "xd",
    "x-dd", "Xd", "dx", "x=dd", "@x", "x@", "d@d", "ddd.ddd", "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh", "hhhhhhhhhhhhhhhhhh",
    "x=hhhhhhhhhhhhhhhhhh", "hhhhhhhhhhhhhhhh", "XXXXdXdXXXdXXdXddXXX", "XXXXXXXdXXdXXXXddXXX", "ddd-d-dd-dddddd-d", "dddddddddddddddddddddd",
    "ddddddddddddd", "hhhhhhhh-hhhh-hhhh-hhhh-hhhhhhhhhhhh", "vd.d.d", "dddd dddd", "dd dd dd", "dddd dddd dddd dddd dddd dddd",
    "b.b.b.b.b.b", "999.b.b.b", "dddddddddddddddddddddddddddddddd", "+d", "+dd", "d+d=d", "(d)", "(dddd)", "d d d d d d d d",
    "dddddddddddddddd", "dddddddddddddddd",
)
DRAWS = 6


def _draw(mask: str, key: str) -> str:
    out, digest = [], b""
    for i, c in enumerate(mask):
        r = xxhash.xxh64_intdigest(f"{key}/{i}")
        letters = "abcdefghijklmnopqrstuvwxyz"
        if c == "d":
            out.append(str(r % 10))
        elif c == "b":
            out.append(str(r % (10, 100, 256)[r // 256 % 3]))
        elif c == "h":
            out.append("0123456789abcdef"[r % 16])
        elif c == "X":
            out.append(letters[r % 26].upper())
        elif c == "x":
            out.append("".join(letters[(r >> (5 * k)) % 26] for k in range(2 + r % 7)))
        else:
            out.append(c)
    return "".join(out)


def _checked(number: str) -> str:
    """The number with its last digit chosen so that Luhn's check passes."""
    return next(n for d in "0123456789" if luhn(_NO_DIGIT.sub("", n := number[:-1] + d)))


def labelled_rows(draws: int = DRAWS, key: str = "fit") -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled texts by rule: every form in ``draws`` places, with other numbers and neighbours each time."""
    forms = [(kind, mask) for kind, masks in POSITIVE.items() for mask in masks] + [(None, mask) for mask in NEGATIVE]
    rows = []
    for f, (kind, mask) in enumerate(forms):
        for n in range(draws):
            own = f"{key}/{f}/{n}"
            r = xxhash.xxh64_intdigest(own)
            place = PLACES[r % len(PLACES)] if n else "{}"
            other_kind, other = forms[r // 64 % len(forms)]
            if place.count("{}") == 2 and (kind is None or other_kind is None):
                other_kind, other = kind, mask  # two numbers in a row could be one of another form
            values = [(kind, _draw(mask, own)), (other_kind, _draw(other, own + "+"))][: place.count("{}")]
            values = [(k, _checked(v) if k == "card" else v) for k, v in values]
            text, spans = "x " if r // 7 % 2 else "", []
            for piece, value in zip(place.split("{}"), [*values, None]):
                text += piece
                if value:
                    if value[0]:
                        spans.append((value[0], len(text), len(text) + len(value[1])))
                    text += value[1]
            rows.append((text + (" x" if r // 11 % 2 else ""), spans))
    return rows


def labelled_table(spark: SparkSession, rows: list | None = None) -> DataFrame:
    return spark.createDataFrame(labelled_rows() if rows is None else rows, f"text string, spans {_SPAN}")
