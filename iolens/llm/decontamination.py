"""Benchmark passages in texts, found by an Aho-Corasick automaton over normalised words."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from iolens.llm.common import stored

WINDOW = 10
#: Most bytes of benchmark text in one automaton; a larger benchmark is scanned for in parts.
MAX_BYTES = 2_000_000

#: ASCII bytes to lower case, and to blanks if they are no part of a word.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b < 0x80 else b
    for b in range(256)
)
_ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPAN = pa.struct([(name, pa.int64()) for name in ("first_word", "last_word", "start", "end")])
FOUND = (
    "n_words long, n_hit long, items array<{0}>, "
    "spans array<struct<first_word: long, last_word: long, start: long, end: long>>"
)


def normal_words(text: str | None) -> list[bytes]:
    """Lower-cased words (runs of digits, letters and everything beyond ASCII) as UTF-8."""
    return [] if text is None else text.encode().translate(_TABLE).split()


class Matcher:
    """All windows of the items in one automaton over word numbers."""

    def __init__(self, items: list[tuple], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        windows: dict[tuple, set] = {}
        for item, text in items:
            words = normal_words(text)
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                windows.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, owners in windows.items():
            self.automaton.add_word(ids, (len(ids), owners))
        self.empty = not windows
        if windows:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, int, list, list[dict]]:
        """Number of words, of hit words, items found, and stretches of hit words in the text as it is."""
        words = normal_words(text)
        if self.empty or not words:
            return len(words), 0, [], []
        found, runs = set(), []
        for last, (length, owners) in self.automaton.iter(tuple(map(self.numbers.get, words, repeat(0)))):
            found |= owners
            first = last - length + 1
            while runs and first <= runs[-1][1] + 1:  # ends come in order, starts need not
                first = min(first, runs.pop()[0])
            runs.append((first, last))
        if not runs:
            return len(words), 0, [], []
        at = [m.span() for m in _ORIGINAL_WORD.finditer(text)]
        spans = [{"first_word": a, "last_word": b, "start": at[a][0], "end": at[b][1]} for a, b in runs]
        return len(words), sum(b - a + 1 for a, b in runs), sorted(found), spans


_matchers: dict[str, Matcher] = {}


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, items, spans``.

    ``items`` are the ids, without repeats, of items with a window in the text; ``spans`` are the
    word ranges, and character ranges with exclusive ends, that hit words cover in the text as it is. A null or empty text has no
    words. Items with a null id or without words are ignored; rows of the same id are one item.
    Repeated documents each keep a row. Other columns are not read. Without a benchmark nothing is hit.

    The benchmark is broadcast only up to ``max_bytes`` of text, checked first. Beyond that it is
    dealt by hash into parts of about that size (an item is never split), each document is scanned
    once per part, and the parts are put together.
    """
    items, parts = _parts(benchmark, item_col, item_text_col, max_bytes)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item_type = items.schema["item"].dataType
    schema = f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, {FOUND.format(item_type.simpleString())}"
    if len(parts) == 1:
        return chosen.mapInArrow(_scanner(items, window), schema)
    chosen = chosen.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    chosen = stored(chosen, "scanned")  # numbered once for all parts
    found = None
    for part in parts:
        scanned = chosen.mapInArrow(_scanner(part, window), f"row long, {schema}")
        found = scanned if found is None else found.unionByName(scanned)
    merged = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("items"))).alias("items"),
        _united(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"),
    )
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    return merged.select("doc_id", "n_words", hit.alias("n_hit"), "items", "spans")


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has no window of the benchmark."""
    _, parts = _parts(benchmark, item_col, item_text_col, max_bytes)
    columns = docs.columns
    for i, part in enumerate(parts):
        docs = stored(docs, "scanned") if i else docs  # one automaton in memory at a time
        docs = docs.mapInArrow(_filter(part, window, columns.index(text_col)), docs.schema)
    return docs


def _parts(benchmark: DataFrame, item_col: str, text_col: str, max_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).dropna()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // max_bytes) or 1
    return items, [items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == i) for i in range(parts)]


def _united(spans: Column) -> Column:
    """Unite sorted word ranges that overlap or touch."""

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(
            last["first_word"].alias("first_word"),
            F.greatest(last["last_word"], s["last_word"]).alias("last_word"),
            last["start"].alias("start"),
            F.greatest(last["end"], s["end"]).alias("end"),
        )
        touches = (F.size(done) > 0) & (s["first_word"] <= F.try_element_at(done, F.lit(-1))["last_word"] + 1)
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(s))
        )

    return F.aggregate(spans, F.slice(spans, 1, 0), add)


def _matcher_of(items: DataFrame, window: int) -> Callable[[], Matcher]:
    """Sends the items to the workers; each builds its automaton once."""
    shared = items.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])
    key = uuid.uuid4().hex

    def matcher() -> Matcher:
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(shared.value, window)
        return _matchers[key]

    return matcher


def _filter(items: DataFrame, window: int, column: int):
    matcher_of = _matcher_of(items, window)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of()
        for batch in batches:
            yield batch.filter(pa.array([not matcher.scan(t.as_py())[1] for t in batch.column(column)], pa.bool_()))

    return keep


def _scanner(items: DataFrame, window: int):
    item_type = to_arrow_type(items.schema["item"].dataType)
    matcher_of = _matcher_of(items, window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of()
        for batch in batches:
            rows = [matcher.scan(t.as_py()) for t in batch.column("text")]
            words, hit, found, spans = zip(*rows) if rows else ([], [], [], [])
            kept = [c for c in batch.schema.names if c != "text"]
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(words, pa.int64()), pa.array(hit, pa.int64())]
            columns += [pa.array(found, pa.list_(item_type)), pa.array(spans, pa.list_(SPAN))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_words", "n_hit", "items", "spans"])

    return scan
