"""Repeated and near-repeated paragraphs across documents, by MinHash banding.

A paragraph is a line of a text. Its shingles are runs of five lower-cased words; ``ROWS`` MinHash values
make a band, and paragraphs that share one of ``BANDS`` bands are candidates. At a similarity of 0.8 a
pair misses all bands once in 1,300 times, at 0.85 once in 13,000. Candidates are verified by the exact
Jaccard similarity of their shingle sets, links are gathered to connected components, and one
occurrence of each component stays.

A passage may also be repeated inside longer lines that are not alike. So the sentences of a line
are units too, which meet other sentences and lines of the same words by one band more.

A band is compared in two steps. First every paragraph of it is compared with the band's hub, the one that meets
most others in all of its bands; in a group of near copies that is the text they come from, so one step
connects the group. Of bands that are then not of one component, all pairs are compared: their paragraphs are dealt into
blocks of bounded size, each two blocks meet in one task, which counts common shingles for all pairs and gives
nothing but links between components. No pair becomes a row, and a band's size changes nothing but the number of blocks.

A passage is repeated if it has enough words: units that follow each other count together, single
sentences that many texts share by chance, or license lines, do not.

A passage need not begin or end with a sentence, and its sentences can be short. So runs of ``RUN`` words are
units of a third kind, wherever they begin: of each ``REACH`` that follow each other the one of least hash, which
equal words choose alike. Any ``RUN + REACH - 1`` words that two texts share have such a run in both, and
runs that meet or overlap are one passage again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iolens.llm.common import stored
from iolens.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
MIN_WORDS = 10
#: Least words of a repeated passage, which may be several units in a row.
MIN_PASSAGE = 40
#: Words of a run, and beginnings of runs of which one is chosen: 51 equal words always share one.
RUN, REACH = 32, 20
BANDS, ROWS = 10, 3
#: Paragraphs of a block on average, and characters of them.
BLOCK, BLOCK_CHARS = 512, 1_000_000
#: Words of new lines that a worker signs at a time.
HELD_WORDS = 200_000
#: Bits of the fixed-size filter that keeps texts without a candidate from being shuffled.
FILTER_BITS = 24


_SENTENCE_END = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]")


def units(text: str | None, min_words: int) -> Iterator[tuple[int, int, int, int, bool, list[bytes]]]:
    """``(line, start, end, number of the first word, is a sentence, words)`` of lines, and sentences of them, with enough words."""
    at = word = 0
    for number, line in enumerate(text.split("\n") if text else ()):
        words = line.encode().lower().split()
        if len(words) >= min_words:
            yield number, at, at + len(line), word, False, words
            pieces = _SENTENCE_END.split(line) if len(words) > min_words else ()
            inside, first = at, word
            for piece in pieces if len(pieces) > 1 else ():
                own = piece.encode().lower().split()
                if min_words <= len(own) < len(words):
                    yield number, inside, inside + len(piece), first, True, own
                inside, first = inside + len(piece) + 1, first + len(own)
        at, word = at + len(line) + 1, word + len(words)


def paragraph_id(words: list[bytes]) -> int:
    return int.from_bytes(xxhash.xxh64_digest(b" ".join(words)), "big", signed=True)


def shingles(words: list[bytes]) -> set[bytes]:
    if len(words) < SHINGLE:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))))


def _constants() -> tuple[np.ndarray, np.ndarray]:
    digests = [xxhash.xxh64_intdigest(str(i), 1) for i in range(2 * BANDS * ROWS)]
    table = np.array(digests, np.uint64).reshape(2, -1)
    return table[0] | np.uint64(1), table[1]


_FACTORS, _OFFSETS = _constants()
_STEP = np.uint64(0x9E3779B97F4A7C15)  # the golden ratio, odd
_STEP_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _powers(n: int) -> list[np.ndarray]:
    return [np.cumprod(np.full(n, x)) for x in (_STEP, _STEP_BACK)]


_POWERS = _powers(4_096)  # longer texts make their own
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def bands_of(texts: list[list[bytes]]) -> np.ndarray:
    """A row of ``BANDS`` signed band values for each list of at least ``SHINGLE`` words."""
    if not texts:
        return np.empty((0, BANDS), np.int64)
    return _bands([_digests(t) for t in texts])


def _digests(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), "<u8")


def _bands(texts: list[np.ndarray]) -> np.ndarray:
    words = np.concatenate(texts)
    runs = words[: len(words) - SHINGLE + 1].copy()
    for i in range(1, SHINGLE):
        runs = runs * _STEP + words[i : len(words) - SHINGLE + 1 + i]
    runs = _mixed(runs)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    inside = np.ones(len(words), bool)  # runs that go beyond their text are left out
    for i in range(1, SHINGLE):
        inside[ends - i] = False
    runs = runs[inside[: len(runs)]]
    starts = np.cumsum(sizes - SHINGLE + 1) - (sizes - SHINGLE + 1)
    out = np.empty((len(texts), BANDS), np.uint64)
    for b in range(BANDS):
        value = np.full(len(texts), b + 1, np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            value = _mixed(value * _STEP + np.minimum.reduceat(runs * _FACTORS[k] + _OFFSETS[k], starts))
        out[:, b] = value
    return out.view(np.int64)


def _extremes(values: np.ndarray, size: int, of: np.ufunc) -> np.ndarray:
    """The least or largest of each ``size`` values in a row."""
    step = 1
    while 2 * step <= size:
        values, step = of(values[:-step], values[step:]), 2 * step
    return of(values[: len(values) - size + step], values[size - step :])


def runs_of(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and signed hashes of the chosen runs of ``size`` words, by the digests of a text's words."""
    if len(words) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    powers, back = _POWERS if len(words) <= len(_POWERS[0]) else _powers(len(words))
    sums = np.cumsum(words * powers[: len(words)])
    sums[size:] -= sums[:-size]
    # each sum to the same powers
    hashes = _mixed(_mixed(sums[size - 1 :] * back[: len(words) - size + 1]))
    reach = min(REACH, len(hashes))
    least = _extremes(hashes, reach, np.minimum)
    edge = np.zeros(reach - 1, np.uint64)
    chosen = np.flatnonzero(_extremes(np.concatenate([edge, least, edge]), reach, np.maximum) == hashes)
    own = np.sort(hashes[chosen])
    if (own[1:] != own[:-1]).all():
        return chosen, hashes[chosen].view(np.int64)
    # a text of few words that come back has equal runs: one is enough at a time
    chosen = chosen[np.lexsort((chosen, hashes[chosen]))]
    own, part = hashes[chosen], chosen // (REACH // 2)
    chosen = np.sort(chosen[np.concatenate([[True], (own[1:] != own[:-1]) | (part[1:] != part[:-1])])])
    return chosen, hashes[chosen].view(np.int64)


def places_of(raw: bytes, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines, and first and last characters, of ``size`` words from each of the first ones on."""
    blank = _BLANK[np.frombuffer(b" " + raw + b" ", np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    letters = np.frombuffer(raw, np.uint8)
    start, end = edges[::2][first], edges[1::2][first + size - 1]
    line = np.searchsorted(np.flatnonzero(letters == 10), start)
    if not raw.isascii():
        before = np.concatenate([[0], np.cumsum((letters & 0xC0) != 0x80)])
        start, end = before[start], before[end]
    return line, start, end


def repeated_paragraphs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
    kept_lines: bool = False, min_passage: int = 0, run_words: int = 0,
) -> DataFrame:
    """One row per paragraph that has a near copy: where it is, its class, and whether it goes.

    ``doc_id, paragraph, start, end, n_words, class_doc_id, class_paragraph, removed``: ``paragraph``
    numbers the lines of the text from 0, ``start`` and ``end`` are the characters of the line or
    sentence; sentences of lines that have a row themselves are left out. The class is named by its
    first occurrence in the order of id, line and start, which is the one that stays. With ``kept_lines``
    only the sentences of lines that go are left out, and of a line that stays they go by themselves;
    the class is then named by the occurrence that stays, which is the first one in lines that stay, or
    the line itself if it holds sentences of enough words. Lines and
    sentences of fewer than ``min_words`` (at least 5) words are never repeated ones; null and empty
    texts have none. A stretch of repeated units of a text, with fewer than ``min_words`` words between
    one and the next, counts from ``min_passage`` words on, so the class may be named by an occurrence without a row. A null id comes before all others. Rows of the same id that hold a paragraph at
    the same place stay or go together. Other columns are not read. An empty table gives no rows.

    With ``run_words`` also passages that other rows of ``docs`` hold word for word have a row, where none of it
    goes with a row above: all of ``run_words + REACH - 1`` words, none of fewer than ``run_words``, and
    a row may be up to ``REACH - 1`` words short at either end. Such a passage may span lines; it stays in the first
    document that keeps it and goes from the others. ``paragraph`` is the line where it begins.
    """
    if min_words < SHINGLE:
        raise ValueError(f"paragraphs need at least {SHINGLE} words")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    given = stored(chosen.mapInArrow(_signer(min_words, run_words), _SIGNED), "paragraphs")
    signed = given.where("sentence is not null")
    bands = signed.where("bands is not null").select("para", F.explode("bands").alias("band"))
    members = _members(chosen, stored(_crowded(bands), "bands"), min_words)
    named = signed.drop("bands").join(members, signed["para"] == members["node"], "left")
    named = named.withColumn("class", F.coalesce("component", "para")).drop("node", "component")
    found = _found_in_kept(stored(named, "named")) if kept_lines else _found(named)
    found = _passages(found, min_words, min_passage) if min_passage > min_words else found
    found = found.select(
        "doc_id", "paragraph", "start", "end", "n_words",
        F.col("first.doc_id").alias("class_doc_id"), F.col("first.paragraph").alias("class_paragraph"), "removed",
        "row", "word",
    )
    if run_words:
        found = stored(found, "found")
        found = found.unionByName(_run_passages(given.where("sentence is null"), found, run_words), True)
    return found.drop("row", "word")


def _run_passages(runs: DataFrame, units_: DataFrame, size: int) -> DataFrame:
    """Passages of runs that several texts keep when some of ``units_`` go, without those that stay in a unit that stays."""
    runs = runs.select("doc_id", "paragraph", "start", "end", "para", "row", "word")
    several = runs.groupBy("para").agg(F.min("row").alias("one"), F.max("row").alias("other")).where("one < other")
    # stored, so that the joins below can split a common run
    shared = runs.join(stored(several.select("para"), "shared-runs"), "para")
    end = F.col("word") + F.col("n_words")
    at = F.when(F.col("removed"), F.col("word")).otherwise(F.col("word") + size - 1)
    spans = units_.select("row", at.alias("at"), F.when(F.col("removed"), end).alias("gone"), F.when(~F.col("removed"), end).alias("stays"))
    both = shared.withColumn("at", F.col("word") + size - 1).unionByName(spans, True)
    before = Window.partitionBy("row").orderBy("at", F.col("para").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("gone", F.max("gone").over(before)).withColumn("stays", F.max("stays").over(before))
    kept = both.where("para is not null and coalesce(gone <= word, true)")
    inside = F.coalesce(F.col("stays") >= F.col("word") + size, F.lit(False))
    kept = stored(kept.withColumn("inside", inside).drop("at", "gone", "stays"), "kept-runs")
    first = F.min(F.struct("doc_id", "paragraph")).alias("first")
    classes = kept.groupBy("para").agg(first, F.min("row").alias("one"), F.max("row").alias("other"))
    found = kept.join(stored(classes.where("one < other").select("para", "first"), "run-classes"), "para")
    found = found.withColumn("removed", ~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).where("removed or not inside")
    order = Window.partitionBy("row", "first.doc_id").orderBy("word")
    begins = F.coalesce(F.col("word") - F.lag("word").over(order) > size, F.lit(True)).cast("int")
    part = found.withColumn("begins", begins).withColumn("stretch", F.sum("begins").over(order))
    joined = part.groupBy("row", F.col("first.doc_id").alias("class_doc_id"), "stretch").agg(
        F.min("doc_id").alias("doc_id"), F.min("paragraph").alias("paragraph"), F.min("start").alias("start"), F.max("end").alias("end"),
        (F.max("word") + size - F.min("word")).alias("n_words"), F.min("first.paragraph").alias("class_paragraph"), F.first("removed").alias("removed"),
    )
    return joined.drop("row", "stretch")


def _passages(found: DataFrame, min_words: int, min_passage: int) -> DataFrame:
    """Units in stretches of enough words. The windows are over the units of one text."""
    order = Window.partitionBy("row").orderBy("word", F.desc("n_words"), "sentence")
    end = F.max(F.col("word") + F.col("n_words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("word") - F.col("reached") >= min_words, F.lit(True)).cast("int")
    part = found.withColumn("reached", end).withColumn("stretch", F.sum(begins).over(order))
    whole = Window.partitionBy("row", "stretch")
    size = F.max(F.col("word") + F.col("n_words")).over(whole) - F.min("word").over(whole)
    return part.withColumn("size", size).where(F.col("size") >= min_passage).drop("reached", "stretch", "size")


def _found(named: DataFrame) -> DataFrame:
    """Repeated lines, and repeated sentences of other lines."""
    place = F.struct("doc_id", "paragraph", "start", "sentence")
    # stored, so that the join below can split a large class
    classes = stored(named.groupBy("class").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "classes")
    found = stored(named.join(classes, "class").withColumn("removed", ~place.eqNullSafe(F.col("first"))), "repeated")
    whole = found.where("not sentence").select(F.col("doc_id").alias("d"), F.col("paragraph").alias("p")).distinct()
    inside = found.where("sentence")
    inside = inside.join(whole, inside["doc_id"].eqNullSafe(whole["d"]) & (F.col("paragraph") == F.col("p")), "left_anti")
    return found.where("not sentence").unionByName(inside)


def _found_in_kept(named: DataFrame) -> DataFrame:
    """Repeated lines, and repeated sentences of the lines that stay."""
    place = F.struct("doc_id", "paragraph", "start", "sentence")
    # stored, so that the joins below can split a large class
    heads = stored(named.where("not sentence").groupBy("class").agg(F.min(place).alias("head")), "heads")
    headed = named.where("not sentence").join(heads, "class").withColumn("copy", ~place.eqNullSafe(F.col("head"))).drop("head")
    lines = stored(headed, "lines")
    # sentences of copies go with their line; those of other lines are occurrences of their own
    gone = lines.where("copy").select(F.col("doc_id").alias("d"), F.col("paragraph").alias("p")).distinct()
    inside = named.where("sentence")
    inside = inside.join(gone, inside["doc_id"].eqNullSafe(gone["d"]) & (F.col("paragraph") == F.col("p")), "left_anti")
    units_ = stored(lines.unionByName(inside.withColumn("copy", F.lit(False))), "units")
    # a line with sentences of its own stays before any sentence, so that no sentence that stays is lost with its line
    rank = F.when(F.col("copy"), 2).when(F.col("holds"), 0).otherwise(1)
    ranked = F.struct(rank.alias("rank"), *[F.col(c) for c in ("doc_id", "paragraph", "start", "sentence")])
    classes = stored(units_.groupBy("class").agg(F.min(ranked).alias("first"), F.count("*").alias("n")).where("n > 1"), "classes")
    return units_.join(classes, "class").withColumn("removed", ~ranked.eqNullSafe(F.col("first")))


def remove_paragraphs(docs: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what goes, and one blank or line end after it, taken out of the text."""
    span = F.struct("start", "end")
    gone = repeated.where("removed").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(span).alias("__gone"))
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]), "left")
    text = F.col(text_col)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("kept"))

    def step(acc: Column, cut: Column) -> Column:
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (cut["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], cut["end"] + 1).alias("at"), F.concat(acc["kept"], piece).alias("kept"))

    def rest(acc: Column) -> Column:
        return F.concat(acc["kept"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))

    cleaned = F.when(F.col("__gone").isNull(), text).otherwise(F.aggregate(F.array_sort("__gone"), begin, step, rest))
    return joined.select(*[cleaned.alias(c) if c == text_col else docs[c] for c in docs.columns])


_FIELDS = ("doc_id", "paragraph", "start", "end", "n_words", "para", "row", "word")
_SIGNED = ", ".join(f"{f} long" for f in _FIELDS) + ", sentence boolean, holds boolean, bands array<long>"


def _signer(min_words: int, run_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, sentences = set(), set()  # bands are given once per task
        rows, fresh, line_at, sentence_at, runs, held = [], [], [], [], [], 0
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                row, text = row + 1, text.as_py()
                raw = text.encode() if text else b""
                digests = _digests(raw.lower().split())
                if run_words:
                    first, hashes = runs_of(digests, run_words)
                    if len(first):
                        runs.append((doc_id, row, first, hashes, *places_of(raw, first, run_words)))
                        held += len(first)
                for number, start, end, word, sentence, words in units(text, min_words):
                    para = paragraph_id(words)
                    if sentence and para not in sentences:
                        sentences.add(para)
                        sentence_at.append(len(rows))
                    elif not sentence and para not in lines:
                        lines.add(para)
                        line_at.append(len(rows))
                        fresh.append(digests[word : word + len(words)])
                        held += len(words)
                    if sentence:
                        rows[line][-1] = True
                    else:
                        line = len(rows)
                    rows.append([doc_id, number, start, end, len(words), para, row, word, sentence, False])
                if held > HELD_WORDS:  # whole documents, but few at a time
                    yield _signed(rows, line_at, sentence_at, fresh)
                    yield from _run_rows(runs, run_words)
                    rows, fresh, line_at, sentence_at, runs, held = [], [], [], [], [], 0
        yield _signed(rows, line_at, sentence_at, fresh)
        yield from _run_rows(runs, run_words)

    return run


def _signed(rows: list[list], line_at: list[int], sentence_at: list[int], fresh: list) -> pa.RecordBatch:
    values = list(zip(*rows)) or [()] * 10
    columns = [pa.array(c, pa.int64()) for c in values[:8]] + [pa.array(c, pa.bool_()) for c in values[8:]]
    bands = _bands(fresh) if fresh else bands_of([])
    columns.append(_band_lists(np.array(values[5], np.int64), line_at, sentence_at, bands))
    return pa.RecordBatch.from_arrays(columns, [*_FIELDS, "sentence", "holds", "bands"])


def _run_rows(runs: list[tuple], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of runs: neither lines nor sentences."""
    if runs:
        names, rows, *parts = zip(*runs)
        sizes = [len(first) for first in parts[0]]
        word, para, line, start, end = (pa.array(np.concatenate(p), pa.int64()) for p in parts)
        doc_id = pa.array(names, pa.int64()).take(pa.array(np.repeat(np.arange(len(runs)), sizes)))
        row, n_words = pa.array(np.repeat(np.array(rows), sizes)), pa.array(np.full(len(word), size))
        columns = [doc_id, line, start, end, n_words, para, row, word]
        none = [pa.nulls(len(word), kind) for kind in (pa.bool_(), pa.bool_(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns + none, [*_FIELDS, "sentence", "holds", "bands"])


def _band_lists(paras: np.ndarray, line_at: list[int], sentence_at: list[int], bands: np.ndarray) -> pa.Array:
    """For new lines the band of equal words and the MinHash bands, for new sentences the first."""
    sizes = np.zeros(len(paras), np.int32)
    sizes[line_at], sizes[sentence_at] = BANDS + 1, 1
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.empty(offsets[-1], np.int64)
    equal = _mixed(paras.view(np.uint64)).view(np.int64)
    for at in (line_at, sentence_at):
        flat[offsets[at]] = equal[at]
    if line_at:
        flat[offsets[line_at][:, None] + 1 + np.arange(BANDS)] = bands
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(sizes == 0))


def _crowded(bands: DataFrame) -> DataFrame:
    """``band, para, hub`` for bands of several paragraphs, each once however many tasks gave it."""
    several = bands.groupBy("band").agg(F.min("para").alias("one"), F.max("para").alias("other")).where("one < other")
    # stored, so that the joins below can split a large band
    several = stored(several.select("band"), "several")
    crowded = stored(bands.join(several, "band").distinct(), "crowded")
    sizes = stored(crowded.groupBy("band").agg(F.count("*").alias("n")), "sizes")
    met = stored(crowded.join(sizes, "band").groupBy("para").agg(F.sum("n").alias("met")), "met")
    rank = F.struct("met", F.xxhash64("para").alias("mix"), "para")
    hubs = crowded.join(met, "para").groupBy("band").agg(F.max(rank)["para"].alias("hub"))
    return crowded.join(stored(hubs, "hubs"), "band")


def _members(docs: DataFrame, crowded: DataFrame, min_words: int) -> DataFrame:
    """``node, component`` of the paragraphs that are linked to a smaller one."""
    texts = stored(_texts(docs, crowded.select("para").distinct(), min_words), "texts")
    star = crowded.where("para <> hub").select(F.col("hub").alias("a"), F.col("para").alias("b")).distinct()
    near = stored(connected_components(_verified(star, texts)), "near")
    named = crowded.join(near, crowded["para"] == near["node"], "left").select("band", "para", F.coalesce("component", "para").alias("component"))
    named = stored(named, "joined")
    members = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("para")).alias("mix"))
    several = named.groupBy("band").agg(F.min("component").alias("one"), F.max("component").alias("other"), members.alias("members")).where("one < other")
    open_ = stored(several.groupBy("members").agg(F.min("band").alias("band")).select("band"), "open")  # alike bands once
    more = stored(connected_components(_block_links(named.join(open_, "band"), texts)), "more")
    moved = near.join(more.withColumnRenamed("node", "old").withColumnRenamed("component", "new"), F.col("component") == F.col("old"), "left")
    first = moved.select("node", F.coalesce("new", "component").alias("component"))
    return first.union(more.join(near.select("node"), "node", "left_anti").select("node", "component"))


def _block_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b``: components of ``band, para, component`` rows that near paragraphs of a band connect."""
    held = stored(members.join(texts, "para"), "open-texts")
    count = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("text")) / BLOCK_CHARS)).cast("int")
    blocks = stored(held.groupBy("band").agg(count.alias("blocks")), "blocks")
    own = F.pmod(F.xxhash64("para", "band"), F.col("blocks")).cast("int")
    dealt = held.join(blocks, "band").withColumn("own", own)
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "component", "text")
    return met.groupBy("band", "i", "j").applyInArrow(_linked, "a long, b long")


def _linked(blocks: pa.Table) -> pa.Table:
    members = blocks.select(["own", "component", "text"]).to_pylist()
    columns = list(zip(*_component_links(members))) or [()] * 2
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def _component_links(members: list[dict]) -> Iterator[tuple[int, int]]:
    """Links that connect the components of the members of one or two blocks: those of all near pairs, without circles."""
    roots: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := roots.get(c, c)) != c:
            roots[c] = c = roots.get(up, up)
        return c

    cross = len({m["own"] for m in members}) > 1
    members.sort(key=lambda m: m["own"])
    ids: dict[bytes, int] = {}
    where: list[list[int]] = []  # members that have a shingle
    sizes = np.zeros(len(members))
    for x, member in enumerate(members):
        own = [ids.setdefault(s, len(ids)) for s in shingles(member["text"].encode().split())]
        where.extend([] for _ in range(len(ids) - len(where)))
        met = [i for s in own for i in where[s]]
        sizes[x] = len(own)
        if met:
            both = np.bincount(met, minlength=x)
            near = np.flatnonzero(both >= SIMILARITY * (len(own) + sizes[:x] - both))
            for y in near.tolist():
                a, b = root(member["component"]), root(members[y]["component"])
                if a != b:
                    roots[max(a, b)] = min(a, b)
                    yield a, b
        if not cross or member["own"] == members[0]["own"]:
            for s in own:
                where[s].append(x)


def _texts(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """``para, text`` of the wanted paragraphs; a filter of fixed size keeps most others where they are."""
    size = 1 << FILTER_BITS
    bit = F.pmod("para", F.lit(size))
    # no wider than size / 64 rows, whatever the data
    rows = wanted.groupBy((bit / 64).cast("long").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(para, {size}) % 64 as int))")).alias("bits")
    )
    table = rows.toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            out: dict[int, bytes] = {}
            for text in batch.column("text"):
                for *_, own in units(text.as_py(), min_words):
                    para = paragraph_id(own)
                    at = para % size
                    if para not in seen and int(bits[at >> 6]) >> (at & 63) & 1:
                        seen.add(para)
                        out[para] = b" ".join(own).decode()
            columns = [pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["para", "text"])

    found = docs.select("text").mapInArrow(run, "para long, text string")
    return found.join(wanted, "para", "left_semi").groupBy("para").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``a, b`` with shingle sets that are similar, exactly."""
    left = texts.select(F.col("para").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("para").alias("b"), F.col("text").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            near = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                if x != last:
                    last, own = x, shingles(x.encode().split())
                other = shingles(y.encode().split())
                both = len(own & other)
                near.append(both >= SIMILARITY * (len(own) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")
