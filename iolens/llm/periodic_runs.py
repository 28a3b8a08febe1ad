"""Runs of words that repeat with a period, by recursive frequency splitting and a lag scan.

A run of period ``q`` is a stretch of at least ``max(LEAST, REPEATS * q)`` words in which words ``q`` apart are
equal, ``q`` is the smallest such number, and no neighbouring word can be added. Every word of a run occurs in it
``REPEATS`` times or more. So a word that is rarer than that within the segment at hand is in no run of it: it splits
the segment, which makes other words rare in the pieces; this goes on until nothing splits. Then each
surviving segment is scanned lag by lag. A run of lag ``q`` holds ``REPEATS`` consecutive multiples of ``q``, so only
those places are compared at first, about ``n log n`` comparisons for all lags, and equal ones are extended word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 6
REPEATS = 4

Run = tuple[int, int, int]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """``(start, end)`` of the stretches that no word rare in them splits."""
    at = np.flatnonzero(np.bincount(ids)[ids] >= REPEATS) if len(ids) else np.empty(0, np.int64)
    while True:
        new = np.ones(len(at), bool)
        new[1:] = np.diff(at) > 1
        part = np.cumsum(new) - 1
        kept = np.bincount(part, minlength=1)[part] >= LEAST if len(at) else new
        at, part = at[kept], part[kept]
        if not len(at):
            return []
        # words of a segment, however the segments and words are numbered
        _, word, count = np.unique(part * (ids.max() + 1) + ids[at], return_inverse=True, return_counts=True)
        often = count[word] >= REPEATS
        if often.all():
            break
        at = at[often]
    starts = at[np.flatnonzero(np.diff(at, prepend=-2) > 1)]
    ends = at[np.flatnonzero(np.diff(at, append=at[-1] + 2) > 1)] + 1
    return list(zip(starts.tolist(), ends.tolist()))


def _ahead(x: np.ndarray, at: int, q: int) -> int:
    """The first place from ``at`` on that differs from the one ``q`` later, or has none."""
    step, end = 32, len(x) - q
    while at < end:
        size = min(step, end - at)
        unlike = x[at : at + size] != x[at + q : at + q + size]
        first = int(unlike.argmax())
        if unlike[first]:
            return at + first
        at, step = at + size, step * 2
    return end


def _back(x: np.ndarray, at: int, q: int) -> int:
    """The first place of the stretch before ``at`` that equals the words ``q`` later."""
    step = 32
    while at > 0:
        size = min(step, at)
        unlike = x[at - size : at] != x[at - size + q : at + q]
        if unlike.any():
            return at - int(unlike[::-1].argmax())
        at, step = at - size, step * 2
    return 0


def lag_scan(x: np.ndarray) -> list[Run]:
    """``(start, length, period)`` of all runs of a segment."""
    found: dict[tuple[int, int], int] = {}
    end, period = np.zeros(len(x), np.int64), np.ones(len(x), np.int64)  # of the longest run known at each place
    for q in range(1, len(x) // REPEATS + 1):
        spots = x[::q]
        same = spots[1:] == spots[:-1]
        last = len(same) - REPEATS + 2
        whole = same[:last].copy()
        for k in range(1, REPEATS - 1):
            whole &= same[k : last + k]
        at = np.flatnonzero(whole) * q
        for k in (1, q - 1, q // 2, q + q // 3):  # a look at what is between the places
            at = at[x[at + k] == x[at + k + q]]
        # a stretch of known period p that divides q and holds all these places is the known run itself
        at = at[(end[at] <= at + (REPEATS - 1) * q) | (q % period[at] != 0)]
        done = 0
        for a in at.tolist():
            if a < done:
                continue
            stop = _ahead(x, a, q)
            if stop <= a + (REPEATS - 2) * q:
                continue
            start, done = _back(x, a, q), stop
            # smaller periods come first, and a run of one has the same ends
            if stop + q - start >= max(LEAST, REPEATS * q) and (start, stop + q) not in found:
                found[start, stop + q] = q
                longer = end[start : stop + q] < stop + q
                end[start : stop + q][longer] = stop + q
                period[start : stop + q][longer] = q
    return [(s, e - s, q) for (s, e), q in found.items()]


def runs_of(words: list[bytes]) -> list[Run]:
    """``(start, length, period)`` of all runs by start, then period."""
    ids = word_ids(words)
    return sorted((a + s, n, q) for a, b in segments(ids) for s, n, q in lag_scan(ids[a:b]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that some run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    keep = np.cumsum(edges[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


_RUN = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of each row; a row is worked on where it is, without a shuffle.

    Words are what ASCII white space separates, numbered from 0. ``runs`` are in order of start, then period;
    ``collapsed`` has the words that no run repeats, with one space between them. Null, empty and blank texts have
    no words, no runs and an empty text. Repeated rows have a result each, a null id stays null. Other columns are not
    read. An empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, texts = [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().split()
                runs = runs_of(words)
                counts.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                texts.append(b" ".join(collapsed(words, runs)).decode())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(work, _SCHEMA)
