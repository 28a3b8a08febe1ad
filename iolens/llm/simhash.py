"""Near-duplicate texts by SimHash and a byte-position inverted index with count filtering.

Two fingerprints of 64 bits that differ in at most two bits agree in at least six of their eight
bytes. The index therefore posts a fingerprint under each choice of six positional bytes (28
postings): a pair meets in a posting exactly when its tally of shared positional bytes reaches six,
so the count filter needs no row per pair and single byte. A posting holds at most 2^16 different
fingerprints, as two bytes are free; inside one, pairs are verified by their differing bits and
handed on as a spanning star of each linked set, so that a crowded posting gives no more rows than it
has fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from iolens.llm.common import stored
from iolens.llm.components import connected_components

BYTES = 8
SEED = 42


def simhash(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is set if over half of the shingles' XXH64 have it."""
    words = [] if text is None else text.encode().lower().split()  # ASCII letters and blanks only
    if not words:
        return 0
    if len(words) <= shingle:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digests = b"".join([xxhash.xxh64_digest(r, SEED) for r in runs])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
    ones = bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(bits)).tobytes(), "big", signed=True)


@F.pandas_udf(LongType())
def simhash_column(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def with_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` for each row: the smallest id reachable over near fingerprints.

    Null and empty texts, and texts of blanks only, have fingerprint 0 and link like any other. Rows
    with a null id take part but never name a component (it is null if no row has an id). Repeated
    rows keep one row each. Other columns are not read. An empty table gives no rows.
    """
    prints = stored(docs.select(F.col(id_col).alias("doc_id"), simhash_column(text_col).alias("fp")), "simhash")
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    links = stored(near_links(smallest.select("fp"), bits), "simhash-links")
    members = connected_components(links)
    rooted = smallest.join(members, smallest["fp"] == members["node"], "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root")
    )
    # stored, so that the join below can split a large component
    heads = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-heads")
    named = rooted.join(heads, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """``a, b``: links of a spanning star for each linked set of each posting of different ``fp``."""
    if not 0 < bits < BYTES:
        raise ValueError("bits must be 1 to 7")
    masks = _masks(bits)
    postings = prints.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("positions", "shared"),
    )
    crowded = (
        postings.groupBy("positions", "shared").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    )

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends: list[np.ndarray] = []
            for fps in batch.column("fps"):
                ends.append(star(np.asarray(fps.values, dtype=np.int64), bits))
            pairs = np.concatenate(ends) if ends else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return crowded.select("fps").mapInArrow(links, "a long, b long")


def _masks(bits: int) -> list[int]:
    """For each choice of positions that may differ, a signed mask of the bytes that must agree."""
    out = []
    for free in combinations(range(BYTES), bits):
        mask = sum(0xFF << (8 * p) for p in range(BYTES) if p not in free)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def star(fps: np.ndarray, bits: int) -> np.ndarray:
    """Pairs that join every fingerprint of a posting to the smallest of its linked set."""
    fps = np.unique(fps)
    left, right = _verified(fps.view(np.uint64), bits)
    label = np.arange(len(fps))
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return np.stack([fps[moved], fps[label[moved]]], axis=1)


def _verified(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs at ``bits`` or fewer differing bits; all fps agree outside a few bytes."""
    if len(fps) <= 128:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits
        return np.nonzero(np.triu(near, 1))
    # sorted as unsigned for the search; every near value is fps ^ (a choice of up to `bits` free bits)
    order = np.argsort(fps)
    ranked = fps[order]
    varying = int(np.bitwise_or.reduce(ranked ^ ranked[0]))
    free = [np.uint64(1 << p) for p in range(64) if varying >> p & 1]
    lefts, rights = [], []
    for k in range(1, bits + 1):
        for flips in combinations(free, k):
            other = ranked ^ np.bitwise_or.reduce(np.array(flips))
            at = np.minimum(np.searchsorted(ranked, other), len(ranked) - 1)
            hit = np.flatnonzero((ranked[at] == other) & (ranked < other))
            lefts.append(order[hit])
            rights.append(order[at[hit]])
    return np.concatenate(lefts), np.concatenate(rights)
