"""Texts as token ids in binary files, with Elias-Fano coded document boundaries.

One file holds a run of documents in ascending id order: a header, the document ids and the
boundaries as Elias-Fano sequences, then all ids as one array. Ids take two bytes if the vocabulary
allows, else four. Spark's writer puts each file on the shared store as one record, so that a lost
task leaves nothing behind; any of its stores will do. The line end it adds after the record is not
part of the format.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from iolens.llm import elias_fano
from iolens.llm.common import stored

MAGIC = b"IOLTOK01"
#: Magic; bytes of an id; documents, of them without an id; ids; task and place that order the files;
#: smallest document id; lengths of the two sequences; checksum of all that follows.
HEADER = struct.Struct("<8sBQQQQQqQQI")
END = 1
#: A file is closed once it has this many ids.
FILE_IDS = 4_000_000
#: Parsed pieces of text an encoder remembers before it starts anew.
REMEMBERED = 250_000

#: Characters on which the fast way is proven to agree with the library (see the tests).
_PLAIN = re.compile("[\t\n\r -~¡-¬®-ÿ]*")
_PIECES = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t\n\r 0-9a-zªµºß-öø-ÿ²³¹¼-¾]+"
)


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, without adding special tokens.

    For the lower-casing word vocabulary, whose pieces do not depend on their neighbours, pieces of
    Latin-1 texts are encoded by the library's model once and remembered. All other texts and
    vocabularies go through the library whole.
    """

    def __init__(self, path: str, end: int = END) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.named = re.compile("|".join(re.escape(t.content) for t in added) or "(?!)")  # the library finds their names in a text
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.end = array(self.code, [end]).tobytes()
        self.piecewise = _is_word_vocabulary(path)
        self.runs: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.bytes_as_text = {b: c for b, c in enumerate(_byte_letters())}

    def encode(self, text: str | None) -> bytes:
        """Little-endian ids of the text and the end id."""
        if not text:
            return self.end
        if self.piecewise and _PLAIN.fullmatch(text) and not self.named.search(text):
            return self._by_pieces(text) + self.end
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() + self.end

    def _by_pieces(self, text: str) -> bytes:
        if len(self.runs) > REMEMBERED:
            self.runs.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        runs, found = text.lower().split(), self.runs
        try:
            return b"".join([found[r] for r in runs])
        except KeyError:
            for r in runs:
                if r not in found:
                    found[r] = b"".join([self.pieces.get(p) or self._piece(p) for p in _PIECES.findall(r)])
            return b"".join([found[r] for r in runs])

    def _piece(self, piece: str) -> bytes:
        letters = piece.encode().decode("latin-1").translate(self.bytes_as_text)
        ids = array(self.code, [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
        self.pieces[piece] = ids
        return ids


def _is_word_vocabulary(path: str) -> bool:
    import json

    with open(path) as f:
        parts = json.load(f)
    steps = [s.get("type") for s in (parts.get("normalizer") or {}).get("normalizers", [])]
    splits = [s for s in (parts.get("pre_tokenizer") or {}).get("pretokenizers", []) if s.get("type") == "Split"]
    words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and [s["pattern"] for s in splits] == [{"Regex": words}]
        and parts["model"].get("end_of_word_suffix") == "</w>"
        and not any(t.get("normalized") or not t.get("special") for t in parts["added_tokens"])
    )


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if visible, else one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


_encoders: dict[tuple, Encoder] = {}


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS
) -> None:
    """Write the ids of all texts, each with the end id, to files below ``path``.

    Null and empty texts have the end id alone. Rows with a null id come first; rows of the same id
    keep one entry each, in text order. An empty table gives no files with documents. ``vocabulary``
    is a tokenizers file that all executors can read.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = chosen.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get((vocabulary,)) or _encoders.setdefault((vocabulary,), Encoder(vocabulary))
        width, task, place = array(encoder.code).itemsize, TaskContext.get().partitionId(), 0
        names, ids, total = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                names.append(name)
                ids.append(encoder.encode(text.as_py()))
                total += len(ids[-1]) // width
                if total >= file_ids:
                    yield _record(_file(names, ids, width, task, place))
                    names, ids, total, place = [], [], 0, place + 1
        if names:
            yield _record(_file(names, ids, width, task, place))

    files = ordered.mapInArrow(encode, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option(
        "lineSep", "\n"
    ).text(path)


def _record(file: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file], pa.binary())], ["file"])


def _file(names: list, ids: list[bytes], width: int, task: int, place: int) -> bytes:
    known = np.array([n for n in names if n is not None], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    lengths = np.array([len(i) // width for i in ids], dtype=np.int64)
    doc_ids = elias_fano.encode(known - least)
    bounds = elias_fano.encode(np.concatenate([[0], np.cumsum(lengths)]))
    body = doc_ids + bounds + b"".join(ids)
    head = (MAGIC, width, len(names), len(names) - len(known), int(lengths.sum()), task, place, least)
    return HEADER.pack(*head, len(doc_ids), len(bounds), zlib.crc32(body)) + body


class TokenFile:
    """A file read back: any document's ids by its place."""

    def __init__(self, data: bytes) -> None:
        magic, self.width, self.n, self.unnamed, self.ids, self.task, self.place, self.least, a, b, check = (
            HEADER.unpack_from(data)
        )
        size = a + b + self.ids * self.width
        body = memoryview(data)[HEADER.size : HEADER.size + size]
        if magic != MAGIC or len(body) != size or zlib.crc32(body) != check:
            raise ValueError("not a whole token file")
        self.names = elias_fano.EliasFano(body[:a])
        self.bounds = elias_fano.EliasFano(body[a : a + b])
        self.tokens = np.frombuffer(body[a + b :], f"<u{self.width}")

    def doc_id(self, i: int) -> int | None:
        return None if i < self.unnamed else self.names.select(i - self.unnamed) + self.least

    def document(self, i: int) -> np.ndarray:
        return self.tokens[self.bounds.select(i) : self.bounds.select(i + 1)]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document from the files below ``path``.

    ``start`` counts the ids of all documents before it, across files.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                if not data.startswith(MAGIC):
                    continue  # what Spark writes for an empty task
                file = TokenFile(data)
                bounds = file.bounds.all()
                names = [None] * file.unnamed + (file.names.all() + file.least).tolist()
                wide = file.tokens.astype("<u4")
                sums = [zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                same = [np.full(file.n, x, np.int64) for x in (file.task, file.place)]
                columns = [names, *same, bounds[:-1], np.diff(bounds), sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], fields)

    fields = ["doc_id", "task", "place", "inside", "n_tokens", "ids_crc32"]
    files = spark.read.format("binaryFile").load(path).select("content")
    docs = stored(files.mapInArrow(parse, ", ".join(f"{f} long" for f in fields)), "token-docs")
    sizes = docs.groupBy("task", "place").agg(F.sum("n_tokens").alias("n"))  # a row per file
    before = F.sum("n").over(Window.orderBy("task", "place")) - F.col("n")
    offsets = sizes.select("task", "place", before.alias("before"))
    return docs.join(offsets, ["task", "place"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
