import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from iolens.llm import elias_fano
from iolens.llm.common import new_path, vocabulary
from iolens.llm.token_files import END, HEADER, Encoder, TokenFile, _file, read_tokens, write_tokens


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(vocabulary())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [END]


def ids(data):
    return np.frombuffer(data, "<u2").tolist()


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(0, 1 << 40), max_size=700).map(sorted))
def test_elias_fano_round_trip(values):
    coded = elias_fano.EliasFano(elias_fano.encode(np.array(values, np.int64)))
    assert coded.all().tolist() == values
    assert [coded.select(i) for i in range(0, len(values), 7)] == values[::7]
    with pytest.raises(IndexError):
        coded.select(len(values))


def test_elias_fano_is_small():
    bounds = np.arange(0, 430 * 10_000, 430)
    assert len(elias_fano.encode(bounds)) * 8 / len(bounds) < 2 + np.log2(430) + 0.5


def test_every_plain_character_agrees_with_the_library(library):
    encoder = Encoder(vocabulary())
    assert encoder.piecewise
    for code in range(0x100):
        for text in (f"{chr(code)}", f"ab{chr(code)}cd 1{chr(code)}2 .{chr(code)}!", f"{chr(code)}'s {chr(code) * 3}x"):
            assert ids(encoder.encode(text)) == library(text), (hex(code), text)


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=st.characters(max_codepoint=0x17F, exclude_categories=["Cs"]), max_size=60) | st.text(max_size=40))
def test_texts_agree_with_the_library(text):
    encoder = _encoder()
    assert ids(encoder.encode(text)) == encoder.tokenizer.encode(text, add_special_tokens=False).ids + [END]


_kept = []


def _encoder():
    if not _kept:
        _kept.append(Encoder(vocabulary()))
    return _kept[0]


def test_special_names_in_a_text(library):
    text = "a <|endoftext|> b <|startoftext|>"
    assert ids(_encoder().encode(text)) == library(text)
    assert library("a <|endoftext|> b")[:-1] == [320, 49407, 321]


def check(rows, got, library):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for name, text in order:
        own = library(text)
        want.append((name, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("file_ids", [40, 4_000_000])
def test_round_trip(frame, spark, library, file_ids):
    rows = [(i * 7 - 50, f"Word{i} and, some MORE téxt {i}!" * (i % 5)) for i in range(60)]
    rows += [(None, "no id"), (None, None), (3, None), (3, "again"), (3, "again"), (1 << 60, "日本語 text\u0000 x"), (12345, "long " * 20000)]
    path = new_path(spark, "tokens")
    write_tokens(frame(rows), path, vocabulary(), file_ids=file_ids)
    check(rows, read_tokens(spark, path).collect(), library)


def test_documents_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    path = new_path(spark, "tokens")
    write_tokens(docs, path, vocabulary())
    check([tuple(r) for r in docs.collect()], read_tokens(spark, path).collect(), library)
    assert any(open(f"{path}/{f}", "rb").read(8) == b"IOLTOK01" for f in os.listdir(path) if f.endswith(".txt"))


def test_empty(frame, spark):
    path = new_path(spark, "tokens")
    write_tokens(frame([]), path, vocabulary())
    assert read_tokens(spark, path).collect() == []


def test_other_vocabulary(frame, spark):
    name = vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(name)
    encoder = Encoder(name)
    assert not encoder.piecewise
    assert ids(encoder.encode("Some text, é")) == tokenizer.encode("Some text, é", add_special_tokens=False).ids + [END]


def test_file_is_checked():
    whole = _file([5, 9], [b"\1\0\2\0", b"\3\0"], 2, 0, 0)
    file = TokenFile(whole + b"\n")
    assert [file.doc_id(i) for i in range(2)] == [5, 9]
    assert file.document(0).tolist() == [1, 2] and file.document(1).tolist() == [3]
    for broken in (whole[:-1], whole[: HEADER.size] + b"x" + whole[HEADER.size + 1 :], b"WRONG" + whole[5:]):
        with pytest.raises(ValueError):
            TokenFile(broken)
