"""Each stage against brute force on its own input, and the whole run."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_decontamination import brute as benchmark_hits
from test_mixing import brute_targets
from test_simhash import reference_components, reference_print
from tokenizers import Tokenizer

import corpus_pipeline
from iolens.llm import stages
from iolens.llm.common import new_path, vocabulary
from iolens.llm.oracles import quality_sql

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf):
    """Input and output of every stage of one whole run."""
    paths, real = [], corpus_pipeline.new_path
    corpus_pipeline.new_path = lambda session, name: paths.append(real(session, name)) or paths[-1]
    try:
        last = corpus_pipeline.run(spark, sf)
    finally:
        corpus_pipeline.new_path = real
    tables = [spark.read.parquet(f"{sf}/documents.parquet"), *[spark.read.parquet(p) for p in paths]]
    assert last.inputFiles() == tables[-1].inputFiles()
    return list(zip(tables, tables[1:]))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages_are_the_named_ones(steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_files"]
    assert all(result.columns == COLUMNS for _, result in steps[:-1])


def test_quality_rules(spark, sf, steps):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(f"with {quality_sql()} select doc_id from q_judged where kept").fetchall()
    before, after = steps[0]
    kept = {i for (i,) in want}
    assert Counter(rows(after)) == Counter(r for r in rows(before) if r[0] in kept)
    assert 0 < len(kept) < before.count()


def test_simhash(steps):
    before, after = (rows(df) for df in steps[1])
    heads = reference_components({r[0]: reference_print(r[1]) for r in before})
    assert Counter(after) == Counter(r for r in before if heads[r[0]] == r[0])
    assert len(after) < len(before)


def test_decontamination(spark, sf, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = (rows(df) for df in steps[2])
    assert Counter(after) == Counter(r for r in before if not benchmark_hits(r[1], items)[1])
    assert len(after) < len(before)


def test_mixing(steps):
    before, after = (rows(df) for df in steps[3])
    size = {r: len((r[1] or "").split()) for r in before}
    by_source, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        by_source[r[3]] += size[r]
        largest[r[3]] = max(largest[r[3]], size[r])
    copies = Counter(after)
    assert copies.keys() <= set(before) and max(copies.values()) <= 3
    for r, n in copies.items():
        taken[r[3]] += n * size[r]
    for source, target in brute_targets(by_source).items():
        assert abs(taken[source] - target) <= max(1, largest[source] / 2)


def test_token_files(steps):
    before, after = steps[4]
    tokenizer = Tokenizer.from_file(vocabulary())
    want, start = [], 0
    for doc_id, text in sorted((r[0], r[1]) for r in rows(before)):
        n = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
        want.append((doc_id, start, n))
        start += n
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in after.collect()) == want


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and a benchmark beside documents of our own."""
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "a passage of the test"), (None, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def odd(spark, n):
    long = " ".join(f"w{i}" for i in range(40))
    texts = [
        (1, long), (2, long), (None, long), (3, None), (4, ""), (5, "other " + " ".join(f"q{i * 7}" for i in range(30))),
        (5, "other " + " ".join(f"q{i * 7}" for i in range(30))), (None, "nameless " + " ".join(f"z{i * i}" for i in range(30))),
        (None, "nameless " + " ".join(f"z{i * i}" for i in range(30))), (6, "A passage, of THE test " + " ".join(f"y{i}" for i in range(30))),
        (7, " ".join(f"x{i % 700}y{i}" for i in range(20_000))),
    ]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts[:n]], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumn("n_words", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("key", F.lit(2)).withColumn("size", F.lit("s"))


def test_odd_rows_pass_through(spark, folder):
    docs = odd(spark, 11)
    kept = stages.quality_rules_stage(spark, docs, folder)
    assert kept.columns == docs.columns and kept.count() == 9
    single = stages.simhash_stage(spark, kept, folder)
    assert single.columns == docs.columns
    names = sorted((r.doc_id or 0, (r.text or "")[:6]) for r in single.collect())
    assert names == [(0, "namele"), (1, "w0 w1 "), (5, "other "), (6, "A pass"), (7, "x0y0 x")]
    clean = stages.decontamination_stage(spark, single, folder)
    assert clean.columns == docs.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [0, 1, 5, 7]
    mixed = stages.mixing_stage(spark, clean, folder)
    assert mixed.columns == docs.columns and mixed.count() == 4  # one source: everything once
    assert stages.token_stage(spark, mixed, folder).count() == 4


def test_one_row_per_document(spark, folder, monkeypatch):
    """An id with unlike texts, of which one is a copy of an earlier document, and a filter that is full."""
    words = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(1, words("a")), (2, words("b")), (2, words("a")), (3, words("c")), (3, words("d")), (4, words("b"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, words("a")), (2, words("a")), (3, words("c"))]
    assert sorted(map(tuple, stages.simhash_stage(spark, docs, folder).collect())) == want
    monkeypatch.setattr(stages, "FILTER_BITS", 6)
    assert sorted(map(tuple, stages.simhash_stage(spark, docs, folder).collect())) == want


def test_empty_documents(spark, folder):
    docs = odd(spark, 11).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect() == []
