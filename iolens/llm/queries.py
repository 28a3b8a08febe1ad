"""The registered queries: each operator over its whole table, with production settings."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iolens.llm import (
    decontamination,
    html_tree,
    merkle,
    mixing,
    packing,
    paragraph_dedup,
    periodic_runs,
    personal_data,
    quality_rules,
    simhash,
    site_lines,
    token_files,
    toxicity,
)
from iolens.llm.common import blank_words, documents, new_path, ship_package, stored, vocabulary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark, sf_dir):
    found = decontamination.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op2_html_tree(spark, sf_dir):
    found = html_tree.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op3_paragraph_dedup(spark, sf_dir):
    return paragraph_dedup.repeated_paragraphs(
        documents(spark, sf_dir), kept_lines=True, min_passage=paragraph_dedup.MIN_PASSAGE, run_words=paragraph_dedup.RUN
    )


@query
def op4_token_files(spark, sf_dir):
    path = new_path(spark, "tokens")
    token_files.write_tokens(documents(spark, sf_dir), path, vocabulary())
    return token_files.read_tokens(spark, path)


@query
def op5_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    labels = table(spark, sf_dir, "labels").where(fold != 2)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(fold == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.col("evidence.doc_id").alias("evidence"),
    )


@query
def op6_source_mixing(spark, sf_dir):
    key = mixing.keys(F.col("doc_id"), F.col("source"), F.col("text"))
    sized = stored(documents(spark, sf_dir).select("doc_id", "source", *key), "sized")
    copies = mixing.copies_of(F.col("each"), F.col("upto"), F.col("h"))
    return sized.join(mixing.mix(sized), ["skey", "size"]).select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken")
    )


@query
def op7_quality_rules(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    measured = stored(quality_rules.with_rules(docs).drop("text", "lang"), "quality")
    cuts = quality_rules.thresholds(measured, table(spark, sf_dir, "labels"))
    return quality_rules.judged(measured, cuts).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query
def op8_site_lines(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    listed = pages.select(
        "page_id", site_lines.host_of(F.col("url")).alias("host"), site_lines.html_lines(F.col("html")).alias("lines")
    )
    kept = site_lines.drop_site_lines(stored(listed, "site-lines"), "host", "lines")
    return kept.select(
        "page_id",
        "host",
        F.size("lines").cast("long").alias("n_kept"),
        "n_dropped",
        F.array_join("lines", "\n").alias("text"),
    )


@query
def op9_simhash(spark, sf_dir):
    named = simhash.with_components(documents(spark, sf_dir))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return named.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op10_packing(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    sized = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        packing.group_key(text).alias("group_key"),
    )
    placed = packing.shards(stored(sized, "sized"), bins=8)
    placed = placed.select("doc_id", "size", "text_crc32", "shard")
    return packing.slots(placed, ["doc_id", "text_crc32", "size"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op11_personal_data(spark, sf_dir):
    field = personal_data.fit_table(personal_data.labelled_table(spark))
    found = personal_data.find(documents(spark, sf_dir), field)
    part = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = {c: F.array_join(F.transform(c, part), ",") for c in ("base", "spans")}

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined["base"], 256).alias("base_sha256"), joined["spans"].alias("spans"))


MANIFEST_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _proof_digests(leaf: dict, path: list[str], above: dict) -> tuple:
    up = merkle.folded(leaf["f1"], leaf["place"], path)
    up = merkle.folded(up, above["place"], above["path"])
    return leaf["f0"], leaf["hash"], above["subroot"], above["root"], merkle.node(*path, *above["path"]), up, up == above["root"]


@query
def op12_merkle_manifest(spark, sf_dir):
    docs = documents(spark, sf_dir)
    fields = {c: F.col(c) for c in MANIFEST_FIELDS}
    one_more = fields | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    leaf = merkle.row_hash(fields.values())
    leaves = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(touched, merkle.row_hash(one_more.values())).alias("touched"))
    leaves = leaves.withColumn("touched", F.coalesce("touched", "leaf"))
    return merkle.manifest(
        leaves, "lang", ["doc_id"], "leaf", ("doc_id", "touched"), _proof_digests,
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )


@query
def op13_periodic_runs(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    words, n = F.col("words"), F.size("words").cast("long")
    g = F.floor(F.col("h") / 10)
    docs = docs.withColumn("h", h).withColumn("words", F.when(h % 10 == 0, blank_words(F.col("text"))))
    a, p = F.col("a"), 1 + F.floor((n - F.col("a")) / (3 + g % 8))
    docs = docs.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.when(n > 0, p))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % F.col("p")).cast("int")
    repeated = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i)))
    text = F.when((F.col("h") % 10 == 0) & (n > 0), F.array_join(repeated, " ")).otherwise(F.col("text"))
    found = periodic_runs.periodic_runs(docs.select("doc_id", text.alias("text")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(order)
    length = -best["less"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        length.alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * length / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
