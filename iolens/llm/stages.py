"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all rows of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iolens.llm import decontamination, mixing, quality_rules, simhash, token_files
from iolens.llm.common import new_path, ship_package, stored, vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs, learned from their labelled rows.

    The measures are taken once and stored with the rows; nothing but labelled ids and counts is shuffled.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "lang")
    measured = stored(quality_rules.with_rules(rows).drop("text", "lang"), "quality")
    cuts = quality_rules.thresholds(measured, _table(spark, sf_dir, "labels"))
    return quality_rules.judged(measured, cuts).where("kept").select("row.*")


#: Bits of the fixed-size filter that tells most documents that stay from those that are looked up.
FILTER_BITS = 24


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows of the same id are one document, and rows without an id are one if their texts are equal;
    of those the smallest row stays. Documents with an id go before documents without.

    Only documents that may go, or come several times, are shuffled whole: a filter with no more
    rows than ``2 ** FILTER_BITS / 64``, whatever the data, is broadcast to let the others pass.
    """
    ship_package(spark)
    unnamed = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    keyed = docs.select(F.coalesce("doc_id", unnamed).alias("key"), F.struct(*docs.columns).alias("row"), "text")
    named = simhash.with_components(keyed, "key").groupBy(F.col("doc_id").alias("key"))
    counted = stored(named.agg(F.count("*").alias("n"), F.bool_or(F.expr("doc_id = component_id")).alias("head")), "heads")
    doubtful = counted.where("n > 1 or not head")
    place = F.pmod(F.xxhash64("key"), F.lit(1 << FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(key), {1 << FILTER_BITS}) % 64 as int))")
    words = doubtful.groupBy(F.floor(place / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    marked = keyed.select("key", "row", F.floor(place / 64).alias("word"), bit.alias("bit"))
    marked = marked.join(F.broadcast(words), "word", "left")
    looked_up = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    plain = marked.where(~looked_up).select("row")
    rest = marked.where(looked_up).select("key", "row").join(counted, "key").where("head")
    single = rest.where("n = 1").select("row")
    repeated = rest.where("n > 1").groupBy("key").agg(F.min("row").alias("row")).select("row")
    return plain.union(single).union(repeated).select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; the others go as a whole."""
    ship_package(spark)
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    keys = mixing.keys(F.col("doc_id"), F.col("source"), F.col("text"))
    plan = mixing.mix(stored(docs.select("source", *keys), "sized")).select("skey", "size", "each", "upto")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *keys).join(plan, ["skey", "size"])
    copies = mixing.copies_of(F.col("each"), F.col("upto"), F.col("h"))
    repeated = keyed.select("row", F.explode(F.array_repeat(F.lit(True), copies.cast("int"))).alias("copy"))
    return repeated.select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; a row per document of the files."""
    ship_package(spark)
    path = new_path(spark, "tokens")
    token_files.write_tokens(docs, path, vocabulary())
    return token_files.read_tokens(spark, path)
