"""A corpus from raw documents to token files: five stages, each working on all the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from iolens.llm import stages
from iolens.llm.common import documents, new_path, ship_package
from iolens.llm.oracles import PIPELINE_SQL

STAGES = [
    ("quality_rules", stages.quality_rules_stage),
    ("simhash_near_dedup", stages.simhash_stage),
    ("benchmark_decontamination", stages.decontamination_stage),
    ("source_mixing", stages.mixing_stage),
    ("token_files", stages.token_stage),
]
#: The mixing solves for its rates by iteration and the last stage tokenizes; SQL cannot say either.
ORACLE_SQL = PIPELINE_SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written to the shared folder and read again."""
    ship_package(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
