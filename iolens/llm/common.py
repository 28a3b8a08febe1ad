"""Helpers the operators share: the shared folder, stored intermediate tables, word classes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words: space and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

#: For applications on one machine without a shared folder, one of our own.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares; one of our own only where none is set and one machine runs all."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        shared = _own_dirs.get(app) or _own_dirs.setdefault(app, tempfile.mkdtemp(prefix="iolens-"))
    return f"{shared}/iolens-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows from 0 in the given order, without bringing them into one task."""
    dealt = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    parts = stored(dealt, "ordered")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))  # a row per task
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")
    offsets = sizes.select("__part", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    joined = parts.join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, (F.col("__before") + place).cast("long")).drop("__part", "__before")


def blank_words(text: Column) -> Column:
    """Words between white space of a text; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, as ``--py-files`` would; once per application."""
    context = spark.sparkContext
    if getattr(context, "_iolens_shipped", False):
        return
    root, folder = Path(__file__).resolve().parents[2], Path(tempfile.mkdtemp(prefix="iolens-package-")).resolve()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark serves the file until the driver ends
    shutil.copytree(root / "iolens", folder / "src/iolens", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(folder / "iolens-package"), "zip", folder / "src"))
    context._iolens_shipped = True


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file is; all machines have the same."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
