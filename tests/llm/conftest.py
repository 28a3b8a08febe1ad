import pytest

from iolens.llm.common import ship_package

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with columns whose names clash."""

    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        extra = ["n_words", "size", "shard", "fp", "band", "row", "key", "value", "score", "part", "items"]
        return df.selectExpr("*", *[f"'x' as {c}" for c in extra if c not in df.columns])

    return make
