import os

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture
def docs(spark):
    """Makes documents from texts, with columns whose names the operators use themselves."""

    def make(texts, ids=None, partitions=3):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)]
        df = spark.createDataFrame(rows, DOCS).repartition(partitions) if rows else spark.createDataFrame([], DOCS)
        clash = ("id", "rid", "row", "node", "words", "key", "n", "count", "score", "fp", "line", "label", "rank", "salt", "start", "removed", "n_lines")
        return df.select("*", *[F.lit(1).alias(c) for c in clash])

    return make
