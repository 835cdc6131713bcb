import pytest
from pyspark.sql import types as T
from text_cases import CLASHING, EDGE


@pytest.fixture(scope="session")
def make(spark):
    """Documents from ``(id, text)`` rows, with clashing extra columns."""
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
        + [T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in CLASHING]
    )

    def documents(rows, lang="en"):
        return spark.createDataFrame(
            [(i, t, lang, "s", None if t is None else len(t), *(["x"] * len(CLASHING))) for i, t in rows], schema
        )

    return documents


@pytest.fixture(scope="session")
def edge(make):
    return make(EDGE)
