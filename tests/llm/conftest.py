import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table from (doc_id, text) or longer rows."""

    def build(rows):
        return spark.createDataFrame([(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) if len(r) < 5 else r for r in rows], DOCS).repartition(3)

    return build


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls in each column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"word{i % 977} of" for i in range(30_000))
    return docs([(1, None), (2, ""), (None, "no id here at all"), (3, long), (4, long), (5, "one"), (5, "one"), (6, " \t\n "), (7, "Ünïcode ßtraße 漢字 \U0001f600\nzweite Zeile"), (None, None)])
