import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators' results also use
    T.StructField("score", T.StringType()), T.StructField("block", T.StringType()), T.StructField("start", T.StringType()),
    T.StructField("fp", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("_kept", T.StringType()),
])
LONG = "idiot word token = \"9c8b45435718dcc700c184a7e303cdc64c6a8f7f\" under the MIT license. " * 3000
ODD_TEXTS = [
    (1, None), (2, ""), (3, "   \n\t "), (None, "text without an id"), (None, None), (4, LONG), (5, "same text here now"),
    (6, "same text here now"), (6, "same text here now"), (7, "é ß ñ 漢字 😀 \u0000 \x0b <|endoftext|> it's I'LL x̸. İ."), (-9, "one"),
]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None, None, None, None, None, None, None) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD_TEXTS).repartition(3)


@pytest.fixture(scope="session")
def none(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def given(spark):
    """(doc_id, text) of the smallest documents table."""
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
