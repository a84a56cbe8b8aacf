import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("score", T.StringType()), ("kept", T.StringType()))])


@pytest.fixture(scope="session")
def rows():
    """The smallest documents, with nulls, empty and very long texts, ties and repeated rows."""
    import duckdb

    own = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    long = " ".join(f"w{i * 7919 % 40009}" for i in range(60_000))
    copy = own[3][1]
    words = copy.split()
    near = " ".join(words[:40] + ["other"] + words[40:])
    odd = [(None, copy), (5000, None), (5001, ""), (5002, " \n\t "), (5003, "one two three"), (5004, "One TWO three"), (5005, long), (5006, copy), (5006, copy), (5007, copy), (5008, near), (5009, near + " end"), (5010, "a\x00b é 日本 <|endoftext|> ﬁ x"), (5010, "another text under the same id " * 12), (5011, "short " * 9), (5012, "ab" * 60), (5013, "zz" + "ab" * 60)]
    return [(*r, "s", "k") for r in own] + [(d, t, None, None, None, None, None) for d, t in odd]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
