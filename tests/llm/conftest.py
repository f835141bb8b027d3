import pytest
from pyspark.sql import types as T

TRICKY = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (2, None),
    (3, ""),
    (4, "   \n\t \n"),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (6, "ü é ñ 日本語 😀 \x85 \xa0 x " * 30),
    (7, "w" * 70_000),
    (8, "same same same same same same same same same same same same " * 40),
    (9, "one two three\none two three\none two three four"),
]


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty, very long, tied and repeated rows, with extra columns of clashing names."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("row", T.StringType()), T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n", T.LongType())])
    rows = [(i, t, "en" if k % 3 else None, f"r{k}", None, 0.5, k) for k, (i, t) in enumerate(TRICKY)]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(tricky):
    return tricky.filter("false")
