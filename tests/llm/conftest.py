import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for columns of their own
        *[T.StructField(n, T.StringType()) for n in ("row", "kept", "doc", "k0", "copies", "key", "fp", "size", "run", "n")],
    ]
)
LONG = "long words of one text. Another line, more words\n" * 4_000

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog again and again.", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \n\t ", "en", "a"),
    (6, LONG, "en", "a"),
    (7, LONG, "en", None),
    (8, "ties", "en", "a"),
    (8, "ties", "en", "a"),
    (8, "other text of the same id", "en", "b"),
    (None, "no id", "en", "b"),
    (None, "no id", "en", "b"),
    (9, "é naïve 日本語 😀 text", "xx", "c"),
    (10, "x", "en", "c"),
    (-5, "a negative id", "en", "c"),
    (11, "null\u0000byte and <|endoftext|> marks", "en", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [(*r, len(r[1] or ""), *["x"] * 10) for r in ROWS]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
