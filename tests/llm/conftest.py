import pytest

LONG = "lorem ipsum Dolor 'sit\n" * 9000
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, block int, copies int, findings string, key string, range int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names clash."""
    texts = [(1, "One two three.\n\nFour five six."), (2, None), (3, ""), (4, LONG), (5, "One two three.\n\nFour five six."), (6, "  \t\n"), (7, "été ça — 日本語 🙂"), (7, "été ça — 日本語 🙂"), (None, "a row without a key"), (9, "x" * 3000), (10, " " * 30000 + "b"), (11, "12 !! ??")]
    rows = [(i, t, None if i in (2, 5) else "en", None if i in (3, 5) else "s", None, 0.5, "i", 1, 1, "f", "k", 0) for i, t in texts]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
