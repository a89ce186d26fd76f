import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like an operator's own."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (None, "a text without an id and with enough words to count", "en", "a", 3), (1, None, None, None, None), (2, "", "en", "a", 0),
        (3, long, "en", "b", len(long)), (4, "12 34 !!", "en", None, 8), (5, "same text of several words here now", "de", "a", 1),
        (6, "same text of several words here now", "de", "a", 1), (7, "repeated row", "fr", "b", 1), (7, "repeated row", "fr", "b", 1),
        (8, " \t\n ", "en", "a", 4), (9, "Ünïcödé ÀÉÎ \U0001f600 text", "fr", "b", 9), (10, "x" * 3000, "de", "b", 3000),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = ["score", "size", "target", "taken", "bucket", "spans", "kept", "mix_size", "fp", "anchor", "predicted", "root"]
    return df.withColumns({c: F.lit(f"own {c}") for c in clash})


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("1 = 0")
