import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names used inside."""
    long = " ".join(f"word{i % 977}" for i in range(20_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en"),
        (2, "The Quick Brown Fox jumps over the lazy dog", "en"),
        (2, "The Quick Brown Fox jumps over the lazy dog", "en"),
        (3, None, None),
        (4, "", "en"),
        (5, long, "en"),
        (6, long, None),
        (7, "two words", "en"),
        (8, " \n\t ", "en"),
        (9, "é́ 😀 <|endoftext|> ​ mail a.b@c.de +1 (555) 555-1234", "xx"),
        (None, "no identifier at all in this row of the table", "en"),
    ]
    rows = [(i, t, g, "s", None if t is None else len(t), 1.0, "x", 3, "y") for i, t, g in rows]
    return spark.createDataFrame(rows, DOCS + ", score double, part string, key long, digest string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
