import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, h1 long"

#: Nulls, empty and blank texts, ties, repeated rows and ids, odd characters, and columns with clashing names.
ODD = [
    (1, None, None, None, None, "r", "i", 1),
    (2, "", "en", "a", 0, None, None, None),
    (3, "   \n\t ", "en", "a", 1, None, None, None),
    (4, "one two three four five six", "en", "a", 27, None, None, None),
    (5, "One TWO three four five six", "en", "b", 27, None, None, None),
    (5, "One TWO three four five six", "en", "b", 27, None, None, None),
    (6, "one two", "fr", None, 7, None, None, None),
    (7, "ONE two", "fr", "b", 7, None, None, None),
    (None, "a text without an id, quite long indeed\nshared line number one is here", "en", "b", 3, None, None, None),
    (None, None, None, None, None, None, None, None),
    (8, "shared line number one is here\nÄußerst \x00 ungewöhnlich \x1c x\u00a0y 日本語 🙂 ½ ²", "de", "é", 5, None, None, None),
    (9, "  SHARED line number one is here \n<|endoftext|> it's x  y \n z", "en", "é", 5, None, None, None),
    (10, "12345 67890 !!! ...", "en", "b", 5, None, None, None),
    (11, "word " * 30000, "en", "b", 5, None, None, None),
    (12, "x" * 50000, None, "b", 5, None, None, None),
    (2**60 + 1, "RIFF BM P5\n GIF89a %PNG\n\n\n", "es", "a", 5, None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows(df, *by):
    """Collected rows as tuples, sorted by repr."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
