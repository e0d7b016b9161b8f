import pytest

TEXTS = [
    "The quick brown fox jumps over the lazy dog and runs away from here.",
    "THE QUICK brown fox jumps over the lazy dog and runs away from here.",
    "the quick brown fox jumps over the lazy dog and runs away from there.",
    "",
    None,
    "   \t\n ",
    "one two",
    "one two",
    "1234 5678 !!! ???",
    "Grüße aus München, ñandú y corazón. " * 30,
    "word " * 3000,
    "a\x0bb\x0cc\rd",
    "<|endoftext|> is a special string <|endoftext|>",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents: nulls in all columns, blanks, ties, repeated rows, a long text, columns with clashing names."""
    rows = [(k, t, "en" if k % 3 else None, "src", len(t or ""), k, "x") for k, t in enumerate(TEXTS)]
    rows += [(2, TEXTS[2], "en", None, None, 0, None), (None, "no id at all here, none", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long, bands string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
