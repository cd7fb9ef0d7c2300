import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, row long, key string, mark int, score string, source string"
#: Names that operators use themselves; every odd table has them all.
CLASHES = ["phase", "slot", "offset", "_key", "_hit", "_mark", "_word", "_source", "_order", "_gone", "_cuts", "_id", "whole", "id", "bucket", "n", "size", "sub", "cell", "range", "weight", "held", "fate_key", "stays", "times"]
LONG = "wort " * 3000 + "ende " + "x" * 500


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated ids and rows, and columns with names that operators use themselves."""
    rows = [
        (5, "Hello, world. It's a small test of words and more words here.", 1, "k", 1, "s", "a"),
        (1, None, 2, None, None, None, None),
        (2, "", 3, "k", 2, "s", "a"),
        (3, " \n\t ", 4, "k", 3, "s", "b"),
        (4, LONG, 5, "k", 4, "s", "b"),
        (6, LONG, 5, "k", 4, "s", "b"),
        (7, "Hello, world. It's a small test of words and more words here.", 1, "k", 1, "s", "a"),
        (7, "Hello, world. It's a small test of words and more words here.", 1, "k", 1, "s", "a"),
        (8, "é 中文 İstanbul ΣΑΣ <|endoftext|> \U0001f600\r\nline  two ", 1, "k", 1, "s", "c"),
        (None, "no id", 1, "k", 1, "s", "c"),
        (9, "one two", 1, "k", 1, "s", None),
    ]
    return clashing(spark.createDataFrame(rows, DOCS))


@pytest.fixture(scope="session")
def no_docs(spark):
    return clashing(spark.createDataFrame([], DOCS))


def clashing(docs):
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
