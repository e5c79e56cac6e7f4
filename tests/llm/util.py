"""Small documents tables with every awkward row."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, label int, length string, key string"


def documents(spark, rows, lang="en"):
    """rows: (doc_id, text). Columns with clashing names ride along."""
    full = [(i, t, lang, "s", None if t is None else len(t), "x", 1, "y", "z") for i, t in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "one two"),
    (6, "the quick brown fox jumps over the lazy dog and runs away again"),
    (7, "The Quick brown fox jumps over the lazy dog and runs away again"),
    (7, "The Quick brown fox jumps over the lazy dog and runs away again"),
    (8, "the quick brown fox jumps over the lazy dog and runs away again"),
    (9, "É ÉCOLE ß straße 漢字 😀 \x00 end"),
    (10, "é École ß straße 漢字 😀 \x00 end"),
    (11, "word " * 30000),
    (12, "x" * 100000),
    (None, "one two"),
    (None, None),
]
