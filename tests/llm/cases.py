"""Fixtures and tables shared by the tests of this folder."""

import pytest

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """A documents table of (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


#: Nulls, empty and blank texts, a very long one, ties, repeated rows and ids.
ODD_ROWS = [
    (1, "a b c d e f g"),
    (2, None),
    (3, ""),
    (4, " \t\n"),
    (5, "a  b\tc d e f g"),
    (5, "a  b\tc d e f g"),
    (6, "word " * 30000),
    (None, "a b c d e f g"),
    (None, None),
    (7, "one"),
    (8, "naïve   中文 😀 </s> <|endoftext|>"),
    (8, "another text of the same id"),
    (-9, "a b c d e f g"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """``ODD_ROWS`` with more columns, whose names the operators use inside."""
    rows = [(i, t, "en", "s", 0, 1, "x", b"y", 2.5) for i, t in ODD_ROWS]
    return spark.createDataFrame(rows, DOCS + ", length long, keep_id string, prefix binary, _severity double")


@pytest.fixture(scope="session")
def no_docs(spark):
    return docs_of(spark, [(1, "x")]).limit(0)
