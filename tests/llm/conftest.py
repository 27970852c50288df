from __future__ import annotations

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """The small documents table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, None, None), (4, "", "en", "a"),
            (5, " \n\t ", "en", "a"), (6, "one two", "en", "a"), (7, "One TWO", "de", "a"), (None, base + " x", "en", "a"),
            (None, None, None, None), (8, "!!! ???", "en", "a"), (9, "é" * 900, "fr", "b"),
            (10, base.replace("word7 ", "other "), "en", "b"), (11, "z " * 40_000, "en", "b"), (-5, "tail " * 3, "en", "b")]
    full = [(i, t, la, s, len(t) if t is not None else None, 7, "q", 1) for i, t, la, s in rows]
    return spark.createDataFrame(full, DOC_SCHEMA + ", length long, key string, token int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
