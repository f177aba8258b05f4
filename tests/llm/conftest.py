import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, wordless, very long, repeated and null-id rows, with a column whose name clashes."""
    passage = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
    rows = [
        (0, passage, "en", "a", None), (1, f"Intro here. {passage} and the end", "en", "b", None), (2, None, "fr", None, None), (3, "", None, "a", None), (4, "... !!! 123", "de", "b", None),
        (5, long, "en", "c", None), (5, long, "en", "c", None), (6, passage.upper(), "en", "a", None), (None, passage, "en", "a", None), (7, "one two", "en", "a", None), (8, "Licensed under the Apache License, Version 2.0. MIT License", "en", "b", None),
        (9, "naïve café été 日本 語 ﬁ 😀 x y", "fr", "a", None), (9, "another text with the same id", "en", "b", None),
    ]
    return spark.createDataFrame([(*r[:4], len(r[1]) if r[1] is not None else None, "clash", 1) for r in rows], DOCS + ", fingerprint string, bucket int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
