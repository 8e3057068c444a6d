import pytest
from pyspark.sql import Row

AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog and the cat sat on the mat with the hat", "en", "a"),
    (2, "the quick  brown fox\njumps over the lazy dog and the cat sat on the mat with the hat", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, " \t\n", "de", "b"),
    (6, "ß😀 é" * 400, "de", "c"),
    (6, "ß😀 é" * 400, "de", "c"),
    (7, "x" * 3000, None, "c"),
    (8, "!!! ### 123", "en", "a"),
    (None, "der schnelle braune fuchs springt über den faulen hund und die katze", "de", None),
    (9, "word " * 5000, "en", "a"),
    (10, "the quick brown fox jumps over the lazy dog and the cat sat on the mat with the hat", "en", "a"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash."""
    rows = [Row(doc_id=i, text=t, lang=lang, source=s, n_chars=None, id=str(i), digest="x", fp=1, size=2, salt=None, n=3) for i, t, lang, s in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, digest string, fp int, size int, salt string, n int")
