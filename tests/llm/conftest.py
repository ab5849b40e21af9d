import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _row string"


def words_of(seed, n):
    return [f"w{(seed * 7919 + i * i * 31 + i) % 997}x" for i in range(n)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    long_text = " ".join(words_of(3, 40_000))
    prose = " ".join(words_of(5, 120))
    near = " ".join(words_of(5, 118) + ["other", "end"])
    rows = [
        (1, prose, "en", "a", 1, "s", "r"),
        (2, near, "en", "a", 1, None, None),
        (3, prose.upper(), "en", None, 1, "s", "r"),
        (3, prose.upper(), "en", None, 1, "s", "r"),
        (4, "", "en", "b", 0, "s", "r"),
        (5, None, None, None, None, None, None),
        (None, "one two", "fr", "b", 7, "s", "r"),
        (6, " \t\n ", "de", "b", 4, "s", "r"),
        (7, "single", "de", "b", 6, "s", "r"),
        (8, long_text, "en", "c", len(long_text), "s", "r"),
        (9, "a b c " * 100, "en", "c", 600, "s", "r"),
    ]
    return spark.createDataFrame([Row(*r) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
