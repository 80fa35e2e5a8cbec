import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score string, size string, kept string, key int"
WORDS = "the of and rend threlyes nd ouble edoution onharent ofthst wh thor bel gre mon ti na so la".split()


def prose(n, seed=0):
    """``n`` words that repeat little."""
    return " ".join(WORDS[(k * k * 7 + seed * 13 + k) % len(WORDS)] + str((k * 31 + seed * 17) % 97) + "abcdefg"[(k + seed) % 7] for k in range(n))


def odd_rows():
    long = prose(60_000, 5)
    return [
        (1, prose(80), "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (4, "   \n\t", "de", None, 5), (None, prose(80, 2), "en", "b", 2),
        (5, long, "en", "b", len(long)), (6, prose(80, 3), "en", "b", 1), (6, prose(80, 3), "en", "b", 1), (7, prose(80, 3), None, "c", 1), (8, "Ünïcode wörd 字 🎉", "fr", "c", 9),
        (9, "word", "en", "c", 4), (10, prose(80) + " tail", "en", "a", 2), (11, "x" * 300_000, "en", "z", 3), (12, "a b c d", "en", "z", 3),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns named like results."""
    df = spark.createDataFrame([(*r, "r", "s", "t", None, 1) for r in odd_rows()], SCHEMA).repartition(3)
    df.cache().count()
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 13)] + [(1, 1, 0), (None, 1, 1), (400, None, None), (401, 7, 7)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def nobody():
    return lambda doc_id: F.lit(False)
