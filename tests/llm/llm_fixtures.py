import random

import pytest

SYLLABLES = ["ka", "lo", "mi", "ter", "an", "dro", "su", "vel", "por", "ni", "gra", "ish"]


@pytest.fixture(scope="session")
def words():
    """A seeded maker of word lists."""
    rng = random.Random(5)

    def make(n):
        return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]
    return make


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)
    return make


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls, empty and blank texts, repeated rows and ids, one very long text, odd characters."""
    long_text = " ".join(words(20_000))
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "two words"), (6, "A B c d e f g h i j k l m n"),
            (7, "A B c d e f g h i j k l m n"), (7, "A B c d e f g h i j k l m n"), (None, "A B c d e f g h i j k l m n"),
            (None, None), (8, long_text), (9, "é▁\x00 日本 🙂 " * 5), (10, long_text + " end"), (11, "x" * 30_000)]
