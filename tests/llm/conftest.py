import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, _row string, shard int, kept string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows, and columns called as outputs are."""
    rng = random.Random(9)
    long = " ".join(words(rng, 30_000))
    texts = [
        (1, "Same   text\there.\nMore"), (2, "Same text here. More"), (3, None), (4, ""), (None, "no id"), (None, None),
        (5, " \t\n"), (6, long), (7, long), (8, "***"), (9, "one"), (9, "one"), (10, "é ü 日本語, x.\n\n  y"),
        (11, "a" * 5000), (12, "Same text here. More"),
    ]
    return [(i, t, None if i in (3, 9) else "en", None if i in (4, 7) else f"s{(i or 0) % 3}", None, "r", "_r", 3, "k")
            for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    def build(texts, sources=None):
        rows = [(i, t, "en", sources[i] if sources else "s", None, "r", "_r", 3, "k") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return build
