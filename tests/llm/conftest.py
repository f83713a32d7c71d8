import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, key string"


def words(seed: int, n: int, size: int = 400) -> list[str]:
    r = random.Random(seed)
    bank = ["".join(random.Random(k).choices("abcdefghijklmnoprstu", k=3 + k % 7)) for k in range(size)]
    return [r.choice(bank) for _ in range(n)]


def frame(spark, rows):
    """documents with extra columns, some named like results.  rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), True, 0.5, "k") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and blank texts, a very long text, repeated rows, equal ids."""
    long_text = " ".join(words(1, 60_000))
    return frame(spark, [(1, None), (2, ""), (3, " \n\t "), (4, long_text), (5, "one two"), (5, "one two"), (5, "three"), (None, "four five six seven eight"), (None, None, None), (6, " ".join(words(2, 80)), None)])


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
