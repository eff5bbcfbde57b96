import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, k1 int, row string, size string, n_words string, gone int, key string, component string"


def words(seed, n, vocabulary=2000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def make(spark):
    """documents of (doc_id, text) or (doc_id, text, source), with more columns whose names the operators use inside."""

    def f(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "id", 1, "row", "size", "n", 2, "key", "c") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return f
