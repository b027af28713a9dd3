import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, fp int, size int, key string, node string, ids string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text[, source])``, with extra columns whose names clash with inner ones."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "site", len(r[1] or ""), "x", 1, 2, "k", "n", "i") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def words():
    r = random.Random(7)
    pool = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(400)]

    def text(n, seed):
        q = random.Random(seed)
        return " ".join(q.choice(pool) for _ in range(n))

    return text
