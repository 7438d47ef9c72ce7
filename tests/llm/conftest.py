import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text[, source]) rows, with extra columns whose names the operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 7, "y") for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA + ", host string, size long, taken string")

    return make


@pytest.fixture(scope="session")
def words():
    """Distinct invented words, by number."""

    def make(n, seed=0):
        import random

        r = random.Random(seed)
        return ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(n)]

    return make
