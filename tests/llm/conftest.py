import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, word string, key int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with further columns whose names clash with those that operators use."""

    def make(texts):
        rows = [(i, t, "en", None, None, "x", None, 3) if not isinstance(t, tuple) else (t[0], t[1], None, "s", 1, None, "w", None)
                for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, tied and repeated texts, and a row without a key."""
    long = " ".join(f"word{i % 997} and" for i in range(60_000))
    return [None, "", " \n\t ", "one", "a b c d e f", "a b c d e f", (4, "a b c d e f"), (None, "no key here at all today"), long, "Ünï cödé ✓ 𝒳 " * 30]
