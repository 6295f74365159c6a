import pytest

LONG = "lang wort " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and further columns with clashing names."""
    rows = [
        (0, "", "a"), (1, None, "a"), (2, "one two three four five six seven", None), (2, "one two three four five six seven", None),
        (3, "ONE two three x four five six seven", "b"), (4, "one two three four five six seven", "b"), (None, "no name here at all", "b"),
        (5, LONG, "c"), (6, "x" * 100_000, "c"), (7, "mail a@b.co\n\n 10.0.0.1 \U0001f600 a", "c"), (8, " \t\n", None),
    ]
    extra = [(d, t, s, "en", 7, 1.0, 2, "w", True) for d, t, s in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, source string, lang string, n_chars long, score double, size long, words string, kept boolean")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
