import pytest

from tests.conftest import SMALL  # noqa: F401


@pytest.fixture
def odd_docs(spark):
    """Documents with NULLs, empty and long texts, repeats, and columns named like the operators' own."""
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "b", 3, 1.0, "x"),
        (1, "one two three four five six seven eight nine ten eleven", "en", "b", 3, 1.0, "x"),
        (2, None, None, None, None, None, None),
        (None, "lost words here\nand a second line", "en", "a", 5, 2.0, "y"),
        (None, None, None, None, None, None, None),
        (3, "", "de", "a", 0, 3.0, "z"),
        (4, " \t\n\r\n ", "de", "é", 6, 4.0, "z"),
        (5, "word " * 30_000, "de", "a", 150_000, 5.0, "z"),
        (6, "x" * 200_000, "fr", None, 200_000, 5.0, "z"),
        (7, "α β γ δ ε ζ η θ ι κ λ µ ν <|endoftext|> don't It's", "el", "b", 30, 6.0, "z"),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long, size double, words string"
    return spark.createDataFrame(rows, names)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.limit(0)
