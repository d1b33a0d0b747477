import pytest

ODD = "id long, text string, n long, h long, fp long, key long, doc long, size long, count long, bucket int, row string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns named as the operators' own."""
    long = "The quick brown fox jumps over the lazy dog again. " * 4000
    rows = [(1, "a  b"), (2, "a\tb"), (2, "a\tb"), (3, None), (4, ""), (None, "a b"), (None, None), (5, long), (6, long),
            (5, "other text of the same id"), (7, "x"), (8, "é ü " * 50), (9, "\n\n \n"), (10, "A" * 700)]
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6, 7, 8, "r") for i, t in rows], ODD)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
