import random

import pytest


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_docs(spark, words):
    """Null and empty texts, null ids and columns, repeats, a very long text, clashing column names."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b = prose(120), prose(90)
    rows = [
        (1, a, "en", "src1", None, "x"), (2, a, "en", "src1", 3, "x"), (3, a[:-4] + "zzzz", "de", "src2", 3, "x"), (4, b, None, None, 1, None),
        (5, None, "en", "src3", 0, "x"), (6, "", "en", "src3", 0, "x"), (6, "", "en", "src3", 0, "x"), (None, b, "fr", "odd", 9, "y"), (None, None, None, None, None, None),
        (7, "one", "en", "src1", 3, "x"), (8, " \t\n ", "en", "src1", 4, "x"), (9, prose(30_000), "es", "src9", 7, "x"), (10, "\n".join([prose(9)] * 6), "en", "src2", 2, "x"),
        (11, "line a\nline b\nline c\nline d\n" + b, "en", "src2", 2, "x"), (12, "line a\nline b\nline c\nline d\n" + a, "en", "src2", 2, "x"), (13, "é" * 500 + "漢字" * 300, "de", "src4", 2, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
