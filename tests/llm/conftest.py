import random

import pytest

EXTRA = "lang string, source string, n_chars long, score double, predicted int, row long, spans string, n long, component long, good boolean, h long, key string, part int, copy int"
SCHEMA = f"doc_id long, text string, {EXTRA}"


def words(r, n, size=400):
    return " ".join(f"w{r.randint(0, size)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Ids and texts with every awkward case."""
    r = random.Random(3)
    base = words(r, 120)
    near = base.split()
    near[60] = "other"
    passage = words(r, 60, 10**6)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "ONE two"),
        (7, base), (8, base), (9, " ".join(near)), (9, " ".join(near)),  # a repeated row
        (None, words(r, 50)), (None, "one two"),
        (10, words(r, 20) + " " + passage + " " + words(r, 30)), (11, words(r, 33) + " " + passage + " x"),
        (12, words(r, 40_000)), (13, "ab" * 60_000), (14, "é" * 700), (15, "a" * 199), (16, "a" * 200), (17, "😀\x00\x1c ▁ <|endoftext|>   x"),
        (18, "mail bob@example.com +1 (743) 555-3824, 4111 1111 1111 1111, 10.0.0.1"),
        (-5, words(r, 90)), (2**40, words(r, 91)),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", None, 7, 0.5, 1, 3, "s", 9, 1, None, 2, "k", 1, 1) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
