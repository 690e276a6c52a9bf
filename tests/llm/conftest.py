import random

import pytest

CLASHING = "id long, v string, row string, n int, key string, bands string, score double, rank int, size int, shard int, block_id int, probe int, label string"


def words(n: int, seed: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, short, very long, equal and repeated rows, a null id, and extra columns with clashing names."""
    passage = words(60, 5)
    texts = [
        (1, words(200, 1)), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, words(200, 1)), (7, words(200, 1) + " end"), (7, words(200, 1) + " end"), (None, words(200, 1)), (None, None),
        (8, words(40, 2) + " " + passage), (9, passage + "\n" + words(40, 3)), (10, words(30_000, 4, 5000)), (11, "é ß 日本 ▁ " * 40), (12, "a\n" * 50), (13, "x" * 5000), (-4, passage),
    ]
    extra = (9, "v", "r", 1, "k", "b", 0.5, 3, 4, 5, 6, 7, "l")
    return spark.createDataFrame([(i, t, *extra) for i, t in texts], f"doc_id long, text string, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")
