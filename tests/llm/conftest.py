import random

import pytest

WORDS = ["the", "of", "And", "quick", "naïve", "été", "Straße", "fox,", "dog.", "número", "code", "x1", "日本", "it's"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, label int, fingerprint string, score double, line string"


def text(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    base = [text(rng, rng.choice([1, 3, 12, 60, 200])) for _ in range(60)]
    near = [b.replace("quick", "slow", 1) for b in base[40:50]]
    return [None, "", " \n ", "a", "!!!", "word " * 3000, "x" * 20000, *base, *base[:10], *near]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Edge texts, copies, near copies, equal rows, null ids, and columns whose names operators use."""
    rows = [(k, t, "en", f"src{k % 7}", len(t or ""), "k", "r", 1, "f", 0.5, "l") for k, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, "some text without an id", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
