import random

import pytest

HARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "é" * 3 + " \x1c word\x85word"), (6, "x" * 200_000), (7, "the the the " * 5000),
    (8, "A b C\na b c\nA b C\n# * | <>"), (9, "A b C\na b c\nA b C\n# * | <>"), (9, "A b C\na b c\nA b C\n# * | <>"), (None, "no id here"),
    (10, "\x00\x7f퟿ 𝔘𝔫𝔦   z"),
]


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with results."""
    rows = [(i and 1000 + i, t, None, "s", 1, 2.0, "x", True) for i, t in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, score double, spans string, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def prose():
    draw = random.Random(7)
    vocabulary = ["".join(draw.choice(["th", "er", "on", "an", "ñ", "é", "in"]) for _ in range(draw.randint(1, 4))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choice(vocabulary) for _ in range(n))
