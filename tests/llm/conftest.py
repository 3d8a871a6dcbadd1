import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards boil water in big iron pots".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


#: Nulls, empty and blank texts, ties, repeated rows, copies but for white space, near copies, a long text.
TEXTS = [
    (1, prose(1, 60)), (2, prose(1, 60) + "  "), (3, prose(1, 59) + " other"), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "one"),
    (8, "one"), (9, "ONE"), (10, prose(2, 3000)), (11, prose(3, 40)), (12, prose(3, 40)), (None, prose(4, 30)), (13, "¡Ñandú! 你好 😀 ▁ x"), (14, "123 456"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, lang, "src", 0, "clash", "clash") for (i, t), lang in zip(TEXTS, ["en", "de", None] * 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, id string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
