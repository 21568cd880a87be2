import random

import pytest

LONG = " ".join(f"w{i % 700} x{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "Été", "naïve", "日本", "don't", "x1", "42", "3.14", "<|endoftext|>", "a\x0bb", " ", "🙂"]
    rows = [(None, "a text whose id is null"), (1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, "same text here"), (6, "same text here"), (6, "same text here"), (7, "same  text\there"), (8, "é é tail  \n\n\n end ")]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    return spark.createDataFrame([(i, t, "k", "b", 3, 0) for i, t in rows], "doc_id long, text string, key string, block string, fp int, component int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
