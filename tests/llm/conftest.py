import random

import pytest

CLASHES = "doc_id bigint, text string, lang string, source string, n_chars bigint, t string, words string, rid string, node string, key string, size string, place string"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    rng = random.Random(3)
    words = ["the", "of", "and", "tion", "er", "ing", "alpha", "beta", "gamma", "delta", "the,", "Être", "ß"]
    prose = [" ".join(rng.choice(words) + str(rng.randrange(40)) * (rng.random() < 0.4) for _ in range(n)) for n in (60, 61, 200, 3)]
    long = "\n".join(" ".join(rng.choice(words) + str(rng.randrange(900)) for _ in range(12)) for _ in range(1500))
    texts = [None, "", " \n\t ", *prose, prose[0], prose[0], prose[2] + " tail", long, "one", "x" * 5000, "a b c 😀 \r\n d"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "src0", None, *["clash"] * 7) for i, t in enumerate(texts)]
    return rows + [(3, prose[0], "en", "src1", 5, *["clash"] * 7), (3, prose[0], "en", "src1", 5, *["clash"] * 7), (None, prose[1], "en", "src1", 5, *["clash"] * 7)]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, CLASHES)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], CLASHES)
