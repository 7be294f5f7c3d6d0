import random

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """``[(doc_id, text), ...]`` -> documents with columns whose names operators use themselves."""

    def build(rows):
        schema = "doc_id long, text string, size string, row string, kept string, anchor string, slot string, spans string"
        return spark.createDataFrame([(d, t, *"abcdef") for d, t in rows], schema)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long, repeated and tied rows, null ids, texts of many scripts."""
    rng = random.Random(5)
    words = ["alpha", "Beta,", "gamma", "déjà", "naïve", "日本語", "x", "don't", "42", "ééé.", "<|endoftext|>", "e\u0301", "ΑΣ", "ſ"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(80)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, base), (7, base), (7, base), (None, base), (None, None), (8, say(30_000)), (9, "a" * 3000)]
    rows += [(20 + i, base.replace("alpha", "alpha" + "!" * i, 1)) for i in range(4)]
    rows += [(30 + i, say(rng.randint(1, 200)) + "\n" + base[:250] + "\n" + say(20)) for i in range(12)]
    return rows
