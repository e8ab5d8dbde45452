import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts, or (id, text) pairs."""

    def make(rows, source="s"):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t)) for i, t in pairs], SCHEMA)

    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded invented sentences."""
    rng = random.Random(5)
    words = ["".join(rng.choice(["ta", "re", "ono", "shi", "vel", "qu", "am", "ier"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(words) for _ in range(n))

    return make


#: Texts that every operator must take: null, empty, white space, one word, unusual characters, one
#: line over and over, a long one.
ODD = [None, "", " \n\t ", "word", "\u00a0\u2003x", "a\n" * 50, "𝒳𝒴 ключ 漢字 É", "lorem ipsum " * 20_000, "x" * 100_000]


@pytest.fixture(scope="session")
def odd(docs_of):
    """Odd texts, repeated rows, null ids, and columns with names the operators use inside."""
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate(ODD)] + [(0, None), (3, "word"), (None, "word"), (None, None), (None, "word")]
    names = ("k1", "k2", "row", "hits", "id", "lines", "kept", "n_words", "size", "root", "first", "gone", "place", "h1")
    return docs_of(rows).withColumns({n: F.lit(1) for n in names})
