import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, place string, keys string, component string, score string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ta", "ren", "o", "shi", "mek", "lu"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows(*pairs, lang="en", source="s0"):
    """(doc_id, text[, source]) as rows of the documents, with extra columns whose names the operators use inside."""
    return [(p[0], p[1], lang, p[2] if len(p) > 2 else source, None, 7, "x", "k", "c", "s") for p in pairs]


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda *pairs: spark.createDataFrame(rows(*pairs), DOC)


@pytest.fixture(scope="session")
def messy():
    """Null, empty, white, short, equal, near, repeated and very long texts; null ids and sources."""
    base = words(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    long = words(3, 60_000)
    return [
        (1, base), (2, base.upper()), (3, " ".join(near)), (4, words(2, 120), None), (5, None), (6, ""), (7, " \n\t "), (8, "one two three"),
        (9, "one  two\nthree", "s1"), (10, long, "s1"), (11, long + " tail of it", "s2"), (None, base), (12, words(4, 30), "s2"), (12, words(4, 30), "s2"), (None, None, None),
    ]
