"""Texts and fixtures shared by the tests of this folder."""

import random

import pytest

WORDS = "the of and to in that with for was are on by be this from have not they which one".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if rng.random() < 0.4:
            out.append(rng.choice(WORDS))
        else:
            out.append("".join(rng.choice(["ta", "ri", "lo", "men", "su", "k", "ed", "vo"]) for _ in range(rng.randint(1, 4))))
    return " ".join(out)


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents from (doc_id, text, ...) rows."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        width = len(schema.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long, tied and repeated rows."""
    long = prose(1, 60_000)
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", None, "a", 4), (None, prose(2, 40), "en", None, None),
        (4, prose(2, 40), "en", "a", None), (5, long, "de", "b", None), (6, long, "de", "b", None),
        (7, prose(3, 50), "en", "a", None), (7, prose(3, 50), "en", "a", None), (7, prose(4, 50), "fr", "a", None),
        (8, "1234 5678 !!", "en", "b", None),
    ]
