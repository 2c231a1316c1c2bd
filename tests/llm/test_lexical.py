import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import make_docs, odd_rows, prose  # noqa: F401

from prefixdex.llm import lexical, words

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def brute(rows, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    n, total = sum(1 for _, c in docs if c), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in items:
        found = []
        for ident, c in docs:
            if c:
                m = 10 + 90 * sum(c.values()) * n // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
                if score > 0:
                    found.append((-score, ident is None, ident))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, r + 1, ident, -score) for r, (score, _, ident) in enumerate(found[:k])]
    return Counter(out)


def got(frame):
    return Counter(tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture
def tables_of(make_docs, odd_rows):  # noqa: F811
    rng = random.Random(4)
    rows = [(r[0], r[1]) for r in odd_rows] + [(i, prose(i % 90, rng.randint(1, 60))) for i in range(20, 300)]
    rows += [(500 + i, "Same É-x9 words THE the the") for i in range(40)]
    items = [(i, prose(i + 20, 30)) for i in range(12)] + [(3, prose(5, 20)), (None, "the é x9"), (40, None), (41, "..."), (42, "nowheretobefound")]
    return rows, items, make_docs(rows, "doc_id long, text string").repartition(5), make_docs(items, "item_id long, text string")


@pytest.mark.parametrize("slice_bytes", [1 << 24, 300])
def test_against_brute_force(tables_of, monkeypatch, slice_bytes):
    rows, items, docs, wanted = tables_of
    monkeypatch.setattr(lexical, "MERGE", 2)
    assert got(lexical.search(docs, wanted, slice_bytes=slice_bytes)) == brute(rows, items)
    assert got(lexical.search(docs, wanted, k=3, slice_bytes=slice_bytes)) == brute(rows, items, 3)


def test_scores_by_small_steps(monkeypatch):
    """The scores of a part do not depend on how many cells are held at a time."""
    rows, texts = [], [prose(i, 40) for i in range(30)] + ["", "the"]
    index = lexical.build(_Items([prose(i, 25) for i in range(9)]))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    weight = np.arange(1, len(index.hashed) + 1)
    for cells in (1 << 21, 50, 9, 1):
        monkeypatch.setattr(lexical, "CELLS", cells)
        parts = list(lexical._scores(index, weight, 31, 900, data, offsets, 90))
        rows.append(np.concatenate([s for _, s in parts]))
        assert len(rows[-1]) == len(texts)
    assert all((r == rows[0]).all() for r in rows)


class _Items:
    """Rows as ``item_terms`` gives them."""

    def __init__(self, texts):
        self.rows = [{"item": i, "item_id": i, "terms": "\n".join(sorted(set(terms(t)))).encode()} for i, t in enumerate(texts)]

    def orderBy(self, _):  # noqa: N802
        return self

    def collect(self):
        return self.rows


def test_index_terms_are_compared_by_their_bytes(monkeypatch):
    index = lexical.build(_Items(["alpha beta", "beta gamma"]))
    data = np.frombuffer(b"alpha Beta delta gamma alpha", np.uint8)
    real = words.hashes
    # Every word hashes like an index term.
    monkeypatch.setattr(words, "hashes", lambda d, s, e, seed=1: np.full(len(s), index.hashed[0]) if len(s) == 5 else real(d, s, e, seed))
    doc, term, n = index.hits(data, np.array([0, len(data)]))
    spelled = [bytes(index.data[index.starts[t] : index.ends[t]]) for t in term]
    assert n.tolist() == [5] and set(spelled) <= {b"alpha", b"beta", b"gamma"} and len(set(spelled)) == 1


def test_empty_tables_and_clashing_columns(make_docs):  # noqa: F811
    schema = "doc_id long, text string, rank string, item string, score string"
    docs = make_docs([(1, "a b c", "x", "y", "z")], schema)
    items = make_docs([(1, "a q", "x", "y")], "item_id long, text string, doc_id string, bytes string")
    assert got(lexical.search(docs, items)) == brute([(1, "a b c")], [(1, "a q")])
    assert lexical.search(docs, items.where("false")).count() == 0
    assert lexical.search(docs.where("false"), items).count() == 0
