import hashlib
import random
import re

import numpy as np
import pytest
from llm_fixtures import make_docs, odd_rows, prose  # noqa: F401

from prefixdex.llm import jaccard_join as J
from prefixdex.llm.components import components


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def classes(rows):
    """Classes as lists of places, and the links of every row, all pairs compared."""
    each = [sets(r[1]) for r in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(each[i] & each[j])
            if both and 5 * both >= 4 * (len(each[i]) + len(each[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return list(out.values()), links


def brute(rows):
    """(doc_id, class_id, links, class size) of every row."""
    found, links = classes(rows)
    out = []
    for members in found:
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], min(ids, default=None), links[i], len(members)) for i in members]
    return sorted(out, key=str)


def kept(rows):
    """The rows that stay: of each class the smallest id, then the smallest md5."""
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())
    return sorted((min((rows[i] for i in members), key=order) for members in classes(rows)[0]), key=str)


def collected(df):
    return sorted([(r.doc_id, r.class_id, r.n_links, r.class_size) for r in df.collect()], key=str)


def changed(text, seed, n):
    rng, w = random.Random(seed), text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"w{rng.random()}"
    return " ".join(w)


def test_odd_rows(make_docs, odd_rows):
    assert collected(J.join(make_docs(odd_rows))) == brute(odd_rows)
    assert J.join(make_docs([])).count() == 0


def test_near_copies_match_brute_force(make_docs):
    rows = [(i, prose(i, 30 + i)) for i in range(150)]
    rows += [(1000 + i, changed(prose(i % 40, 30 + i % 40), i, 1 + i % 4)) for i in range(200)]
    rows += [(2000 + i, f"one two three {i % 3}") for i in range(9)]
    assert collected(J.join(make_docs(rows))) == brute(rows)


@pytest.mark.parametrize("splits", [1_000_000, 2])
def test_a_group_larger_than_a_bucket_is_compared_whole(make_docs, monkeypatch, splits):
    for name, value in (("LIMIT", 16), ("SPLITS", splits), ("BLOCK", 8), ("TILE", 8), ("SET_BYTES", 4000), ("FOLD", 50), ("FEW_ROWS", 0)):
        monkeypatch.setattr(J, name, value)
    base = prose(9, 120)
    rows = [(i, changed(base, i, 1 + i % 3)) for i in range(90)] + [(500 + i, prose(700 + i, 60)) for i in range(30)]
    assert collected(J.join(make_docs(rows))) == brute(rows)


def test_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got, want = {r[0]: r for r in collected(J.join(docs))}, {r[0]: r for r in brute(rows)}
    linked = sum(r[2] for r in want.values())
    assert linked and sum(r[2] for r in got.values()) >= 0.99 * linked


X, Y = prose(11, 90), prose(12, 90)


@pytest.mark.parametrize("rows", [
    [(7, Y), (3, changed(Y, 1, 1)), (3, None), (3, ""), (7, None)],
    [(7, X), (7, Y), (3, changed(Y, 1, 1))],
    [(None, X), (None, Y), (4, changed(Y, 1, 1))],
    [(5, X), (5, X), (6, changed(X, 1, 1)), (None, Y), (None, Y), (None, changed(Y, 2, 1))],
    [(None, prose(i // 2, 60 + i)) for i in range(60)] + [(1, ""), (None, None)],
])
def test_rows_that_share_an_id(make_docs, rows):
    assert collected(J.join(make_docs(rows))) == brute(rows)
    out = J.dedup(make_docs([(*r, "l", "i") for r in rows], "doc_id long, text string, label string, __id string"))
    assert out.columns == ["doc_id", "text", "label", "__id"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == kept(rows)


def test_folded_nodes_lose_no_link():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, J.HASHES)
    sketch = []
    for _ in range(120):  # around a few centres, which differ by more than alike nodes do
        row = base.copy()
        row[: rng.integers(0, 40)] = rng.integers(0, 256)
        at = rng.integers(0, J.HASHES, rng.integers(0, 8))
        row[at] = rng.integers(0, 256, len(at))
        sketch.append(row)
    sketch = np.array(sketch, np.uint8)
    root = J._folded(sketch, 50)[2]
    assert (np.unique(J._folded(sketch, 50)[0]) < 120).all()
    a, b = np.nonzero((sketch[:, None] == sketch[None]).sum(2) >= J.LOOSE)
    assert (root[a] == root[b]).all() and len(J._folded(sketch, 50)[0]) < 120
    together = J.local(120, a, b)
    assert len(np.unique(root)) <= len(np.unique(together))


def test_one_of_each_class_stays(make_docs):
    rows = [(5, prose(1, 80)), (3, changed(prose(1, 80), 1, 1)), (4, prose(2, 80)), (6, None), (7, "")]
    assert sorted(r.doc_id for r in J.dedup(make_docs(rows)).collect()) == [3, 4, 6, 7]


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(200)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(150)] + [(5000, 5001), (5001, 5000)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
