import hashlib
import re
from llm_fixtures import make_docs, odd_rows  # noqa: F401

from prefixdex.llm import exact_dedup as E


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute(rows):
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(norm(r[1]), []).append((-len(r[1] or ""), float("inf") if r[0] is None else r[0], k))
    out = []
    for k, r in enumerate(rows):
        g = sorted(groups[norm(r[1])])
        keep = rows[g[0][2]][0]
        out.append((r[0], keep, len(g), hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows_match_brute_force(make_docs, odd_rows):
    got = E.classes(make_docs(odd_rows)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(odd_rows)
    assert sum(r.kept for r in got) == len({norm(r[1]) for r in odd_rows})


def test_colliding_fingerprints_are_told_apart(make_docs):
    rows = [(i, f"text {i % 5} x") for i in range(40)] + [(100 + i, "a b" if i % 2 else "ab") for i in range(6)]
    got = E.classes(make_docs(rows), primes=(2, 3), bases=(1, 1)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)


def test_chunks_compose():
    import numpy as np

    data = np.frombuffer(bytes(range(256)) * 700, np.uint8)
    whole = E.Fingerprint(chunk=len(data)).of(data)
    assert whole == E.Fingerprint(chunk=1000).of(data) == E.Fingerprint(chunk=7).of(data)
    p, b = E.PRIMES[0], E.BASES[0]
    assert sum(int(x) * pow(b, len(data) - 1 - i, p) for i, x in enumerate(data)) % p == whole[0]


def test_empty_table_and_clashing_columns(make_docs):
    assert E.classes(make_docs([])).count() == 0
    docs = make_docs([(1, "x y", "q", "r", 1, 5, "z"), (2, "xy", "q", "r", 1, 6, "z")], "doc_id long, text string, lang string, source string, n_chars long, row int, kept string")
    out = E.dedup(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]
