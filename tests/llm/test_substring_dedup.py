import random
import re

import numpy as np
from pyspark.sql import functions as F
from llm_fixtures import make_docs, odd_rows, prose  # noqa: F401

from prefixdex.llm import substring_dedup as S
from prefixdex.llm import tables
from prefixdex.llm.fm_index import FMIndex, WaveletMatrix


def brute(rows):
    low, each = {}, []
    for r in rows:
        own = -(1 << 63) if r[0] is None else r[0]
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        each.append((own, w))
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            low[k] = min(low.get(k, own), own)
    out = []
    for r, (own, w) in zip(rows, each, strict=True):
        gone = {i + k for i in range(len(w) - 12) if low[tuple(w[i : i + 13])] < own for k in range(13)}
        out.append((r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def collected(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect()], key=str)


def test_odd_rows_match_brute_force(make_docs, odd_rows):
    assert collected(S.dedup(make_docs(odd_rows))) == brute(odd_rows)
    assert S.dedup(make_docs([])).count() == 0


def test_shared_passages_match_brute_force(make_docs):
    rng = random.Random(4)
    passages = [prose(100 + i, 13 + 9 * i) for i in range(6)] + ["a b " * 30, "z " * 40]
    rows = []
    for i in rng.sample(range(200), 60):
        parts = [prose(1000 + i, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), prose(rng.randint(0, 10**6), rng.randint(0, 5))]
        rows.append((i, rng.choice([" ", "\n", "\t\x0b"]).join(parts)))
    rows += [rows[0], (rows[1][0], passages[5]), (None, passages[4])]
    assert collected(S.dedup(make_docs(rows))) == brute(rows)


def test_many_shards_match_one(make_docs):
    rows = [(i, prose(i % 7, 60)) for i in range(30)]
    segments = S.cut(make_docs(rows), S.repeated(make_docs(rows)))
    one = {(r.hash, r.digest): r.low for r in S.smallest_ids(segments).collect()}
    many = {(r.hash, r.digest): r.low for r in S.smallest_ids(segments, shard_words=40).collect()}
    assert one == many and one


def test_a_hot_hash_is_dealt_over_many_shards(make_docs, monkeypatch):
    passage = prose(5, 40)
    rows = [(i, f"{prose(1000 + i, 20)} {passage} {prose(5000 + i, 20)}") for i in range(300)]
    docs = make_docs(rows)
    segments = tables.save(S.cut(docs, S.repeated(docs)), "test_segments")
    per_hash = segments.select("hash", "body").distinct().groupBy("hash").count().agg({"count": "max"}).first()[0]
    assert per_hash > 200  # one hash has most documents' own words at the passage's edge
    most, indexed = [], S._indexed

    def watched(distinct, key, shard_words):
        shards = 1 + distinct.count() * (S.WINDOW + 4) // shard_words
        size = distinct.groupBy(F.pmod(key, F.lit(shards))).agg(F.sum(F.size(F.split("body", " ")) + 1).alias("n"))
        most.append(size.agg(F.max("n")).first()[0] or 0)
        return indexed(distinct, key, shard_words)

    monkeypatch.setattr(S, "_indexed", watched)
    one = {(r.hash, r.digest): r.low for r in S.smallest_ids(segments, shard_words=10**6).collect()}
    many = {(r.hash, r.digest): r.low for r in S.smallest_ids(segments, shard_words=1000).collect()}
    assert one == many and one
    assert most[0] > 4000 and max(most[1:]) < 2000 and len(most) == 3
    monkeypatch.setattr(S.smallest_ids, "__defaults__", (1000,))
    assert collected(S.dedup(docs)) == brute(rows)


def test_streamed_windows_that_only_share_an_anchor_stay(make_docs):
    few = prose(8, 6)  # of its own less than a window
    rows = [(i, f"{prose(100 + i, 12)} {few} {prose(200 + i, 12)}") for i in range(40)] + [(50, prose(100, 12)), (51, f"{prose(103, 12)} {few} {prose(203, 12)} on")]
    docs = make_docs(rows)
    segments = tables.save(S.cut(docs, S.repeated(docs)), "test_segments")
    low = [x for r in S.smallest_ids(segments).collect() for x in r.low]
    none = np.iinfo(np.int64).max
    assert low.count(none) > 10 and any(x != none for x in low)
    # Smallest ids are not streamed, largest ones not indexed.
    assert segments.where("not streamed").count() and segments.where("not indexed").count()
    assert collected(S.dedup(docs)) == brute(rows)


def test_rows_that_share_an_id(make_docs):
    passage = prose(3, 30)
    rows = [(None, f"{prose(300 + i, 20)} {passage} {i}") for i in range(40)] + [(7, f"{passage} a"), (7, f"b {passage}"), (7, f"b {passage}"), (8, passage)]
    assert collected(S.dedup(make_docs([(*r, "x", 1) for r in rows], "doc_id long, text string, hash string, row int"))) == brute(rows)


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(2)
    for kinds in (1, 2, 3, 17, 300):
        values = rng.integers(0, kinds, 1000)
        w = WaveletMatrix(values, kinds)
        symbol, at = rng.integers(0, kinds, 500), rng.integers(0, 1001, 500)
        assert w.rank(symbol, at).tolist() == [int((values[:a] == s).sum()) for s, a in zip(symbol, at, strict=True)]


def test_matching_statistics():
    rng = np.random.default_rng(3)
    text = np.concatenate([[0], rng.integers(1, 4, 200), [0], rng.integers(1, 4, 100)])
    stream = rng.integers(1, 5, 300)
    length, low, high = FMIndex(text, 6).matches(stream, np.arange(1, 301), 6)
    runs = {tuple(text[i : i + n]) for n in range(1, 7) for i in range(len(text) - n + 1)}
    for end, n in enumerate(length, 1):
        want = max([k for k in range(0, min(6, end) + 1) if k == 0 or tuple(stream[end - k : end]) in runs])
        assert n == want
        if n:
            found = sum(tuple(text[i : i + n]) == tuple(stream[end - n : end]) for i in range(len(text) - n + 1))
            assert high[end - 1] - low[end - 1] == found
