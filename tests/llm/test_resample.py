import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import make_docs, odd_rows, prose  # noqa: F401

from prefixdex.llm import regular_sort, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def text_features(text, ngrams):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    found = WORD.findall(lowered)
    return len(found), [" ".join(found[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(found) - n + 1)]


def brute(rows, target, ngrams=1, buckets=10_000, min_words=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    each = [(i, *text_features(t, ngrams)) for i, t in rows]
    s, t = Counter(bucket(f) for _, _, fs in each for f in fs), Counter(bucket(f) for x in target for f in text_features(x, ngrams)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for ident, words, fs in each:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        out.append([ident, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words >= min_words])
    order = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def got(frame):
    return Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in frame.collect())


@pytest.mark.parametrize("ngrams,segment", [(1, 50_000), (2, 30), (3, 7)])
def test_against_brute_force(make_docs, odd_rows, monkeypatch, ngrams, segment):  # noqa: F811
    monkeypatch.setattr(regular_sort, "SEGMENT", segment)
    rng = random.Random(ngrams)
    rows = [(i, prose(i, rng.randint(1, 80))) for i in range(20, 260)] + [(r[0], r[1]) for r in odd_rows] + [(600, "É é-x_Y9 " * 30)]
    target = [prose(1000 + i, 40) for i in range(12)] + [None, ""]
    docs = make_docs(rows, "doc_id long, text string").repartition(5)
    aim = make_docs([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert got(resample.resample(docs, aim, ngrams=ngrams, percent=40)) == brute(rows, target, ngrams, percent=40)


def test_empty_tables_and_clashing_columns(make_docs):  # noqa: F811
    schema = "doc_id long, text string, rank string, score string, weight int, __row string, __text string"
    rows = [(i, prose(i, 30), "r", "s", 1, "x", "y") for i in range(50)]
    docs, aim = make_docs(rows, schema), make_docs([(1, prose(7, 30))], "item_id long, text string")
    kept = resample.drawn(docs, aim)
    assert kept.columns == docs.columns and kept.count() == 5
    want = {r[0] for r in brute([r[:2] for r in rows], [prose(7, 30)]) if r[4]}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert resample.resample(make_docs([], schema), aim).count() == 0
    assert got(resample.resample(docs, aim.where("false"))) == brute([r[:2] for r in rows], [])


def test_ranks_are_exact_with_one_key_for_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(regular_sort, "SEGMENT", 100)
    rng = random.Random(1)
    rows = [(7, 500, True)] * 1000 + [(rng.randint(0, 400), rng.randint(0, 900), rng.random() < 0.9) for _ in range(2000)] + [(None, 500, True), (3, 500, None)]
    frame = spark.createDataFrame(rows, "doc_id long, score long, among boolean").repartition(6)
    out = regular_sort.ranked(frame, "score", "doc_id", "among", lambda n: n // 2)
    order = sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    found = sorted((r for r in out.collect() if r["rank"]), key=lambda r: r["rank"])
    assert [(r["doc_id"], r["score"]) for r in found] == [r[:2] for r in order[: len(order) // 2]]
    assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and out.count() == len(rows)
    # The equal rows are spread over several segments.
    plan = out._jdf.queryExecution().toString()
    assert "__segment" in plan


def test_crc32():
    rng = random.Random(2)
    texts = [rng.randbytes(n) for n in (0, 1, 5, 127, 128, 129, 300, 5000)] + [rng.randbytes(rng.randint(1, 12)) for _ in range(300)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    assert resample.crc32(data, starts, ends).tolist() == [zlib.crc32(t) for t in texts]
