import hashlib
import re

import corpus_pipeline as C
import numpy as np
from test_jaccard_join import kept as near_kept
from llm_fixtures import make_docs, odd_rows, prose  # noqa: F401

from prefixdex.llm import bpe, queries


def test_stages_match_brute_force(spark, make_docs, odd_rows):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    shared = [(10050, prose(60, 90), "en", "a", 1), (10050, prose(61, 90), "en", "a", 2), (10040, prose(61, 90) + " end", "en", "a", 3)]
    shared += [(None, prose(62 + i % 2, 80) + " end" * (i // 2), "en", "b", 4) for i in range(4)]
    docs = base.unionByName(make_docs(odd_rows).selectExpr("doc_id + 10000 as doc_id", "text", "lang", "source", "n_chars"))
    docs = docs.unionByName(make_docs(shared))
    rows = [tuple(r) for r in docs.collect()]
    out = []
    for k, (_, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        if k < 4:
            assert docs.columns == base.columns
            kept = [tuple(r) for r in docs.collect()]
            docs = spark.createDataFrame(kept, base.schema)
            out.append(kept)
    languages, exact, near, mixed = out
    assert sorted(languages, key=str) == sorted((r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])), key=str)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    best = {}
    for r in languages:
        k = norm(r[1])
        order = (-len(r[1]), float("inf") if r[0] is None else r[0])
        best[k] = min(best.get(k, (order, r)), (order, r), key=lambda x: x[0])
    assert sorted(exact, key=str) == sorted((r for _, r in best.values()), key=str)
    assert sorted(near, key=str) == near_kept(exact)
    assert {r for r in mixed} == set(near)
    path, pattern = queries.tokenizer()
    with open(path, "rb") as f:
        codec = bpe.Codec(bpe.serialise(bpe.read_ranks(f.read())), pattern)
    want = sorted((r[0] is None, r[0], hashlib.sha256(codec.encode(r[1])).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()) for r in mixed)
    assert sorted((r.doc_id is None, r.doc_id, r.ids_sha256, r.decoded_sha256) for r in docs.collect()) == want
    assert all(len(np.frombuffer(r.ids, "<u4")) == r.n_tokens for r in docs.collect())
