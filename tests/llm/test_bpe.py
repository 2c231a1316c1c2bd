import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from llm_fixtures import make_docs, odd_rows  # noqa: F401

from prefixdex.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "\n\n  \t x", "Hello world's   café ☕️ <|endoftext|> 123456", "ÀÉÎ 漢字 ▁underline ▁▁", "  a\u0000b", "don't DON'T I'll", "x" * 5000, "<unk><s></s>", "a\x00\x01\x7f\x80 ﬁ"]


def test_ids_and_round_trip(make_docs, odd_rows, reference):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, r[1]) for i, r in enumerate(odd_rows)] + [(100, "again"), (None, "no id")]
    got = sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(make_docs(rows), PATH, P.PATTERN).collect()], key=str)
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_table_of_documents(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.ids for r in bpe.encode(docs, PATH, P.PATTERN).collect()}
    for r in docs.collect():
        assert np.frombuffer(got[r.doc_id], "<u4").tolist() == reference.encode_ordinary(r.text)


def test_small_memory_gives_the_same_ids(monkeypatch, reference):
    monkeypatch.setattr(bpe, "REMEMBER", 8)
    with open(PATH, "rb") as f:
        codec = bpe.Codec(bpe.serialise(bpe.read_ranks(f.read())), P.PATTERN)
    text = "one two three four five six seven eight nine ten eleven twelve one two"
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


def test_empty_table(make_docs):
    assert bpe.round_trip(make_docs([]), PATH, P.PATTERN).count() == 0
