import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import make_docs, odd_rows, prose  # noqa: F401

from prefixdex.llm import packing, words

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def tokens(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END]


def test_tokens_are_those_of_the_tokenizer(tokenizer):
    rng = random.Random(5)
    odd = ["", " ", "\n\tit's  IT'S\x0b'lL 've", "<|endoftext|> a<|startoftext|>b <|endof text|>", "é ́e\ń", "a b c　d",
           "ẛ̣ ﬁ İI Σσς", "日本語のテキスト 12３", "x" * 5000, "a1b2--c_d", "🙂🙂‍↔️ z", "\x1c\x1d \x85\x00"]
    kinds = "aB9 \n\t'.-́é 日\x1c<|>ſKÅ"
    # Every character of one and two bytes (and some more) beside letters, digits and signs.
    odd += [f"{chr(c)}a{chr(c)}1{chr(c)}{chr(c)}.{chr(c)} É{chr(c)}'S" for c in [*range(0x250), *range(0x300, 0x340), 0x130, 0x1E9E, 0x2126, 0x212B]]
    texts = odd + ["".join(rng.choice(kinds) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [" ".join(odd)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    with open(PATH, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    for _ in range(2):  # the second time from memory
        ids, at = encoder.encode(data, offsets)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == tokens(tokenizer, t)[:-1], t


def test_distinct_words_with_equal_hashes(monkeypatch):
    data = np.frombuffer(b"ab cd ab cd efg", np.uint8)
    starts, ends = words.spans(data, np.array([0, len(data)]))
    for hashes in (words.hashes, lambda d, s, e, seed=1: np.zeros(len(s), np.uint64)):
        monkeypatch.setattr(words, "hashes", hashes)
        first, kind = words.distinct(data, starts, ends)
        texts = [bytes(data[s:e]) for s, e in zip(starts, ends, strict=True)]
        assert [texts[first[k]] for k in kind] == texts and len(first) == 3


def brute_best_fit(lengths, size):
    room, of = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [s for s in range(len(room)) if room[s] >= lengths[i]]
        tight = min((room[s] for s in fits), default=None)
        if tight is None:
            room.append(size)
            tight = size
        s = next(s for s in range(len(room)) if room[s] == tight)
        of[i] = tight
        room[s] -= lengths[i]
    return of, sorted(room)


@pytest.mark.parametrize("size", [1, 7, 64, 100, 4096])
def test_best_fit_is_the_tightest(size):
    rng = np.random.default_rng(size)
    for n in (0, 1, 50, 300):
        length = rng.integers(1, size + 1, n)
        sequence, offset, room = packing.best_fit(length, size)
        tight, left = brute_best_fit(length.tolist(), size)
        assert [size - o for o in offset.tolist()] == [tight[i] for i in range(n)]
        assert sorted(room.tolist()) == left and len(set(sequence.tolist())) == len(left)


def check(rows, texts, tokenizer, size):
    """Rows are whole: every document's tokens in its pieces, sequences without gaps."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in texts.items():
        ids, got = tokens(tokenizer, text), sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in got] == [(k, a, min(size, len(ids) - a)) for k, a in enumerate(range(0, len(ids), size))]
        for r in got:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert set(by_doc) == set(texts)
    for placed in by_sequence.values():
        at = 0
        for r in sorted(placed, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_sequence)


@pytest.mark.parametrize("shard", [32_000, 40])
def test_packs_whole_documents(spark, make_docs, tokenizer, monkeypatch, shard):  # noqa: F811
    monkeypatch.setattr(packing, "SHARD", shard)
    rng = random.Random(3)
    texts = {i: prose(i, rng.choice([3, 20, 60, 200])) for i in range(400)} | {900: None, 901: "", 902: prose(9, 9000)}
    docs = make_docs([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    packed = packing.pack(packing.pieces(docs, PATH, size=512), size=512)
    rows = packed.collect()
    count = check(rows, texts, tokenizer, 512)
    alone = len(brute_best_fit([r["length"] for r in rows], 512)[1])  # all pieces in one shard
    assert count == alone if shard > len(rows) else count <= alone + alone // 20


def test_sequences_hold_the_tokens(make_docs, tokenizer):  # noqa: F811
    texts = {1: prose(1, 30), 2: None, 3: prose(3, 900), 4: prose(4, 50)}
    docs = make_docs([(i, t) for i, t in texts.items()], "doc_id long, text string")
    packed = packing.pack(packing.pieces(docs, PATH, size=256), size=256)
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        s = whole[r["sequence_id"]]
        ids = np.frombuffer(s["ids"], "<u4")
        assert len(ids) == s["length"] and r["doc_id"] in s["doc_ids"]
        assert ids[r["offset"] : r["offset"] + r["length"]].tolist() == tokens(tokenizer, texts[r["doc_id"]])[r["start"] : r["start"] + r["length"]]


def test_odd_rows(make_docs, odd_rows, tokenizer):  # noqa: F811
    from collections import Counter

    schema = "doc_id long, text string, piece string, sequence_id int, length string"
    docs = make_docs([(r[0], r[1], "x", 1, "y") for r in odd_rows], schema)
    rows = packing.pack(packing.pieces(docs, PATH)).collect()
    want = Counter()
    for r in odd_rows:
        ids = tokens(tokenizer, r[1])
        want.update((r[0], k, min(4096, len(ids) - a)) for k, a in enumerate(range(0, len(ids), 4096)))
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in rows) == want
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert packing.pack(packing.pieces(make_docs([], schema), PATH)).count() == 0
