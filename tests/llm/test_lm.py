import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm_fixtures import make_docs, odd_rows  # noqa: F401

from prefixdex.llm import lm


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows):
    counts = {}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    for i, t in rows:
        if not held(i):
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((i, held(i), len(w), sum(x in counts for x in w), n, round(base, 6)))
    return sorted(out, key=str)


def test_counts_and_base_match_brute_force(make_docs, odd_rows, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for rows in ([r[:2] for r in odd_rows], [tuple(r) for r in docs.collect()], [(12, "only one")]):
        got = lm.score(make_docs(rows), bucket_bytes=200_000).collect()
        assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=str) == brute(rows)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(make_docs([])).count() == 0


def test_model_beats_the_unigrams_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    s = lm.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert s[0] > s[1] and s[2] > 0.9


def _net():
    rng = np.random.default_rng(1)
    net = lm.LogBilinear.start(rng.dirichlet(np.ones(20)), 6)
    net.flat[:] = rng.normal(0, 0.7, len(net.flat))
    return net


def test_probabilities_are_normalised():
    net = _net()
    symbol, one, two = np.arange(20), np.full(20, 20), np.full(20, 3)
    assert np.exp(net.log_probabilities(symbol, one, two)).sum() == pytest.approx(1, abs=1e-5)


def _symbols(n_words=3000, head=40, seed=3):
    """Words with counts, some of each class outside the vocabulary."""
    rng = np.random.default_rng(seed)
    keys = np.unique(rng.integers(0, 1 << 63, n_words, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    counts = (5 + 5000 / np.arange(1, len(keys) + 1)).astype(np.int64)
    known = rng.random(len(keys)) < 0.8
    by_class = np.bincount(lm._class(keys), counts, lm.CLASSES).astype(np.int64), np.bincount(lm._class(keys), minlength=lm.CLASSES)
    return lm.Symbols(keys[known], counts[known], 70, *by_class, head=head), keys, counts, known


def test_probabilities_over_all_words_sum_to_one():
    symbols, keys, counts, known = _symbols()
    net = lm.LogBilinear.start(symbols.frequencies(), 6, starts=symbols.starts, within=symbols.within)
    net.flat[:] = np.random.default_rng(1).normal(0, 0.5, len(net.flat))
    assert len(symbols.within) > 2000 and len(symbols.starts) > 40
    unit, one, two, _, own = symbols.sequence(keys, np.zeros(len(keys), int), 1)
    for a, b in ((3, symbols.begin), (int(own[7]), int(own[-5])), (symbols.begin, symbols.begin)):
        p = np.exp(net.log_probabilities(unit, np.full(len(unit), a), np.full(len(unit), b)))
        of = lm._class(keys)
        inside = (counts + 0.1) / (symbols.n_other[of] + 0.1 * (symbols.v_other[of] + 1))
        unseen = np.exp(net.log_probabilities(symbols.other + np.arange(lm.CLASSES), np.full(lm.CLASSES, a), np.full(lm.CLASSES, b)))
        unseen = (unseen * 0.1 / (symbols.n_other + 0.1 * (symbols.v_other + 1))).sum()
        assert np.where(known, p[:-1], p[:-1] * inside).sum() + p[-1] + unseen == pytest.approx(1, abs=1e-4)


def test_vocabulary_holds_every_word_above_a_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = lm.count_words(docs, 3).checkpoint()
    got = {least: lm.frequent_words(counts, least) for least in (5, 40)}
    whole = [(w, n) for r in counts.collect() for w, n in zip(np.frombuffer(r.words, np.uint64), np.frombuffer(r.counts, np.int64), strict=True)]
    for least, (keys, n) in got.items():
        assert sorted(zip(keys, n, strict=True)) == sorted(x for x in whole if x[1] >= least)
    assert len(got[5][0]) > 9 * len(got[40][0]) > 5000


def test_words_in_runs_are_learned():
    """Each word follows one other: within a run too, the model tells which."""
    rng = np.random.default_rng(4)
    keys = np.arange(1, 61, dtype=np.uint64)
    follows = rng.permutation(60)
    seq = [0]
    for _ in range(40_000):
        seq.append(int(follows[seq[-1]]) if rng.random() < 0.9 else int(rng.integers(60)))
    n = np.bincount(seq, minlength=60)
    by_class = np.bincount(lm._class(keys), n, lm.CLASSES).astype(np.int64), np.bincount(lm._class(keys), minlength=lm.CLASSES)
    symbols = lm.Symbols(keys, n, 1, *by_class, head=4)
    unit, one, two, _, _ = symbols.sequence(keys[seq], np.zeros(len(seq), int), 1)
    net = lm.LogBilinear.start(symbols.frequencies(), 12, starts=symbols.starts, within=symbols.within)
    trainer = lm.Trainer(net, symbols.frequencies(), 0, symbols.within)
    before = net.log_probabilities(unit, one, two).mean()
    for _ in range(40):
        for lo in range(0, len(unit), 1024):
            trainer.step(unit[lo : lo + 1024], one[lo : lo + 1024], two[lo : lo + 1024])
    best = 0.9 * np.log(0.9) + 0.1 * np.log(0.1 / 60)
    assert net.log_probabilities(unit, one, two).mean() - before > 0.6 * (best - before)


def test_changes_of_copies_are_averaged_by_how_often_they_met_a_word(monkeypatch):
    monkeypatch.setattr(lm, "_ROWS", 16)
    symbols, keys, _, _ = _symbols(300)
    start = lm.LogBilinear.start(symbols.frequencies(), 4, starts=symbols.starts, within=symbols.within)
    tables, copies = {}, []
    for task in range(3):
        copy = lm.LogBilinear(start.flat.copy(), symbols.size, 4, symbols.starts)
        trainer = lm.Trainer(copy, symbols.frequencies(), task, symbols.within)
        unit, one, two, _, _ = symbols.sequence(np.random.default_rng(task).choice(keys, 90), np.zeros(90, int), 1)
        for lo in range(0, 90, 30):
            trainer.step(unit[lo : lo + 30], one[lo : lo + 30], two[lo : lo + 30])
        copies.append(trainer)
        for r in lm._changes(task, start, trainer).to_pylist():
            tables.setdefault(r["chunk"], []).append(r)
    weight = sum(t.met for t in copies)
    want = sum((t.model.rows - start.rows) * t.met[:, None] for t in copies) / np.maximum(weight, 1)[:, None]
    got = np.zeros_like(want)
    for chunk, rows in tables.items():
        out = lm._added_changes((lm.pa.scalar(chunk), lm.pa.scalar(0)), lm.pa.Table.from_pylist(rows)).to_pylist()[0]
        w, body = np.frombuffer(out["weight"], np.float32), np.frombuffer(out["body"], np.float32)
        if chunk >= 0:
            got[np.frombuffer(out["ids"], np.int64)] = body.reshape(len(w), -1) / w[:, None]
    assert len(tables) > 5 and np.allclose(got, want, atol=1e-5)


def test_training_approaches_the_data():
    rng = np.random.default_rng(2)
    follows = rng.dirichlet(np.ones(8) * 0.3, 8)
    seq = [0]
    for _ in range(60_000):
        seq.append(int(rng.choice(8, p=follows[seq[-1]])))
    seq = np.array(seq)
    freq = np.bincount(seq, minlength=8) / len(seq)
    trainer = lm.Trainer(lm.LogBilinear.start(freq, 8), freq, 0)
    one, two, symbol = seq[1:-1], seq[:-2], seq[2:]
    before = trainer.model.log_probabilities(symbol, one, two).mean()
    for _ in range(20):
        for lo in range(0, len(symbol), 1024):
            trainer.step(symbol[lo : lo + 1024], one[lo : lo + 1024], two[lo : lo + 1024])
    after = trainer.model.log_probabilities(symbol, one, two).mean()
    best = np.log(follows[one, symbol]).mean()
    assert after - before > 0.8 * (best - before)


def test_tables_of_steps_and_slots_find_what_a_search_finds():
    rng = np.random.default_rng(6)
    for counts in ([1], [5, 1, 1, 900_000, 3], rng.integers(1, 9, 3000), rng.zipf(1.3, 20_000).clip(1, 10**7)):
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(float)
        values = np.concatenate([bounds, np.nextafter(bounds[1:], 0), rng.random(5000) * bounds[-1]])
        assert (lm._Steps(bounds).places(values) == np.searchsorted(bounds, values, "right")).all()
    places = lm._Places(500)
    for _ in range(3):
        ids = rng.integers(0, 500, 200)
        for got, want in zip(places.distinct(ids), np.unique(ids, return_inverse=True), strict=True):
            assert (got == want).all()
    symbols, keys, _, known = _symbols()
    units = symbols.known(keys, np.full(len(keys), -1))
    assert (np.flatnonzero(units >= 0) == np.flatnonzero(known)).all() and len(np.unique(units[known])) == known.sum()
    none = lm.Symbols(keys[:0], np.zeros(0, np.int64), 1, np.zeros(lm.CLASSES, np.int64), np.zeros(lm.CLASSES, np.int64))
    assert (none.known(keys, np.full(len(keys), -1)) == -1).all()


def test_sums_of_pieces_are_those_of_the_whole():
    rng = np.random.default_rng(9)
    pieces = [rng.normal(size=(4, n)).astype(np.float32) for n in (5, 0, 400, 31)]
    back = rng.integers(0, 20, 436)
    got, whole = lm._sums(back, pieces, 21), np.concatenate(pieces, 1)
    assert got.dtype == np.float32 and (got == [np.bincount(back, row, 21).astype(np.float32) for row in whole]).all()


def test_contexts_are_made_of_what_each_unit_gives():
    symbols, keys, _, _ = _symbols(400)
    net = lm.LogBilinear.start(symbols.frequencies(), 6, starts=symbols.starts, within=symbols.within)
    net.flat[:] = np.random.default_rng(2).normal(0, 0.5, len(net.flat))
    before, far = net.parts()
    inside = net.size + 1 + np.arange(len(symbols.within))
    whole = net.r.copy()
    whole[inside] += net.r[net.symbols(inside)]
    assert np.allclose(before, whole @ net.c1, atol=1e-5) and np.allclose(far, whole @ net.c2, atol=1e-5)


def test_training_gets_texts_in_bounded_batches(spark, make_docs, monkeypatch):
    saved, save = {}, lm.tables.save

    def spy(df, name):
        saved[name] = df.columns
        return save(df, name)

    monkeypatch.setattr(lm.tables, "save", spy)  # it limits what Python is handed at a time
    assert lm.score(make_docs([(i, f"word{i % 7} a b") for i in range(60)])).count() == 60
    assert saved["model"] == ["chunk", "part", "ids", "body", "weight"]
