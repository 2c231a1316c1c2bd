import numpy as np
from llm_fixtures import make_docs, odd_rows  # noqa: F401

from prefixdex.llm import langid as G
from prefixdex.llm import queries


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    rows = found.collect()
    assert len(rows) > 300 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def _model(make_docs):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog with that thing " * 5, "en"), ("der hund und die katze nicht schön " * 5, "de"), ("unlabelled", None), (None, "en")] * 4)]
    return G.fit(G.count(make_docs(rows)))


def test_mixtures_and_odd_texts(make_docs):
    model = _model(make_docs)
    assert model.languages == ["de", "en"] and np.allclose(np.exp(model.table).sum(0), 1, atol=1e-3)
    en, de = "the cat and that dog ", "der hund und die katze "
    texts = [en * 10, de * 10, en * 12 + de * 6, None, "", " 12 !? ", "the", en * 3000]
    got = {r.doc_id: r for r in G.predict(make_docs(list(enumerate(texts)) + [(0, en * 10), (None, "die katze")]), model).collect()}
    assert [got[i].lang_pred for i in range(8)] == ["en", "de", "en", "und", "und", "und", "en", "en"]
    assert got[2].languages == ["de", "en"] and abs(got[2].score - 2 / 3) < 0.05
    assert got[0].score == 1 and got[3].score == 0 and got[None].lang_pred == "de"


def test_proportions_match_plain_em():
    rng = np.random.default_rng(3)
    logs = rng.normal(-20, 4, (50, 3)).astype(np.float32)
    p = np.full(3, 1 / 3)
    for _ in range(G.STEPS):
        r = np.exp(logs - logs.max(1, keepdims=True)) * p
        r /= r.sum(1, keepdims=True)
        p = r.mean(0)
    got = G.infer(logs, np.zeros(50, int), 2, weight=0)
    assert np.allclose(got[0], p, atol=1e-5) and not got[1].any()


def test_texts_without_spaces_and_very_long_words(make_docs):
    model = _model(make_docs)
    en, de = "thecatandthedogwiththatthing", "derhundunddiekatzenichtschön"
    big = (en * 700_000)[:20_000_000]
    got = {r.doc_id: r for r in G.predict(make_docs([(1, en * 40 + de * 40), (2, big), (3, "a" * 9), (4, en * 200 + " " + de)]), model).collect()}
    assert got[1].languages == ["de", "en"] and abs(got[1].score - 0.5) < 0.1
    assert got[2].lang_pred == "en" and got[4].lang_pred == "en"


def test_observations_cover_every_word(monkeypatch):
    monkeypatch.setattr(G, "CELLS", 40)
    text = ("one two threeeeeeee " + "x" * 200 + " ") * 30
    data, offsets = np.frombuffer((text + "end").encode(), np.uint8), np.array([0, len(text), len(text), len(text) + 3])
    starts, ends = G.words.spans(data, offsets)
    for languages in (1, 4, 100):
        a, b = G.observations(offsets, starts, ends, languages)
        assert (a[1:] >= b[:-1]).all() and a[0] == 0 and (np.bincount(G.words.owners(offsets, a)) <= max(1, 40 // languages)).all()
        covered = np.zeros(len(data), bool)
        for x, y in zip(a, b, strict=True):
            covered[x:y] = True
        assert covered[~G.words.WS[data]].all()


def test_the_penalised_set_is_the_best_by_brute_force():
    """Backward selection finds the set that all subsets, each fitted by EM, are led by."""
    rng = np.random.default_rng(8)
    hits = 0
    for _ in range(40):
        mixed = rng.dirichlet(np.ones(3) * 0.6)
        logs = rng.normal(-20, 3, (80, 3))
        logs[np.arange(80), rng.choice(3, 80, p=mixed)] += 6
        best = None
        for held in range(1, 8):
            on = np.array([held >> k & 1 for k in range(3)], bool)
            p = on / on.sum()
            like = np.exp(logs - logs.max(1, keepdims=True))
            for _ in range(200):
                r = like * p
                p = (r / r.sum(1, keepdims=True)).mean(0)
            value = np.log((like * p).sum(1)).sum() - G.WEIGHT * 0.5 * np.log(81) * on.sum()
            best = max(best or (-np.inf, None), (value, tuple(on)))
        got = G.infer(logs.astype(np.float32), np.zeros(80, int), 1)[0] > 0
        hits += tuple(got) == best[1]
    assert hits >= 37


def test_nothing_labelled_and_empty_tables(make_docs):
    none = G.fit(G.count(make_docs([(1, "text", None)])))
    assert [r.lang_pred for r in G.predict(make_docs([(1, "text")]), none).collect()] == ["und"]
    assert G.predict(make_docs([]), _model(make_docs)).count() == 0


def test_rows_with_a_language_stay_whole(make_docs, odd_rows):
    docs = make_docs([(*r, "x") for r in odd_rows], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string")
    kept = G.keep_known(docs, _model(make_docs))
    assert kept.columns == docs.columns
    want = [tuple(r) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
