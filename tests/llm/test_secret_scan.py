import re

import numpy as np
from llm_fixtures import make_docs, odd_rows, prose  # noqa: F401

from prefixdex.llm import secret_scan as X

PATTERN = re.compile(X.CANDIDATE)


def brute(rows):
    return sorted(((r[0], m.start(), m[0]) for r in rows for m in PATTERN.finditer(r[1] or "")), key=str)


def _rows(n):
    rng = np.random.default_rng(7)
    out = []
    for i in range(n):
        value = "".join(rng.choice(list("0123456789abcdef"), 40))
        digits = "4" + "".join(rng.choice(list("0123456789"), 15))
        out.append((i, f'{prose(i, 30)} token = "{value}" é {prose(i + 1, 5)} {digits} {prose(i, 9)}', "en", f"s{i % 4}"))
    return out


def test_candidates_match_brute_force(make_docs, odd_rows):
    rows = _rows(20) + [(99, "\u0001abcdefghij0123456789\u0001 A1" + "b" * 400 + "=="), *odd_rows]
    got = X.candidates(make_docs([r[:4] for r in rows])).collect()
    assert sorted([(r.doc_id, r.start, r.candidate) for r in got], key=str) == brute(rows)


def test_forest_separates_findings(make_docs):
    out = X.scan(make_docs(_rows(120)), min_count=3).collect()
    assert len(out) == 240
    assert all(r.is_secret == (len(r.candidate) == 40) for r in out)


def test_given_labels(make_docs):
    docs = make_docs(_rows(60))
    found = X.candidates(docs)
    labels = found.selectExpr("doc_id", "start", "cast(length(candidate) = 16 as int) as label")
    assert all(r.is_secret == (len(r.candidate) == 16) for r in X.scan(docs, labels, min_count=3).collect())


def test_without_labels_all_findings_stay(make_docs, odd_rows):
    docs = make_docs([*odd_rows, (50, "key abcdef0123456789abcdef")])
    out = X.scan(docs).collect()
    assert [(r.doc_id, r.score, r.is_secret) for r in out] == [(50, None, True)]
    assert X.scan(make_docs([])).count() == 0


def test_no_python_in_the_plan(make_docs):
    docs = make_docs(_rows(40))
    words = X.dictionary(docs, 2)
    rows = X.features(X.candidates(docs), words, X.transitions(words))
    plan = X.judge(rows, X.train(X.label_findings(rows)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def _planted(n):
    """(doc_id, text, lang, source) with a secret each, and (doc_id, form, secret)."""
    rng = np.random.default_rng(9)
    kinds = "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ"
    draw = lambda k, of: "".join(rng.choice(list(of), k))
    forms = {
        "quoted": lambda: ('api_key = "', draw(32, "0123456789abcdef"), '"'),
        "unquoted": lambda: ("API_KEY=", draw(24, kinds + "0123456789") + "7", ""),
        "yaml short": lambda: ("password: ", draw(9, kinds) + "4", ""),
        "punctuation": lambda: ("db_password=", f"P@ss{draw(4, kinds)}!{draw(3, '0123456789')}:x", ""),
        "letters": lambda: ('secret: "', draw(28, kinds), '"'),
        "letters alone": lambda: ("", "aBcDeF" + draw(26, kinds), ""),
        "prefix": lambda: ("use ", "ghp_" + draw(36, kinds), ""),
    }
    rows, want = [], []
    for i in range(n):
        form = list(forms)[i % len(forms)]
        before, secret, after = forms[form]()
        digits = "4" + draw(15, "0123456789")
        rows.append((i, f"{prose(i, 20)} {before}{secret}{after} {prose(i + 1, 5)} {digits} {prose(i, 9)}", "en", f"s{i % 4}"))
        want.append((i, form, secret))
    return rows, want


def test_secrets_of_every_form_are_found(make_docs):
    rows, want = _planted(210)
    out = {(r.doc_id, r.candidate): r.is_secret for r in X.scan(make_docs(rows), min_count=3).collect()}
    forms = {}
    for i, form, secret in want:
        found, kept = forms.setdefault(form, ([], []))
        found.append((i, secret) in out), kept.append(out.get((i, secret), False))
    recall = {f: (sum(a) / len(a), sum(b) / len(b)) for f, (a, b) in forms.items()}
    print("recall of candidates, verdicts:", recall)
    assert all(a == 1 and b >= 0.9 for a, b in recall.values()), recall
    assert not any(v for (_, c), v in out.items() if c.isdigit())


def test_equal_rows_are_judged_alike_however_often_they_occur(make_docs):
    rows = _rows(60)
    one = {(r.doc_id, r.start): tuple(r) for r in X.features(X.candidates(make_docs(rows)), *_learned(make_docs(rows))).collect()}
    more = X.features(X.candidates(make_docs(rows + rows[:5] * 3 + [(None, *r[1:]) for r in rows[:2]] * 2)), *_learned(make_docs(rows))).collect()
    assert len(more) == len(one) + 3 * 10 + 2 * 4
    for r in more:
        assert r.doc_id is None or tuple(r) == one[r.doc_id, r.start]
        assert r.paired <= 1 and r.coverage <= 1


def _learned(docs):
    words = X.dictionary(docs, 2)
    return words, X.transitions(words)


def test_revisions_checksums_and_uuids_are_taken_out(make_docs):
    rng = np.random.default_rng(3)
    draw = lambda k, of="0123456789abcdef": "".join(rng.choice(list(of), k))
    rows, bad = [], set()
    for i in range(200):
        token, plain = draw(40), [f"commit {draw(40)}", f"md5: {draw(32)}", "-".join(map(draw, (8, 4, 4, 4, 12)))][i % 3]
        rows.append((i, f'{prose(i, 20)} api_key = "{token}" {prose(i + 1, 12)} {plain} {prose(i + 2, 8)}', "en", "a"))
        bad.add((i, plain.split()[-1]))
    out = X.scan(make_docs(rows), min_count=3).collect()
    judged = {(r.doc_id, r.candidate): r.is_secret for r in out}
    taken = sum(not judged[b] for b in bad) / len(bad)
    kept = [v for k, v in judged.items() if k not in bad]
    precision = sum(kept) / (sum(kept) + sum(judged[b] for b in bad))
    print("false positives taken out:", taken, "secrets kept:", sum(kept) / len(kept), "precision:", precision)
    assert taken >= 0.95 and sum(kept) / len(kept) >= 0.95


def test_candidates_of_every_form_match_brute_force(make_docs):
    rows, _ = _planted(70)
    rows += [(900, "Secret_Key := 'a b' pwd=>\"x;yzzzzzzzz\" key=AKIA" + "Q" * 20), (901, "p" * 300_000 + " password: " + "Zz9" * 90_000)]
    pattern = re.compile(X.ANY.replace("(?i:", "(?i:"))
    want = [(r[0], m.start(m.lastindex if m[2] is None else 2), m[2] or m[3]) for r in rows for m in pattern.finditer(r[1])]
    got = [(r.doc_id, r.start, r.candidate) for r in X.candidates(make_docs([r if len(r) == 4 else (*r, "en", "a") for r in rows])).collect()]
    assert sorted(got) == sorted(want)


def test_label_evidence_is_no_feature(make_docs):
    assert not {"assigned", "quoted", "in_address"} & set(X.FEATURES)
    docs = make_docs([(1, "x password = 'abcdef0123456789abcdef' y"), (2, "x nothing = 'abcdef0123456789abcdef' y"), (3, "x API_KEY=abcdef0123456789abcdef y")])
    words = X.dictionary(docs, 1)
    rows = X.features(X.candidates(docs), words, X.transitions(words))
    assert {r.doc_id: r.label for r in X.label_findings(rows).collect()} == {1: 1.0, 3: 1.0}
