import re

import pytest
from pyspark.sql import functions as F
from llm_fixtures import make_docs, odd_rows  # noqa: F401

from prefixdex.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


TEXTS = [None, "", " \n\t", "a b c d e f g h " * 3, "x " * 30, "l1 é#\nl1 é#\n\n\nl1 é# ", "q " * 9 + "a b c d e f g h i j a b c d e f g h", "one\x0btwo\x0cthree\rfour"]


def test_counts_match_brute_force(make_docs, odd_rows):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, r[1]) for i, r in enumerate(odd_rows)]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.measures(make_docs(rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_odd_rows_are_judged(make_docs, odd_rows):
    got = Q.score(make_docs(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert Q.score(make_docs([])).count() == 0


def _measured(make_docs, rates):
    rows = [(i, lang, source, 100, w, s, 0, 0, 10) for i, (lang, source, w, s) in enumerate(rates)]
    return make_docs(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_text_lines long")


def test_thresholds_follow_the_group(make_docs):
    rates = [("en", "plain", 500 + i % 40, 0) for i in range(300)] + [("en", "code", 500, 60 + i % 20) for i in range(300)] + [("en", "plain", 500, 70)]
    m = _measured(make_docs, rates)
    out = {r.doc_id: r for r in Q.judge(m, Q.fences(Q.sketches(m))).collect()}
    assert out[600].failed_rules == ["symbol_rate"] and not out[600].kept
    assert all(out[i].kept for i in range(600))


def test_each_rate_rejects_what_the_base_rules_let_pass(make_docs):
    """In a clean source: 27 % repeated words, half the lines said before, symbols, long words."""
    clean = [(i, "en", "a", 100, 500 + i % 30, 0, 0, 0, 40) for i in range(400)]
    bad = [(1000, "en", "a", 100, 510, 0, 0, 27, 40), (1001, "en", "a", 100, 510, 0, 20, 0, 40), (1002, "en", "a", 100, 510, 15, 0, 0, 40),
           (1003, "en", "a", 100, 900, 0, 0, 0, 40), (1004, "en", "a", 100, 200, 0, 0, 0, 40), (None, "en", "a", 100, 510, 0, 0, 27, 40)]
    m = make_docs(clean + bad + bad[:1], "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_text_lines long")
    out = [(r.doc_id, r.failed_rules) for r in Q.judge(m, Q.fences(Q.sketches(m))).collect() if not r.base_failed and not r.kept]
    assert sorted(out, key=str) == sorted([
        (1000, ["repeat_rate"]), (1000, ["repeat_rate"]), (1001, ["dup_line_rate"]), (1002, ["symbol_rate"]), (1003, ["word_length"]), (1004, ["word_length"]), (None, ["repeat_rate"]),
    ], key=str)


def test_sketches_merge(make_docs):
    rates = [("en", None if i % 7 == 0 else f"s{i % 3}", 400 + 3 * i, i % 50) for i in range(400)]
    m = _measured(make_docs, rates)
    whole = {tuple(r) for r in Q.merge(Q.sketches(m)).collect()}
    parts = [Q.sketches(m.where(F.col("doc_id") % 3 == k)) for k in range(3)]
    assert {tuple(r) for r in Q.merge(*parts).collect()} == whole


@pytest.mark.parametrize("n", [1, 5, 400])
def test_quantiles_are_within_a_percent(make_docs, n):
    values = [317 + 7 * i for i in range(n)]
    m = _measured(make_docs, [("en", "s", v, 0) for v in values])
    q = Q.quantiles(Q.sketches(m), ("lang", "source")).where("rate = 'word_length'").first()
    for name, p in (("low", 100 - Q.HIGH), ("mid", 50), ("high", Q.HIGH)):
        exact = sorted(values)[-(-p * n // 100) - 1]
        assert exact * 0.98 <= q[name] <= exact


def test_no_python_in_the_plan(make_docs):
    m = make_docs([(1, "a b"), (2, "c")])
    measured = Q.measures(m)
    plan = Q.judge(measured, Q.fences(Q.sketches(measured)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
