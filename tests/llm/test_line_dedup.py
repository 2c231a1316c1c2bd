import re

import pytest
from pyspark.sql import functions as F
from llm_fixtures import make_docs, odd_rows  # noqa: F401

from prefixdex.llm import cuckoo
from prefixdex.llm import line_dedup as L

EDGE = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(EDGE))


def brute(rows):
    held = {}
    for k, r in enumerate(rows):
        for x in {key(x) for x in (r[1] or "").split("\n")}:
            if len(x) >= 20:
                held.setdefault(x, []).append(-(1 << 63) if r[0] is None else r[0])
    out = []
    for r in rows:
        own = -(1 << 63) if r[0] is None else r[0]
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), [])) < 3 or max(held[key(x)]) == own]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


LONG = "This line is long enough to be looked at"
ROWS = [
    (1, f"{LONG}\nown one\n{LONG.upper()}  \n"), (2, f"x\n\t{LONG}\ny"), (3, f"{LONG}"), (4, "short\nshort"), (5, "short"), (6, "short"),
    (7, "ünïcode line of twenty\r\nb"), (8, "Ünïcode line of twenty"), (9, "ünïcode line of twenty"), (9, "ünïcode LINE of twenty"), (10, None), (11, ""),
]


def collected(df):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()], key=str)


def test_matches_brute_force(make_docs, odd_rows):
    assert collected(L.dedup(make_docs(ROWS))) == brute(ROWS)
    assert collected(L.dedup(make_docs(odd_rows))) == brute(odd_rows)


OWN = "an own line nobody else has at all"


@pytest.mark.parametrize("probe", [2_000_000, 3])
def test_rows_that_share_an_id_keep_their_own_lines(make_docs, monkeypatch, probe):
    monkeypatch.setattr(L, "PROBE_ROWS", probe)
    rows = [(1, LONG), (2, LONG), (9, LONG), (9, OWN), (12, LONG), (None, f"x\n{LONG}"), (None, OWN + "!"), (None, f"{LONG}\n{OWN}?"), (2, LONG)]
    schema = "doc_id long, text string, __id string, n_lines string, holder string, shard string"
    out = L.dedup(make_docs([(*r, "i", "n", "h", "s") for r in rows], schema))
    assert out.columns == ["doc_id", "text", "__id", "holder", "shard", "n_lines", "n_dropped", "kept_text"]
    assert collected(out) == brute(rows)


def test_one_line_in_all_documents_and_a_very_long_text(make_docs, monkeypatch):
    monkeypatch.setattr(L, "PROBE_ROWS", 900)
    monkeypatch.setattr(L, "SHARD_KEYS", 2)
    rows = [(i, f"{LONG}\nthe own line of document number {i}\nshared by some {i % 60} of the documents") for i in range(400)]
    rows += [(500, "\n".join([LONG, "x" * 3_000_000, *(f"line {i} of a text with very many lines" for i in range(20_000))]))]
    assert collected(L.dedup(make_docs(rows))) == brute(rows)
    # The lines of the frequent one's shard are dealt over several groups, the others' are not.
    counts = L.insert(None, make_docs(rows))[1]
    shards = L.shards_for(counts)
    spread = {r.shard: r.spread for r in L.spreads(counts, shards).collect()}
    assert 1 <= len(spread) < shards / 2


def test_empty_table(make_docs):
    assert L.dedup(make_docs([])).count() == 0


def _state(df):
    return sorted((bytes(r.key), r.n_docs, r.holder) for r in df.collect())


def test_deletion_takes_insertion_back(make_docs):
    first, second = make_docs(ROWS[:4]), make_docs(ROWS[4:])
    one = L.insert(None, first)
    both = L.insert(one, second)
    assert _state(both[1]) == _state(L.insert(None, make_docs(ROWS))[1])
    back = L.delete(both, second.select("doc_id"))
    assert _state(back[1]) == _state(one[1])
    # The holder goes: the next largest id holds the line.
    left = L.delete(both, make_docs([(3, None)]).select("doc_id"))
    assert _state(left[1]) == _state(L.insert(None, make_docs([r for r in ROWS if r[0] != 3]))[1])


def test_filters_follow_the_counts(make_docs, spark):
    one, both = L.insert(None, make_docs(ROWS[:4])), L.insert(None, make_docs(ROWS))
    filters = L.build_filters(one[1], 2)
    grown = L.update_filters(filters, one[1], both[1], 2)
    shrunk = L.update_filters(grown, both[1], one[1], 2)
    for held, counts in ((grown, both[1]), (shrunk, one[1])):
        probe = both[1].select("key", F.col("holder").alias("doc_id"), F.col("key").alias("row"), F.lit(0).alias("pos"))
        spread = spark.createDataFrame([(0, 3)], "shard int, spread int")
        found = {bytes(r.key) for r in L.maybe_repeated(probe, held, 2, spread).collect()}
        assert found == {bytes(r.key) for r in counts.where("n_docs >= 3").collect()}


def test_cuckoo_filter():
    import numpy as np

    rng = np.random.default_rng(1)
    keys, others = rng.integers(-(1 << 63), 1 << 62, 5000), rng.integers(-(1 << 63), 1 << 62, 50_000)
    made = cuckoo.build(keys)
    assert made.contains(keys).all() and made.contains(others).mean() < 0.01
    made.delete(keys[:2500])
    assert made.contains(keys[2500:]).all() and made.contains(keys[:2500]).mean() < 0.01
    again = cuckoo.CuckooFilter.load(made.dump())
    assert (again.table == made.table).all()
