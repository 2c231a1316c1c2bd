import itertools
from fractions import Fraction

import pytest
from llm_fixtures import make_docs, odd_rows  # noqa: F401

from prefixdex.llm import mixing as M


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 3, "c": 2}, {f"s{i}": 1 + i**2 for i in range(40)}])
def test_each_source_is_within_a_block_of_its_weight(weights):
    given = M.shares(weights, 200)
    period = sum(given.values())
    done = dict.fromkeys(given, 0)
    for s, j, slot, release, deadline in M.schedule(given):
        assert j == done[s] and release <= slot < deadline
        done[s] += 1
        for x, n in done.items():
            assert abs(n - given[x] * (slot + 1) / period) < 1
    assert done == given
    whole = sum(weights.values())
    assert all(abs(given[s] - weights[s] * period / whole) <= max(1, len(weights) / 10) for s in weights)


def test_every_document_is_placed_and_prefixes_follow_the_weights(make_docs):
    rows = [(i, f"t{i}", None, "big" if i % 3 else ("x" if i % 2 else None)) for i in range(700)]
    out = M.mix(make_docs(rows), block=4, period=60).collect()
    assert {r.doc_id for r in out} == set(range(700))
    assert sorted(r.position for r in out) == list(range(len(out)))
    sizes = {s: sum(r[3] == s for r in rows) for s in ("big", "x", None)}
    given = M.shares({str(s): n**M.ALPHA for s, n in sizes.items()}, 60)
    blocks = dict.fromkeys(given, 0)
    out.sort(key=lambda r: r.position)
    for slot, group in itertools.groupby(out, key=lambda r: r.slot):
        group = list(group)
        assert len(group) == 4 and len({r.source for r in group}) == 1 and group[0].release <= slot < group[0].deadline
        blocks[str(group[0].source)] += 1
        for s, n in blocks.items():
            assert abs(n - given[s] * (slot + 1) / 60) < 1
    for s in sizes:  # copies of a source's documents differ by one at most
        counts = {}
        for r in out:
            if r.source == s:
                counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
        assert max(counts.values()) - min(counts.values()) <= 1
    # The mixture ends with the last document: one source begins no new turn but to fill its block.
    assert any(sum(r.epoch > 0 for r in out if r.source == s) < 4 for s in sizes)


def test_given_weights(make_docs):
    rows = [(i, "t", None, "a" if i < 90 else "b") for i in range(100)]
    out = M.mix(make_docs(rows), weights={"a": 0.5, "b": 0.5}, block=2, period=10).collect()
    n = {s: sum(r.source == s for r in out) for s in "ab"}
    assert abs(n["a"] - n["b"]) <= 2 and n["a"] >= 90


def test_odd_rows_and_columns(make_docs, odd_rows):
    docs = make_docs([(*r, 9, "e") for r in odd_rows], "doc_id long, text string, lang string, source string, n_chars long, slot int, epoch string")
    out = M.mixed(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in docs.collect()} and len(got) >= len(odd_rows)
    assert M.mixed(make_docs([])).count() == 0


@pytest.mark.parametrize("sizes", [[10**6] + [10] * 3, [10**6] + [10] * 5, [3_300_000] + [350_000] * 19 + [500] * 50 + [20]])
def test_tiny_sources_beside_a_hot_one_keep_a_slot(sizes):
    given = M.shares({f"s{i}": n**M.ALPHA for i, n in enumerate(sizes)})
    assert min(given.values()) >= 1 and sum(given.values()) == M.PERIOD
    assert {s for s, *_ in M.schedule(given)} == set(given)


def test_sources_keep_to_their_target_weights_over_the_whole_length(make_docs):
    sizes = {"big": 6000, **{f"s{i}": 2 for i in range(40)}}
    rows = [(f"{s}-{i}", None, None, s) for s, n in sizes.items() for i in range(n)]
    out = M.mix(make_docs(rows, "doc_id string, text string, lang string, source string"), block=2).collect()
    weights = {s: Fraction(n**M.ALPHA) for s, n in sizes.items()}
    whole = sum(weights.values())
    blocks, copies = dict.fromkeys(sizes, 0), dict.fromkeys((r[0] for r in rows), 0)
    assert sorted(r.position for r in out) == list(range(len(out)))
    for slot, s in enumerate(r.source for r in sorted(out, key=lambda r: r.position)[::2]):
        # A source is furthest from its weight just before and after it has a slot.
        assert -1 < blocks[s] - weights[s] / whole * slot
        blocks[s] += 1
        assert blocks[s] - weights[s] / whole * (slot + 1) < 1
    for s, n in blocks.items():
        assert abs(n - weights[s] / whole * (slot + 1)) < 1
    for r in out:
        copies[r.doc_id] += 1
    for s, _, _, source in rows:
        assert abs(copies[s] - weights[source] / whole * len(out) / sizes[source]) < 2


def test_chunks_go_on_where_the_schedule_stands():
    given = M.whole_weights({f"s{i}": (1 + i) ** 0.7 for i in range(9)})
    pieces, done = M.chunks(given, {s: 60 + i for i, s in enumerate(given)}, size=100)
    run = M._blocks(given, dict.fromkeys(given, 0), 0)
    for first, n, before in pieces:
        part = M._blocks(given, dict(zip(given, before, strict=True)), first)
        assert list(itertools.islice(part, n)) == list(itertools.islice(run, n))
    assert len(pieces) > 2 and sum(done.values()) == first + n and all(done[s] >= 60 + i for i, s in enumerate(given))


def test_rows_alike_in_every_column_have_a_turn_each(make_docs):
    rows = [(7, "t", "en", "a")] * 9 + [(None, None, None, None)] * 5 + [(None, "u", None, None), (7, "t", "en", "b")] * 2
    docs = make_docs(rows)
    placed = M.mix(docs, block=2).collect()
    assert sorted(r.position for r in placed) == list(range(len(placed)))
    first = sorted([(r.doc_id, r.text, r.lang, r.source) for r in placed if r.epoch == 0], key=str)
    assert first == sorted(rows, key=str)


def test_very_many_sources(spark):
    docs = spark.range(300_000).selectExpr("id as doc_id", "if(id < 100000, 'hot', concat('s', id)) as source")
    out = M.mix(docs)
    r = out.selectExpr("count(*)", "count(distinct doc_id)", "count(distinct position)", "max(position)", "count_if(slot < release or slot >= deadline)").first()
    assert r[1] == 300_000 and r[0] == r[2] and r[4] == 0


def test_a_weight_of_zero_is_refused():
    with pytest.raises(ValueError):
        M.whole_weights({"a": 1, "b": 0})
