"""Stored keys on the ring: only what a change of the ring moves is read and written."""

import re

import pytest

from prefixdex.operators import ring
from prefixdex.plans import placement
from prefixdex.sources import store

NODES = ["a", "b", "c"]


def _keys(spark, n=3000):
    return spark.range(n).selectExpr("concat('sug:count:k', id) AS key")


def _owned(spark, keys, nodes):
    return sorted((r["key"], r["node"]) for r in ring.assign_owner(keys, "key", ring.ring_table(spark, nodes)).collect())


def _stored(spark, root):
    return sorted((r["key"], r["node"]) for r in placement.read(spark, root).collect())


def test_nodes_join_and_leave(spark, tmp_path):
    root, keys = str(tmp_path / "keys"), _keys(spark)
    placement.create(keys.unionByName(keys), root, ring.ring_table(spark, NODES))
    assert _stored(spark, root) == _owned(spark, keys, NODES)
    steps = [["a", "b", "c", "d"], ["b", "c", "d"], ["a", "b", "c"], ["a", "b", "c"]]
    before = NODES
    for version, nodes in enumerate(steps, 1):
        rings = [ring.ring_table(spark, n) for n in (before, nodes)]
        new, gone = [n for n in nodes if n not in before], [n for n in before if n not in nodes]
        want = ring.remap_report(keys, "key", *rings, new, gone).first().asDict()
        moved, _ = placement.moves(spark, root, rings[1])
        assert placement.rebalance_report(moved, 3000, tuple(new), tuple(gone)).first().asDict() == want
        assert placement.rebalance(spark, root, rings[1], version)
        assert placement.rebalance(spark, root, rings[1], version) is False  # replayed
        assert store.read_version(spark, f"{root}/rows", version).count() == want["moved"]
        assert _stored(spark, root) == _owned(spark, keys, nodes)
        before = nodes
    assert placement.compact(spark, root, 5) and not placement.compact(spark, root, 5)
    assert placement.versions(spark, root) == [5] and _stored(spark, root) == _owned(spark, keys, before)
    assert placement.rebalance(spark, root, ring.ring_table(spark, ["a", "d"]), 6)
    assert _stored(spark, root) == _owned(spark, keys, ["a", "d"])


def test_the_filter_on_the_hash_reaches_the_files(spark, tmp_path):
    root = str(tmp_path / "keys")
    placement.create(_keys(spark), root, ring.ring_table(spark, NODES, 3))
    moved, changed = placement.moves(spark, root, ring.ring_table(spark, [*NODES, "d"], 3))
    plan = moved._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(hash,", plan)
    assert changed.count() <= 3 + 1 and 0 < moved.count() < 3000


def test_a_crash_before_the_rows_is_made_up_for(spark, tmp_path):
    root, keys = str(tmp_path / "keys"), _keys(spark, 400)
    placement.create(keys, root, ring.ring_table(spark, NODES))
    after = ring.ring_table(spark, ["a", "b"])
    store.write_version(placement._everything(spark), f"{root}/changed", 1, "lo", 1)
    store.write_version(ring.owner_intervals(after), f"{root}/rings", 1, "lo", 1)
    assert _stored(spark, root) == _owned(spark, keys, NODES)
    assert placement.rebalance(spark, root, after, 1) and _stored(spark, root) == _owned(spark, keys, ["a", "b"])


def test_covering_ranges_are_few_and_hold_all(spark, monkeypatch):
    monkeypatch.setattr(placement, "MAX_RANGES", 4)
    pieces = [(i * 100, i * 100 + 10 + i) for i in range(20)] + [(1990, 1991)]
    ranges = placement._covering(spark.createDataFrame(pieces, "lo long, hi long"))
    assert len(ranges) == 4 and all(any(a <= lo and hi <= b for a, b in ranges) for lo, hi in pieces)
    assert placement._covering(spark.createDataFrame([], "lo long, hi long")) == []


@pytest.mark.parametrize("nodes", [["a"], ["z", "a", "m"]])
def test_changed_intervals_are_where_owners_differ(spark, nodes):
    old, new = (ring.owner_intervals(ring.ring_table(spark, n, 5)) for n in (["a", "b"], nodes))
    iv = [(r.lo, r.hi, r.old, r.new) for r in placement.changed_intervals(old, new).collect()]
    own = [[(r.lo, r.hi, r.node) for r in t.collect()] for t in (old, new)]
    at = lambda t, h: next(n for lo, hi, n in t if lo < h <= hi)
    for h in {0, (1 << 32) - 1, *(x for t in own for lo, hi, _ in t for x in (hi, hi + 1, max(hi - 1, 0)) if x < 1 << 32)}:
        inside = [(o, n) for lo, hi, o, n in iv if lo < h <= hi]
        a, b = at(own[0], h), at(own[1], h)
        assert inside == ([(a, b)] if a != b else [])
