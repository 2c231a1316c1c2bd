import bisect
import hashlib

import pytest

from pyspark.sql import functions as F

from prefixdex.operators import ring


def _keys(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def _owners(spark, nodes, keys):
    r = ring.ring_table(spark, nodes)
    return {row.key: row.node for row in ring.assign_owner(_keys(spark, keys), "key", r).collect()}


def _py_owner(nodes, key, vnodes=150):
    h = lambda s: int.from_bytes(hashlib.md5(s.encode()).digest()[:4], "big")
    entries = sorted((h(f"{n}#{i}"), o) for o, n in enumerate(nodes) for i in range(vnodes))
    hashes = [e[0] for e in entries]
    i = bisect.bisect_left(hashes, h(key))
    return nodes[entries[i % len(entries)][1]]


def test_balance_over_three_nodes(spark):
    keys = [f"k{i}" for i in range(6000)]
    bal = {r.node: r["keys"] for r in ring.node_balance(ring.assign_owner(_keys(spark, keys), "key", ring.ring_table(spark, ["a", "b", "c"]))).collect()}
    assert set(bal) == {"a", "b", "c"} and all(v > 6000 * 0.2 for v in bal.values())


def test_deterministic(spark):
    keys = [f"x{i}" for i in range(200)]
    assert _owners(spark, ["a", "b", "c"], keys) == _owners(spark, ["a", "b", "c"], keys)


def test_add_node_moves_minority_only_to_it(spark):
    keys = _keys(spark, [f"k{i}" for i in range(5000)])
    r = ring.remap_report(keys, "key", ring.ring_table(spark, ["a", "b", "c"]), ring.ring_table(spark, ["a", "b", "c", "d"]), ["d"]).first()
    assert r.moved / r["keys"] < 0.4 and r.moved_elsewhere == 0


def test_single_node_and_empty_ring(spark):
    assert set(_owners(spark, ["solo"], ["anything", "x"]).values()) == {"solo"}
    with pytest.raises(ValueError):
        ring.ring_table(spark, [])


def test_matches_binary_search(spark):
    nodes = ["redis-0", "redis-1", "redis-2"]
    keys = [f"sug:count:{i * 7919}" for i in range(1000)]
    got = _owners(spark, nodes, keys)
    assert got == {k: _py_owner(nodes, k) for k in keys}


def _base36(n):
    d = "0123456789abcdefghijklmnopqrstuvwxyz"
    s = ""
    while True:
        n, r = divmod(n, 36)
        s = d[r] + s
        if n == 0:
            return s


def test_published_ring_figures(spark):
    keys = ["sug:" + _base36((i * 2654435761) % (1 << 32))[:4] for i in range(20000)]
    df = _keys(spark, keys)
    three = ring.ring_table(spark, ["redis-0", "redis-1", "redis-2"])
    bal = {r.node: r["keys"] for r in ring.node_balance(ring.assign_owner(df, "key", three)).collect()}
    assert bal == {"redis-0": 6333, "redis-1": 7346, "redis-2": 6321}
    four = ring.ring_table(spark, ["redis-0", "redis-1", "redis-2", "redis-3"])
    r = ring.remap_report(df, "key", three, four, ["redis-3"]).first()
    assert r.moved_pct == 22.62 and r.moved_elsewhere == 0


def test_delete_batches_cover_all_keys(spark):
    keys = [f"k{i}" for i in range(2500)] + ["k1", "k2"]
    owned = ring.assign_owner(_keys(spark, keys), "key", ring.ring_table(spark, ["a", "b"]))
    b = ring.delete_batches(owned, "key", "node", batch_size=300).collect()
    flat = [k for r in b for k in r["keys"]]
    assert sorted(flat) == sorted(set(keys))
    assert all(r.n_keys == len(r["keys"]) for r in b)


def test_unique_keys_are_shuffled_once_into_their_batches(spark):
    """The affected prefixes of queries are distinct as they are cut, so neither they nor their
    keys pass a shuffle that looks for twins."""
    from prefixdex.operators import prefix

    words = [f"{a}{b} {c}é" for a in ("x", "xy", "ab") for b in ("q", "qq", "") for c in ("r", "rs", "t" * 45)]
    changed = spark.createDataFrame([(w,) for w in [*words, *words, "", None]], "query string")
    keys = prefix.affected_prefixes(changed)
    owned = ring.assign_owner(keys, "key", ring.ring_table(spark, ["a", "b"]), hashed="hash")
    made = ring.delete_batches(owned, "key", "node", 10, unique=True, hashed="hash")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [prefix#" not in plan and "Aggregate [key#" not in plan
    want = {f"sug:{r}:{w[:n]}" for w in words for n in range(1, min(len(w), 40) + 1) if w[n - 1] != " " for r in ("count", "recent")}
    got = [k for r in made.collect() for k in r["keys"]]
    assert sorted(got) == sorted(want)
    again = ring.delete_batches(owned.drop("hash"), "key", "node", 10)
    assert sorted(map(tuple, ((r.node, r.batch, r.n_keys, tuple(r["keys"])) for r in again.collect()))) == sorted(
        (r.node, r.batch, r.n_keys, tuple(r["keys"])) for r in made.collect()
    )


def test_a_key_is_hashed_once_for_its_owner(spark):
    keys = spark.createDataFrame([("k1",), (None,)], "key string").filter(F.col("key").isNull() | (F.col("key") != "x"))
    owned = ring.assign_owner(keys, "key", ring.ring_table(spark, ["a", "b"]))
    filters = [x for x in owned._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x]
    assert not any("md5" in x for x in filters)
    assert [r.key for r in owned.collect()] == ["k1"]


def test_routing_report_hit_and_miss(spark):
    from conftest import seed_freq
    from prefixdex.operators import prefix

    freq = seed_freq(spark, [("iphone 15", 5), ("yoga", 2)])
    index = prefix.invalidate(prefix.build_index(freq), spark.createDataFrame([("yoga", "count")], "prefix string, rank string"))
    keys = spark.createDataFrame([("iphone", "count"), ("yoga", "count"), ("zzz", "recent")], "prefix string, rank string")
    r = ring.ring_table(spark, ["a", "b", "c"])
    got = {(x.prefix, x.rank): (x.key, x.status) for x in ring.routing_report(keys, r, index).collect()}
    assert got == {
        ("iphone", "count"): ("sug:count:iphone", "HIT"),
        ("yoga", "count"): ("sug:count:yoga", "MISS"),
        ("zzz", "recent"): ("sug:recent:zzz", "MISS"),
    }
    owners = _owners(spark, ["a", "b", "c"], [k for k, _ in got.values()])
    assert {x.key: x.node for x in ring.routing_report(keys, r, index).collect()} == owners


def test_removed_node_moves_only_its_keys(spark):
    keys = _keys(spark, [f"k{i}" for i in range(5000)])
    before, after = ring.ring_table(spark, ["a", "b", "c", "d"]), ring.ring_table(spark, ["a", "b", "c"])
    owned = {r.node: r["keys"] for r in ring.node_balance(ring.assign_owner(keys, "key", before)).collect()}
    r = ring.remap_report(keys, "key", before, after, removed_nodes=["d"]).first()
    assert r.moved == owned["d"] > 0 and r.moved_elsewhere == 0


@pytest.mark.parametrize("vnodes", [1, 150, 3000])
def test_bucket_bits_follow_the_ring(spark, vnodes):
    assert 8 <= ring.bucket_shift(3 * vnodes) <= 24
    nodes = ["a", "b", "c"]
    r = ring.ring_table(spark, nodes, vnodes)
    keys = [f"key{i}" for i in range(300)]
    got = {row.key: row.node for row in ring.assign_owner(_keys(spark, keys), "key", r).collect()}
    assert got == {k: _py_owner(nodes, k, vnodes) for k in keys}


def test_requested_and_deleted_counts(spark):
    owned = spark.createDataFrame([("a", "count", "n1"), ("b", "count", "n1"), ("c", "count", "n2")], "prefix string, rank string, node string")
    index = spark.createDataFrame([("a", "count"), ("x", "count")], "prefix string, rank string")
    got = {r.node: (r.requested, r.deleted) for r in ring.invalidation_counts(owned, index).collect()}
    assert got == {"n1": (2, 1), "n2": (1, 0)}
