import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import seed_freq
from prefixdex.functions.text import normalize_literal
from prefixdex.operators import prefix, ring

SEED = [
    ("iphone charger", 100),
    ("iphone case", 50),
    ("iphone 15", 200),
    ("ipad mini", 70),
    ("yoga mat", 30),
]


def _keys(spark, prefixes, rank="count"):
    req = spark.createDataFrame([(p, rank) for p in prefixes], "prefix string, rank string")
    return prefix.request_keys(req)


def _lists(answers):
    out = {}
    for r in prefix.answers_long(answers).collect():
        out.setdefault((r.prefix, r.rank, r.status), [])
        if r.pos is not None:
            out[(r.prefix, r.rank, r.status)].append((r.pos, r.query))
    return {k: [q for _, q in sorted(v)] for k, v in out.items()}


def test_miss_then_hit_with_equal_results(spark):
    freq = seed_freq(spark, SEED)
    empty_index = prefix.build_index(freq.limit(0))
    first = _lists(prefix.lookup(empty_index, freq, _keys(spark, ["iphone"])))
    assert first == {("iphone", "count", "miss"): ["iphone 15", "iphone charger", "iphone case"]}
    index = prefix.build_index(freq)
    second = _lists(prefix.lookup(index, freq, _keys(spark, ["iphone"])))
    assert second == {("iphone", "count", "hit"): ["iphone 15", "iphone charger", "iphone case"]}


def test_mixed_case_shares_key(spark):
    freq = seed_freq(spark, SEED)
    index = prefix.build_index(freq)
    got = _lists(prefix.lookup(index, freq, _keys(spark, ["IPHONE"])))
    assert list(got) == [("iphone", "count", "hit")]


def test_blank_is_skip_and_no_match_is_empty(spark):
    freq = seed_freq(spark, SEED)
    got = _lists(prefix.bulk_suggest(freq, _keys(spark, ["   ", "zzz"])))
    assert got == {("", "count", "skip"): [], ("zzz", "count", "miss"): []}
    assert prefix.suggest_one(freq, "   ").count() == 0


def test_rank_orders(spark):
    freq = seed_freq(spark, [("iphone big", 1000, 1), ("iphone trend", 10, 999)])
    assert prefix.suggest_one(freq, "iphone", "count").first().query == "iphone big"
    assert prefix.suggest_one(freq, "iphone", "recent").first().query == "iphone trend"
    idx = {(r.rank, r.pos): r.query for r in prefix.build_index_long(freq).filter("prefix = 'iphone'").collect()}
    assert idx[("count", 1)] == "iphone big" and idx[("recent", 1)] == "iphone trend"


def test_stale_index_still_answers(spark):
    """Cache unavailable / expired: the lookup falls through to the table."""
    freq = seed_freq(spark, SEED)
    old = prefix.build_index(freq).withColumn("computed_at", F.lit(dt.datetime(2000, 1, 1)))
    got = _lists(prefix.lookup(old, freq, _keys(spark, ["iphone"]), ttl_seconds=300))
    assert got == {("iphone", "count", "miss"): ["iphone 15", "iphone charger", "iphone case"]}
    # TTL ≤ 0 never expires
    got = _lists(prefix.lookup(old, freq, _keys(spark, ["iphone"]), ttl_seconds=0))
    assert list(got) == [("iphone", "count", "hit")]


def _brute_force(rows, k=10, max_len=40):
    out = {}
    for rank in ("count", "recent"):
        prefixes = {q[:n] for q, *_ in rows for n in range(1, min(len(q), max_len) + 1)}
        for p in prefixes:
            if p.endswith(" "):
                continue
            m = [r for r in rows if r[0].startswith(p)]
            key = (lambda r: (-r[2], r[1])) if rank == "count" else (lambda r: (-r[3], r[1]))
            out[(p, rank)] = [r[1] for r in sorted(m, key=key)[:k]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_index_equals_brute_force_with_ties(spark, seed):
    rnd = random.Random(seed)
    words = ["ab", "abc", "b", "ba a", "a b", "zz"]
    rows = {}
    for _ in range(60):
        q = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3)))
        rows[normalize_literal(q)] = (normalize_literal(q), q.title() if rnd.random() < 0.3 else q, rnd.randint(1, 4), float(rnd.randint(1, 4)))
    data = list(rows.values())
    freq = spark.createDataFrame(data, "query string, display string, count bigint, score double")
    want = _brute_force(data, k=3, max_len=5)
    for split in (False, True):
        got = {}
        for r in prefix.build_index_long(freq, k=3, max_len=5, split_shared=split).collect():
            got.setdefault((r.prefix, r.rank), []).append((r.pos, r.query))
        got = {k: [q for _, q in sorted(v)] for k, v in got.items()}
        assert got == want


def test_bulk_equals_one_by_one(spark):
    freq = seed_freq(spark, SEED + [("Iphone 15 Pro", 120), ("yoga block", 30)])
    prefixes = ["i", "ip", "iphone 1", "yoga", "y", "q"]
    bulk = _lists(prefix.bulk_suggest(freq, _keys(spark, prefixes, "recent")))
    for p in prefixes:
        one = [r.query for r in prefix.suggest_one(freq, p, "recent").orderBy("pos").collect()]
        assert bulk[(p, "recent", "miss")] == one


def test_bulk_without_broadcast_path(spark):
    freq = seed_freq(spark, SEED)
    a = _lists(prefix.bulk_suggest(freq, _keys(spark, ["i", "ip", "y"]), broadcast_max_rows=0))
    b = _lists(prefix.bulk_suggest(freq, _keys(spark, ["i", "ip", "y"])))
    assert a == b


def test_trending_limit_clamp():
    assert [prefix.clamp_trending_limit(v) for v in (0, -3, 99, None, "abc", 7)] == [6, 1, 50, 6, 6, 7]


def test_trending(spark):
    freq = seed_freq(spark, SEED)
    got = [r.query for r in prefix.trending(freq, "count", 2).orderBy("pos").collect()]
    assert got == ["iphone 15", "iphone charger"]


def test_only_blank_requests(spark):
    freq = seed_freq(spark, SEED)
    got = _lists(prefix.bulk_suggest(freq, _keys(spark, ["  ", "\t"])))
    assert got == {("", "count", "skip"): []}
    idx = prefix.build_index(freq)
    got = _lists(prefix.lookup(idx, freq, _keys(spark, [" "])))
    assert got == {("", "count", "skip"): []}


def test_overlong_requests_are_answered_with_the_reason(spark):
    freq = seed_freq(spark, SEED)
    keys = _keys(spark, ["x" * 513, "ok", " " * 600, "ip"])
    for ans in (prefix.bulk_suggest(freq, keys), prefix.lookup(prefix.build_index(freq), freq, keys)):
        got = {(r.prefix, r.status in ("hit", "miss"), r.reason, len(r.suggestions) > 0) for r in ans.collect()}
        assert got == {
            ("x" * 513, False, "exceeds 512 chars", False), ("", False, "exceeds 512 chars", False), ("ok", True, None, False), ("ip", True, None, True),
        }


def test_a_second_lookup_hits(spark):
    """Misses are written back, empty answers and over-long prefixes too; a stale
    row is computed anew and answers carry the owner."""
    from pyspark.sql import functions as F

    freq = seed_freq(spark, SEED)
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    index = prefix.build_index(freq).withColumn(
        "computed_at", F.when(F.col("prefix") == "ip", F.lit("2024-01-01 00:00:00")).otherwise(F.lit("2024-01-01 00:09:00")).cast("timestamp")
    )
    nodes = ring.ring_table(spark, ["n1", "n2"])
    keys = _keys(spark, ["ip", "iph", "zzz", "iphone 15 " + "x" * 40, ""])
    first = prefix.lookup(index, freq, keys, 300, now, ring=nodes)
    got = {r.prefix[:9]: (r.status, r.node in ("n1", "n2")) for r in first.collect()}
    assert got == {"ip": ("miss", True), "iph": ("hit", True), "zzz": ("miss", True), "iphone 15": ("miss", True), "": ("skip", False)}
    stored = prefix.write_back(index, first, now)
    assert stored.count() == index.count() + 2
    second = prefix.lookup(stored, freq, keys, 300, now, ring=nodes)
    assert {r.prefix[:9]: r.status for r in second.collect()} == {"ip": "hit", "iph": "hit", "zzz": "hit", "iphone 15": "hit", "": "skip"}
    lists = lambda df: {r.prefix: r.suggestions for r in df.collect()}
    assert lists(first) == lists(second)


def test_trending_takes_any_limit(spark):
    freq = seed_freq(spark, [(f"q{i:03d}", i + 1) for i in range(80)])
    assert prefix.trending(freq, "count", 70).count() == 70


def test_split_index_across_neighbour_chunks(spark, monkeypatch):
    """Neighbours that fall in different chunks of the sorted order."""
    monkeypatch.setattr(prefix, "NEIGHBOUR_CHUNK", 3)
    rows = [(f"q{i:02d} tail", i % 4 + 1) for i in range(20)] + [("q0", 9), ("zz top", 2), ("zz", 1)]
    freq = seed_freq(spark, rows)
    cols = ["prefix", "rank", "pos", "query", "count", "score"]
    a = prefix.build_index_long(freq, k=2, split_shared=True).select(*cols).collect()
    b = prefix.build_index_long(freq, k=2, split_shared=False).select(*cols).collect()
    assert sorted(a) == sorted(b)


def test_array_and_long_index_round_trip(spark):
    freq = seed_freq(spark, SEED)
    long = prefix.build_index_long(freq)
    back = prefix.index_to_long(prefix.to_index(long))
    cols = list(prefix.LONG_COLUMNS)
    assert sorted(back.select(*cols).collect()) == sorted(long.select(*cols).collect())


def test_chains_of_keys_come_from_the_keys_before_them(spark):
    """Keys are sorted, not cut into all their prefixes: only the first of each range is."""
    rng = random.Random(5)
    keys = {"".join(rng.choice("aé 😀b") for _ in range(rng.randint(1, 9))).strip(" ") for _ in range(900)} - {""}
    live = spark.createDataFrame([(k, r) for k in keys for r in ("count", "recent")], "prefix string, rank string")
    cut, explode_prefixes = [], prefix.explode_prefixes
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(prefix, "explode_prefixes", lambda df, *a, **b: cut.append(df) or explode_prefixes(df, *a, **b))
        got = {r.prefix: sorted(r._chain) for r in prefix._with_chains(live).collect()}
    assert got == {k: [n for n in range(1, len(k) + 1) if k[:n] in keys] for k in keys}
    assert max(map(len, got.values())) > 3 and sum(d.count() for d in cut) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
