import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import seed_freq
from prefixdex.operators import events, frequency, prefix
from prefixdex.operators.ordinal import with_ordinal

T0 = dt.datetime(2024, 1, 1)


def _events(spark, queries, step_seconds=1, start=T0):
    rows = [(i, start + dt.timedelta(seconds=i * step_seconds), 1, q) for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, query string")


def test_write_reduction_and_upsert(spark):
    freq = seed_freq(spark, [("iphone 15", 200)])
    ev = _events(spark, ["iphone 15"] * 5 + ["brand new gadget"])
    flushed = events.assign_flushes(ev, "2024-01-01 00:00:00", interval_seconds=3600)
    stats = events.write_stats(events.flush_summary(flushed)).first()
    assert (stats.flushes, stats.total_events, stats.total_db_writes) == (1, 6, 2)
    assert stats.writes_saved_pct == round((1 - 2 / 6) * 100)
    # the table is unchanged until the deltas are applied
    assert freq.first()["count"] == 200
    new = {r.query: r["count"] for r in frequency.upsert(freq, frequency.event_deltas(ev)).collect()}
    assert new == {"iphone 15": 205, "brand new gadget": 1}


def test_flush_invalidates_both_ranks(spark):
    keys = {(r.prefix, r.rank) for r in prefix.affected_prefixes(frequency.event_deltas(_events(spark, ["iphone 15"]))).collect()}
    assert ("iphone", "count") in keys and ("iphone", "recent") in keys


def test_empty_flush_is_noop(spark):
    ev = _events(spark, []).limit(0)
    flushed = events.assign_flushes(ev, "2024-01-01 00:00:00")
    stats = events.write_stats(events.flush_summary(flushed)).first()
    assert (stats.flushes, stats.total_events, stats.writes_saved_pct) == (0, 0, 0)


def test_size_trigger_splits_a_tick(spark):
    ev = _events(spark, [f"q{i % 7}" for i in range(97)], step_seconds=0.01)
    flushed = events.assign_flushes(ev, "2024-01-01 00:00:00", interval_seconds=3600)
    sizes = sorted(r["count"] for r in flushed.groupBy("tick", "flush_no").count().collect())
    assert sizes == [47, 50]


def test_affected_prefix_lengths(spark):
    q = "abc def ghi jkl mno pqr stu vwx yz0 123 456 7"  # 45 characters
    assert len(q) == 45
    got = prefix.affected_prefixes(spark.createDataFrame([(q,)], "query string")).collect()
    ps = {r.prefix for r in got}
    assert max(len(p) for p in ps) <= 40 and not any(p.endswith(" ") for p in ps)
    assert len(got) == 2 * len({q[:n] for n in range(1, 41) if not q[:n].endswith(" ")})


def test_incremental_refresh_equals_rebuild(spark):
    rnd = random.Random(7)
    long_a = "red plate with a very long name that goes past forty characters"
    long_b = "red plate with a very long name that goes past forty chars too"
    vocab = ["red plate", "red pen", "re do", "blue rod", "blue", "b", "rod red", "red plates", long_a, long_b]
    freq = seed_freq(spark, [(v, rnd.randint(1, 5)) for v in vocab[:5] + [long_a]])
    index = prefix.build_index_long(freq, k=3)
    for step in range(5):
        batch = [rnd.choice(vocab) for _ in range(rnd.randint(1, 6))]
        deltas = frequency.event_deltas(_events(spark, batch, start=T0 + dt.timedelta(days=step)))
        freq = frequency.upsert(freq, deltas).checkpoint()
        index = prefix.refresh_index_long(index, freq, deltas.select("query"), k=3).checkpoint()
        rebuilt = prefix.build_index_long(freq, k=3)
        cols = ["prefix", "rank", "pos", "query", "count", "score"]
        assert sorted(index.select(*cols).collect()) == sorted(rebuilt.select(*cols).collect())


def test_ordinal_matches_row_number_under_skew(spark):
    rows = [(0 if i % 3 else i % 5, i * 7 % 101, i) for i in range(300)]  # group 0 holds 2/3
    df = spark.createDataFrame(rows, "g int, o int, id int")
    got = {r.id: r.ordinal for r in with_ordinal(df, ["o", "id"], ["g"], num_partitions=6).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted([r for r in rows if r[0] == g], key=lambda r: (r[1], r[2]))):
            want[r[2]] = n
    assert got == want
    glob = {r.id: r.ordinal for r in with_ordinal(df, ["o", "id"], num_partitions=5).collect()}
    assert glob == {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}


def test_pending_view(spark):
    ev = _events(spark, ["a", "b", "a"] + ["C  c"] * 50, step_seconds=1)
    flushed = events.assign_flushes(ev, "2024-01-01 00:00:00", interval_seconds=3600)
    rows = events.pending_view(flushed, F.lit(0)).collect()
    assert {(r.q, r.n) for r in rows} == {("c c", 3)}  # the buffer key is normalized
    assert {(r.pending_events, r.pending_queries) for r in rows} == {(3, 1)}


def test_plain_invalidation_then_lookup_misses(spark):
    freq = seed_freq(spark, [("iphone 15", 200), ("yoga mat", 30)])
    index = prefix.build_index(freq)
    deltas = frequency.event_deltas(_events(spark, ["iphone 15"]))
    index2 = prefix.invalidate(index, prefix.affected_prefixes(deltas))
    left = {(r.prefix, r.rank) for r in index2.collect()}
    assert ("iphone", "count") not in left and ("yoga", "recent") in left
    keys = prefix.request_keys(spark.createDataFrame([("iphone", "count"), ("yoga", "count")], "prefix string, rank string"))
    status = {r.prefix: r.status for r in prefix.lookup(index2, frequency.upsert(freq, deltas), keys).collect()}
    assert status == {"iphone": "miss", "yoga": "hit"}
