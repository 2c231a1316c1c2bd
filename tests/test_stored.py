"""Bucketed tables and tiers: pruned reads, in-place rewrites, replays, deletions."""

import datetime as dt
import os
import re

from pyspark.sql import functions as F

from conftest import seed_freq
from prefixdex.operators import events, frequency, prefix
from prefixdex.plans import stored
from prefixdex.sources import bucketed, tiers
from prefixdex.streaming import flush_stream as fs
from prefixdex.streaming import search_stream as ss

PRUNED = r"PartitionFilters: \[[^\]]*bucket"
ANCHOR = "2024-01-01 00:00:00"
WORDS = ["iphone 15", "iphone 15 pro", "ipad", "yoga mat", "yogurt", "zebra", "rice", "rice cooker", "a", "ab"]


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def _deltas(spark, pairs):
    return spark.createDataFrame([(q, q.upper(), n) for q, n in pairs], "query string, display string, delta long")


def test_flushes_rewrite_only_touched_buckets(spark, tmp_path):
    root = str(tmp_path / "store")
    freq = seed_freq(spark, [(w, 10 * i + 5) for i, w in enumerate(WORDS)])
    stored.create(freq, root, buckets=16)
    before = _files(f"{root}/frequency/data"), _files(f"{root}/index/data")
    want = freq
    for version, pairs in ((1, [("yoga mat", 100), ("zulu", 3)]), (2, [("rice", 7), ("zulu", 1)])):
        deltas = _deltas(spark, pairs)
        want = frequency.upsert(want, deltas)
        assert stored.apply_deltas(spark, root, deltas, version)
        assert stored.apply_deltas(spark, root, deltas, version) is False  # replayed
        assert _rows(stored.read_frequency(spark, root), *frequency.FREQUENCY_COLUMNS) == _rows(want, *frequency.FREQUENCY_COLUMNS)
        assert _rows(stored.read_index(spark, root), *prefix.LONG_COLUMNS) == _rows(prefix.build_index_long(want), *prefix.LONG_COLUMNS)
    # Earlier versions are still there as they were, under their own names ...
    assert before[0] <= _files(f"{root}/frequency/data") and before[1] <= _files(f"{root}/index/data")
    assert _rows(stored.read_frequency(spark, root, 0), "query", "count") == _rows(freq, "query", "count")
    # ... and the current one reads the untouched buckets' files.
    m = bucketed.Manifest.read(spark, f"{root}/frequency")
    touched = {r[0] for r in spark.createDataFrame([("yoga mat",), ("zulu",), ("rice",)], "q string").select(bucketed.bucket_of(F.col("q"), 16)).collect()}
    assert {b for b, v in m.places.items() if v > 0} == touched
    assert any(v == 0 for v in m.places.values())
    gone = bucketed.vacuum(spark, f"{root}/frequency", keep=1)
    assert gone and _rows(stored.read_frequency(spark, root), "query", "count") == _rows(want, "query", "count")


def test_a_crash_between_the_tables_is_made_up_for(spark, tmp_path):
    root = str(tmp_path / "store")
    freq = seed_freq(spark, [(w, 10 * i + 5) for i, w in enumerate(WORDS)])
    stored.create(freq, root, buckets=8)
    deltas = _deltas(spark, [("ipad", 500)])
    bucketed.replace(spark, stored.frequency_root(root), 1, *stored.upserted(spark, root, deltas, 1))
    # Files of a version without a manifest are not seen.
    bucketed._write(deltas.withColumnRenamed("delta", "count"), stored.frequency_root(root), 2, "query", 8)
    assert bucketed.latest(spark, stored.frequency_root(root)) == 1
    assert stored.apply_deltas(spark, root, deltas, 1)
    want = frequency.upsert(freq, deltas)
    assert _rows(stored.read_frequency(spark, root), "query", "count") == _rows(want, "query", "count")
    assert _rows(stored.read_index(spark, root), *prefix.LONG_COLUMNS) == _rows(prefix.build_index_long(want), *prefix.LONG_COLUMNS)


def test_a_flush_prunes_partitions_of_both_tables(spark, tmp_path):
    root = str(tmp_path / "store")
    stored.create(seed_freq(spark, [(w, 1) for w in WORDS]), root, buckets=16)
    deltas = _deltas(spark, [("yoga mat", 1)])
    rows, buckets = stored.upserted(spark, root, deltas, 1)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(PRUNED, plan) and len(buckets) == 1
    bucketed.replace(spark, stored.frequency_root(root), 1, rows, buckets)
    rows, lists = stored.refreshed(spark, root, deltas.select("query"), 1)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(PRUNED, plan)) >= 2 and 1 <= len(lists) <= 5
    assert len(rows.inputFiles()) < len(stored.read_index(spark, root).inputFiles()) + len(stored.read_frequency(spark, root).inputFiles())


def test_no_change_is_a_version_too(spark, tmp_path):
    root = str(tmp_path / "store")
    freq = seed_freq(spark, [("one", 1)])
    stored.create(freq, root, buckets=4)
    assert stored.apply_deltas(spark, root, _deltas(spark, [("one", 1)]).filter("false"), 1)
    assert _rows(stored.read_frequency(spark, root), "query", "count") == [("one", 1)]


def test_tiers_bound_the_versions_of_a_sink(spark, tmp_path, monkeypatch):
    root, want = str(tmp_path / "sink"), {}
    sink = ss.update_sink(root, ("k",))
    for b in range(70):
        rows = [(b % 5, b, "x"), (100 + b, b, "y")]
        want |= {k: n for k, n, _ in rows}
        frame = spark.createDataFrame(rows, "k long, n long, s string").coalesce(1)
        sink(frame, b)
        if b in (7, 40):
            sink(spark.createDataFrame([(1, -1, "again")], "k long, n long, s string"), b)  # replayed
        if b % 23 == 22 or b == 69:
            got = {r.k: r.n for r in ss.newest_updates(ss.read_updates(spark, root), "k").collect()}
            assert got == want
    assert len(tiers.pieces(spark, root)) <= 3 * (tiers.BASE - 1)
    kept = [d for d, _, names in os.walk(root) if "_SUCCESS" in names]
    assert len(kept) == len(tiers.pieces(spark, root))


def _log(n, seconds):
    t0 = dt.datetime(2024, 1, 1)
    return [(i, t0 + dt.timedelta(seconds=seconds * i), f"query {i % 7}", i % 3) for i in range(n)]


def test_flushes_are_numbered_across_batches(spark, tmp_path):
    root = str(tmp_path / "flush")
    schema = "event_id long, ts timestamp, query string, user_id long"
    rows = _log(60, 7)
    whole = spark.createDataFrame(rows, schema)
    for b, lo in enumerate(range(0, 60, 13)):
        batch = spark.createDataFrame(rows[lo : lo + 13] + [(1000 + b, rows[lo][1], "  ", 1)], schema)
        if b == 2:  # a crash after the counts were written
            real = fs.store.write_version
            fs.store.write_version = lambda df, path, *a, **k: None if path.endswith("/flushes") else real(df, path, *a, **k)
            try:
                fs.assign_batch(spark, batch, b, root, ANCHOR, 60, 5)
            finally:
                fs.store.write_version = real
        assert fs.assign_batch(spark, batch, b, root, ANCHOR, 60, 5)
        assert fs.assign_batch(spark, batch, b, root, ANCHOR, 60, 5) is False
    got = fs.read_flushes(spark, root)
    want = events.assign_flushes(whole, ANCHOR, 60, 5)
    assert _rows(got, "event_id", "tick", "flush_no") == _rows(want, "event_id", "tick", "flush_no")
    now = F.lit(6)
    assert _rows(events.pending_view(got, now, 5), "q", "n") == _rows(events.pending_view(want, now, 5), "q", "n")
    # A late event joins its tick after those that have arrived before.
    late = spark.createDataFrame([(2000, rows[1][1], "late", 1)], schema)
    fs.assign_batch(spark, late, 9, root, ANCHOR, 60, 5)
    assert fs.read_flushes(spark, root).filter("event_id = 2000").first().flush_no == 9 // 5


def test_histories_kept_by_batches(spark, tmp_path):
    from prefixdex.operators import history

    root, schema = str(tmp_path / "history"), "event_id long, ts timestamp, query string, user_id long"
    rows = [(i, t, q.upper() if i % 2 else q, u) for i, t, q, u in _log(90, 5)]
    order = rows[:20] + rows[40:60] + rows[20:40] + rows[60:]  # batches out of order
    for b, lo in enumerate(range(0, 90, 10)):
        batch = spark.createDataFrame(order[lo : lo + 10], schema)
        assert fs.apply_history(spark, batch, b, root, cap=4)
        assert fs.apply_history(spark, batch, b, root, cap=4) is False
    want = history.user_history(spark.createDataFrame(rows, schema), cap=4)
    assert _rows(fs.read_history(spark, root), "user_id", "pos", "q", "ts") == _rows(want, "user_id", "pos", "q", "ts")


def test_trending_is_kept_with_every_batch(spark, tmp_path):
    f_root, t_root, schema = str(tmp_path / "freq"), str(tmp_path / "trending"), "event_id long, ts timestamp, query string"
    ss.seed_tables(seed_freq(spark, [(f"query {i}", 3 + i % 4) for i in range(80)]), f_root)
    ss.seed_trending(spark, f_root, t_root)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), f"Query {i * i % 90}") for i in range(60)]
    for b in range(4):
        batch = spark.createDataFrame(rows[15 * b : 15 * b + 15], schema)
        ss.apply_batch(spark, batch, b, f_root, None, ANCHOR, 0.9, 86400, 3, t_root)
        at = ss.newest_landmark(spark, f_root)
        for rank, n in (("count", 50), ("recent", 6)):
            want = prefix.trending(ss.read_frequency(spark, f_root, at=at), rank, n)
            got = ss.read_trending(spark, t_root, rank, n, at)
            pick = lambda df: [(r[0], r[1], r[2], round(r[3], 9)) for r in _rows(df, "pos", "query", "count", "score")]
            assert pick(got) == pick(want)
