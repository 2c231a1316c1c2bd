import datetime as dt

from pyspark.sql import functions as F

from conftest import seed_freq
from prefixdex.operators import decay, events, prefix
from prefixdex.sources import store
from prefixdex.streaming import search_stream as ss

ANCHOR = "2024-01-01 00:00:00"


def _sorted(df):
    """Rows in order, scores to nine digits (sums of decayed weights)."""
    rows = [{**r.asDict(), "score": round(r.score, 9)} for r in df.collect()]
    return sorted(tuple(r.values()) for r in rows)


def _write_events(spark, path, rows):
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, query string").write.mode("overwrite").parquet(path)


def test_stream_equals_batch_and_replay_is_noop(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    base = seed_freq(spark, [("iphone 15", 200), ("yoga mat", 30)])
    f_root, i_root = str(tmp_path / "freq"), str(tmp_path / "idx")
    ss.seed_tables(base, f_root, i_root)
    src = str(tmp_path / "events")
    rows1 = [(i, t0 + dt.timedelta(hours=i), q) for i, q in enumerate(["iphone 15", "Yoga Mat", "new thing", "  "])]
    _write_events(spark, src + "/p1", rows1)
    schema = "event_id bigint, ts timestamp, query string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    q = ss.run_search_stream(spark, stream, f_root, str(tmp_path / "cp"), ANCHOR, i_root, 0.9, 86400)
    q.awaitTermination()
    rows2 = [(10 + i, t0 + dt.timedelta(days=1, hours=i), q) for i, q in enumerate(["new thing", "iphone 15"])]
    _write_events(spark, src + "/p2", rows2)
    q = ss.run_search_stream(spark, stream, f_root, str(tmp_path / "cp"), ANCHOR, i_root, 0.9, 86400)
    q.awaitTermination()
    got = {r.query: (r.display, r["count"]) for r in ss.read_frequency(spark, f_root).collect()}
    assert got == {"iphone 15": ("iphone 15", 202), "yoga mat": ("yoga mat", 31), "new thing": ("new thing", 2)}
    # scores at the newest landmark (day 1): base · 0.9 + Σ 0.9^(1 − tick)
    sc = {r.query: r.score for r in ss.read_frequency(spark, f_root).collect()}
    assert abs(sc["new thing"] - (0.9 + 1)) < 1e-9 and abs(sc["yoga mat"] - 31 * 0.9) < 1e-9
    sc = {r.query: r.score for r in ss.read_frequency(spark, f_root, at=3).collect()}
    assert abs(sc["new thing"] - (0.9**3 + 0.9**2)) < 1e-9
    # incremental index equals a rebuild of the final table
    idx = ss.read_index(spark, i_root)
    rebuilt = prefix.build_index_long(ss.read_frequency(spark, f_root))
    cols = list(prefix.LONG_COLUMNS)
    assert _sorted(idx.select(*cols)) == _sorted(rebuilt.select(*cols))
    # replaying an applied batch changes nothing
    applied = store.committed_versions(spark, f_root + "/delta")
    last = applied[-1]
    batch = spark.createDataFrame(rows2, schema)
    assert ss.apply_batch(spark, batch, last, f_root, i_root, ANCHOR) is False
    assert {r.query: r["count"] for r in ss.read_frequency(spark, f_root).collect()}["iphone 15"] == 202
    # compaction folds the deltas into a new base with the same content
    ss.compact(spark, f_root, i_root, last + 1)
    assert store.committed_versions(spark, f_root + "/base") == [0, last + 1]
    assert _sorted(ss.read_frequency(spark, f_root)) == _sorted(ss.read_frequency(spark, f_root, upto=last + 1))
    assert _sorted(ss.read_index(spark, i_root).select(*cols)) == _sorted(rebuilt.select(*cols))


def test_recency_stream_update_mode(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    src = str(tmp_path / "ev")
    _write_events(spark, src + "/p1", [(i, t0 + dt.timedelta(days=i % 3), "a" if i % 2 else "b") for i in range(9)])
    stream = spark.readStream.schema("event_id bigint, ts timestamp, query string").parquet(src + "/*")
    agg = ss.recency_stream(stream, ANCHOR, 0.9, 86400, span_ticks=2)
    out = str(tmp_path / "out")
    ss.write_updates(agg, out, str(tmp_path / "cp"), ("query", "span")).awaitTermination()
    read = lambda: {r.query: r for r in ss.scores_at(ss.read_updates(spark, out), 2, span_ticks=2).collect()}
    got = read()
    want_a = sum(0.9 ** (2 - (i % 3)) for i in range(9) if i % 2)
    assert got["a"].events == 4 and abs(got["a"].score - want_a) < 1e-9
    # a replayed batch replaces its own version
    last = store.committed_versions(spark, out)[-1]
    again = store.read_version(spark, out, last).checkpoint()
    store.write_version(again, out, last)
    assert read() == got


def test_long_streams_stay_finite(spark, tmp_path):
    """60 s ticks over 30 days: weights of forward decay from one landmark would
    overflow after 4.7 days."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=i), "often" if i % 5 == 0 else "rare" if i == 3 else "other") for i in range(720)]
    rows += [(1000, t0 + dt.timedelta(days=30), "often"), (1001, t0 + dt.timedelta(days=30, minutes=-2), "rare")]
    schema = "event_id bigint, ts timestamp, query string"
    df = spark.createDataFrame(rows, schema)
    now = 30 * 1440
    want = {}
    for _, ts, q in rows:
        want[q] = want.get(q, 0) + 0.9 ** (now - int((ts - t0).total_seconds() // 60))
    tick = events.tick_of("ts", ANCHOR, 60)
    batch = {r.query: r.score for r in decay.recency_scores(df, tick, F.lit(now)).collect()}
    f_root, i_root = str(tmp_path / "freq"), str(tmp_path / "idx")
    ss.seed_tables(seed_freq(spark, [("often", 1), ("oft", 9)]), f_root, i_root)
    for b in range(3):  # the second batch is late
        part = df.filter(F.col("event_id") % 3 == (0, 2, 1)[b])
        ss.apply_batch(spark, part, b, f_root, i_root, ANCHOR, 0.9, 60, compact_every=2)
    stored = {r.query: r.score for r in ss.read_frequency(spark, f_root, at=now).collect()}
    for q, x in want.items():
        assert abs(batch[q] - x) <= 1e-9 * x and abs(stored[q] - x) <= 1e-9 * x
    top = [r.query for r in ss.read_index(spark, i_root).filter("prefix = 'o' and rank = 'recent'").orderBy("pos").collect()]
    assert top == ["often", "other", "oft"]


def test_compaction_is_made_up_for_on_replay(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    f_root = str(tmp_path / "freq")
    ss.seed_tables(seed_freq(spark, [("ipad", 7)]), f_root)
    batch = spark.createDataFrame([(1, t0, "ipad")], "event_id bigint, ts timestamp, query string")
    assert ss.apply_batch(spark, batch, 0, f_root, None, ANCHOR, 0.9, 86400, compact_every=0)
    assert ss.apply_batch(spark, batch, 0, f_root, None, ANCHOR, 0.9, 86400, compact_every=1) is False
    assert store.committed_versions(spark, f_root + "/base") == [0, 1]
    assert [r["count"] for r in ss.read_frequency(spark, f_root).collect()] == [8]


def test_compaction_deletes_what_the_base_before_has_folded(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    f_root, i_root = str(tmp_path / "freq"), str(tmp_path / "idx")
    ss.seed_tables(seed_freq(spark, [("ipad", 7)]), f_root, i_root)
    schema = "event_id bigint, ts timestamp, query string"
    batches = [spark.createDataFrame([(b, t0 + dt.timedelta(hours=b), "ipad")], schema) for b in range(6)]
    for b, df in enumerate(batches):
        assert ss.apply_batch(spark, df, b, f_root, i_root, ANCHOR, 0.9, 86400, compact_every=2)
    for root in (f_root, i_root):
        assert store.committed_versions(spark, root + "/base") == [4, 6]
        assert store.committed_versions(spark, root + "/delta") == [4, 5]
    # batches that are only in a base by now are not applied again
    assert [ss.apply_batch(spark, df, b, f_root, i_root, ANCHOR, 0.9, 86400) for b, df in enumerate(batches)] == [False] * 6
    assert [r["count"] for r in ss.read_frequency(spark, f_root).collect()] == [13]


def test_window_activity_late_data(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    src = str(tmp_path / "ev")
    schema = "event_id bigint, ts timestamp, query string"
    stream = spark.readStream.schema(schema).parquet(src + "/*")
    out = ss.window_queries(stream, "1 hour", "1 hour")
    cp, path = str(tmp_path / "cp"), str(tmp_path / "out")
    run = lambda: ss.write_updates(out, path, cp, ("window", "query")).awaitTermination()
    h = lambda x: t0 + dt.timedelta(hours=x)
    one_file = lambda path, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    one_file(src + "/p1", [(1, h(0.1), "a"), (2, h(0.2), "A"), (3, h(1.5), "b"), (4, h(2.5), "c")])
    run()
    # The watermark is now 1.5 h: window [0,1) is closed and a 0.5 h event is
    # dropped; a 2.1 h event is late but its window [2,3) is still open.
    one_file(src + "/p2", [(5, h(0.5), "z"), (6, h(2.1), "c"), (7, h(5.0), "d")])
    run()
    newest = ss.newest_updates(ss.read_updates(spark, path), "window", "query")
    got = {(r.window.start.hour, r.events, r.distinct_queries) for r in ss.window_activity(newest).collect()}
    # the last window is still open and reported as it stands
    assert got == {(0, 2, 1), (1, 1, 1), (2, 2, 1), (5, 1, 1)}


def test_pending_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    src, out = str(tmp_path / "ev"), str(tmp_path / "out")
    rows = [(i, t0 + dt.timedelta(seconds=3600 * i), q) for i, q in enumerate(["a", "b", "A ", "b", " "])]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, query string").write.parquet(src + "/p1")
    stream = spark.readStream.schema("event_id bigint, ts timestamp, query string").parquet(src + "/*")
    ss.write_updates(ss.pending_stream(stream, ANCHOR, 7200), out, str(tmp_path / "cp"), ("tick", "q")).awaitTermination()
    updates = ss.read_updates(spark, out)
    assert {(r.q, r.n) for r in ss.pending_at(updates, 1).collect()} == {("a", 1), ("b", 1)}
    assert ss.pending_at(updates, 2).count() == 0


def test_hit_rate_stream_windows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    schema = "ts timestamp, node string, cache string"
    src, out, cp = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")
    h = lambda x: t0 + dt.timedelta(hours=x)
    stream = spark.readStream.schema(schema).parquet(src + "/*")
    agg = ss.hit_rate_stream(stream, "1 hour", "1 hour")

    def run():
        q = agg.writeStream.outputMode("append").format("parquet").option("path", out).option(
            "checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()

    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{name}")
    put("a", [(h(0.1), "n1", "hit"), (h(0.2), "n1", "hit"), (h(0.3), "n1", "miss"), (h(0.4), "n1", "skip"), (h(2.5), "n1", "hit")])
    run()
    # watermark 1.5 h: window [0,1) is closed, the 0.9 h miss is dropped;
    # the 1.8 h hit is late but its window [1,2) is still open
    put("b", [(h(0.9), "n1", "miss"), (h(1.8), "n1", "hit"), (h(5.0), "n1", "miss")])
    run()
    got = {(r.window.start.hour, r.hits, r.misses, r.skips, r.hit_rate) for r in spark.read.parquet(out).collect()}
    assert got == {(0, 2, 1, 1, 67), (1, 1, 0, 0, 100), (2, 1, 0, 0, 100)}


def test_replay_after_partial_failure(spark, tmp_path):
    """A batch whose frequency delta was committed but whose index delta was
    not (crash in between): the replay writes only the index delta."""
    t0 = dt.datetime(2024, 1, 1)
    base = seed_freq(spark, [("iphone 15", 200), ("ipad", 7)])
    f_root, i_root = str(tmp_path / "freq"), str(tmp_path / "idx")
    ss.seed_tables(base, f_root, i_root)
    batch = spark.createDataFrame([(1, t0, "ipad"), (2, t0, "iphone 16")], "event_id bigint, ts timestamp, query string")
    assert ss.apply_batch(spark, batch, 0, f_root, None, ANCHOR, 0.9, 86400)  # index step "lost"
    assert store.committed_versions(spark, i_root + "/delta") == []
    assert ss.apply_batch(spark, batch, 0, f_root, i_root, ANCHOR, 0.9, 86400)  # replay
    assert ss.apply_batch(spark, batch, 0, f_root, i_root, ANCHOR, 0.9, 86400) is False
    counts = {r.query: r["count"] for r in ss.read_frequency(spark, f_root).collect()}
    assert counts == {"iphone 15": 200, "ipad": 8, "iphone 16": 1}
    cols = list(prefix.LONG_COLUMNS)
    rebuilt = prefix.build_index_long(ss.read_frequency(spark, f_root))
    assert _sorted(ss.read_index(spark, i_root).select(*cols)) == _sorted(rebuilt.select(*cols))


def test_a_batch_of_one_file_is_spread_before_its_texts_are_read(spark, tmp_path):
    import datetime as dt

    from prefixdex.plans import registry

    d = str(tmp_path)
    rows = [(i, dt.datetime(2024, 1, 1), i % 3, "view") for i in range(20)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(0, "pen"), (1, "cup")], "p_partkey long, p_name string").write.parquet(f"{d}/part.parquet")
    stream = registry._user_event_stream(spark, d, f"{d}/events.parquet")
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert plan.index("Join") < plan.index("RepartitionByExpression")
