"""Named jobs over the driver's tables, shared by ``__spark_entry__`` and the
bench. Each takes ``(spark, sf_dir)`` and returns a DataFrame over the full
tables.

Parameters: search-event ticks are anchored at ``ANCHOR``; recency decays once
per day and the event buffer flushes every 6 hours or at 50 events (the
reference's 60 s / 2 s timers would make every synthetic event its own
flush). The cache nodes are ``redis-0..2`` (``redis-3`` for the remap).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixdex.functions.keys import cache_key
from prefixdex.functions.text import normalize, short_name
from prefixdex.operators import decay, events, frequency, history, prefix, radix, reports, ring
from prefixdex.plans import placement
from prefixdex.plans.session import kept, work_dir
from prefixdex.sources import catalog, store, tables

ANCHOR = "2024-01-01 00:00:00"
DAY = 86_400
FLUSH_INTERVAL = 6 * 3_600
NODES = ("redis-0", "redis-1", "redis-2")
NEW_NODE = "redis-3"
SUGGEST_PREFIX = "hot"
SAMPLE_EVERY = 3
DELETE_BATCH = 1000
TTL_SECONDS = 300


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), digits))
    return df


# ---------------------------------------------------------------- sources
def freq_parts(spark: SparkSession, d: str) -> DataFrame:
    return frequency.frequency_from_catalog(tables.part_catalog(spark, d))


def freq_documents(spark: SparkSession, d: str) -> DataFrame:
    return frequency.frequency_from_catalog(tables.document_catalog(spark, d))


def accepted_events(spark: SparkSession, d: str) -> DataFrame:
    good, _ = events.split_valid(tables.search_events(spark, d))
    return good


def now_tick(spark: SparkSession, d: str, interval: int):
    ev = tables.load(spark, d, "events")
    return ev.select(events.tick_of(F.max("ts"), ANCHOR, interval)).scalar()


def event_totals(spark: SparkSession, d: str) -> DataFrame:
    """``query, display, delta, g`` over all accepted events, ``g`` at the last
    event's day."""
    from prefixdex.streaming.search_stream import batch_deltas

    return batch_deltas(accepted_events(spark, d), ANCHOR, now_tick(spark, d, DAY), decay.DECAY_FACTOR, DAY)


def live_parts(spark: SparkSession, d: str) -> DataFrame:
    """Part frequency ingested at the anchor, plus every search: ``count``
    all-time, ``score`` decayed daily up to the last event's day."""
    base = freq_parts(spark, d)
    base = base.withColumn("score", decay.rescaled(F.col("score"), F.lit(0), now_tick(spark, d, DAY)))
    return frequency.upsert(base, event_totals(spark, d), score_delta="g")


# ---------------------------------------------------------------- jobs
def q_frequency_parts(spark, d):
    return freq_parts(spark, d)


def q_frequency_documents(spark, d):
    return freq_documents(spark, d)


def q_catalog_rejects_parts(spark, d):
    c = catalog.classify(tables.part_catalog(spark, d))
    return c.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def q_load_profile_parts(spark, d):
    cat = tables.part_catalog(spark, d)
    good, _ = catalog.qualify(cat)
    return frequency.load_profile(cat, good, freq_parts(spark, d))


def q_dataset_size_documents(spark, d):
    return store.dataset_size(freq_documents(spark, d))


def q_sample_every_parts(spark, d):
    good, _ = catalog.qualify(tables.part_catalog(spark, d))
    kept = catalog.sample_every(good, SAMPLE_EVERY, ["ordinal"])
    return frequency.build_frequency(kept)


def q_prefix_index_parts(spark, d):
    return prefix.build_index_long(freq_parts(spark, d))


def q_prefix_index_documents(spark, d):
    return prefix.build_index_long(freq_documents(spark, d))


def q_prefix_index_documents_split(spark, d):
    """The flagship in the form chosen for large inputs (shared prefixes
    through the shuffle, unshared ones emitted in place)."""
    return prefix.build_index_long(freq_documents(spark, d), split_shared=True)


def q_suggest_prefix_parts(spark, d):
    return prefix.suggest_one(freq_parts(spark, d), SUGGEST_PREFIX, "count")


def _keystroke_keys(spark, d):
    """Every keystroke asks for both rankings: aggregate the keystrokes first,
    then give each distinct prefix both ranks (same counts, half the rows)."""
    ks = tables.keystrokes(accepted_events(spark, d))
    keys = prefix.request_keys(ks.select("typed"), "typed", None)
    return keys.select("prefix", F.explode(F.array(F.lit("count"), F.lit("recent"))).alias("rank"), "n_requests")


def q_bulk_suggest_keystrokes(spark, d):
    ans = prefix.bulk_suggest(freq_parts(spark, d), _keystroke_keys(spark, d))
    return prefix.answers_long(ans)


def q_index_lookup_keystrokes(spark, d):
    f = freq_parts(spark, d)
    idx = prefix.build_index(f)
    ans = prefix.lookup(idx, f, _keystroke_keys(spark, d), TTL_SECONDS)
    return prefix.answers_long(ans)


def q_trending_count(spark, d):
    return _round(prefix.trending(live_parts(spark, d), "count", 50), "score")


def q_trending_recent(spark, d):
    return _round(prefix.trending(live_parts(spark, d), "recent", 6), "score")


def q_rank_movement(spark, d):
    live = live_parts(spark, d).checkpoint(eager=True)  # read by both top lists
    return _round(reports.rank_movement(live), "score")


def q_suggestion_movement(spark, d):
    return reports.suggestion_movement(prefix.build_index_long(live_parts(spark, d)))


def q_short_names_documents(spark, d):
    f = freq_documents(spark, d)
    return f.select("query", short_name(F.col("display")).alias("short_name"))


def q_search_validation(spark, d):
    from prefixdex.functions.predicates import validate

    ev = tables.search_events(spark, d)
    return ev.select("event_id", validate(F.col("query"), "trimmed").alias("error"))


def _flushed(spark, d):
    return events.assign_flushes(accepted_events(spark, d), ANCHOR, FLUSH_INTERVAL)


def q_flush_assignment(spark, d):
    return _flushed(spark, d).select("event_id", "tick", "flush_no")


def q_flush_summary(spark, d):
    return events.flush_summary(_flushed(spark, d))


def q_batch_stats(spark, d):
    return events.write_stats(events.flush_summary(_flushed(spark, d)), interval_seconds=FLUSH_INTERVAL)


def q_event_deltas(spark, d):
    return frequency.event_deltas(_flushed(spark, d), keys=("tick", "flush_no"))


def q_pending_view(spark, d):
    return events.pending_view(_flushed(spark, d), F.lit(now_tick(spark, d, FLUSH_INTERVAL)))


def q_upsert_events(spark, d):
    return frequency.upsert(freq_parts(spark, d), event_totals(spark, d))


def q_affected_prefixes(spark, d):
    return prefix.affected_prefixes(event_totals(spark, d))


def q_incremental_index(spark, d):
    # both feed the old index, the upsert and the refresh: derive once
    base = freq_parts(spark, d).checkpoint(eager=True)
    deltas = event_totals(spark, d).checkpoint(eager=True)
    old = prefix.build_index_long(base)
    new_freq = frequency.upsert(base, deltas)
    return prefix.refresh_index_long(old, new_freq, deltas.select("query"))


def q_decay_step(spark, d):
    return _round(decay.decay_step(freq_parts(spark, d)).select("query", "count", "score"), "score")


def q_recency_scores(spark, d):
    ev = accepted_events(spark, d)
    tick = events.tick_of("ts", ANCHOR, DAY)
    return _round(decay.recency_scores(ev, tick, now_tick(spark, d, DAY)), "score")


def q_recency_scores_minutes(spark, d):
    """The reference's own 60 s tick over the whole log."""
    ev = accepted_events(spark, d)
    tick = events.tick_of("ts", ANCHOR, decay.DECAY_INTERVAL_SECONDS)
    return _round(decay.recency_scores(ev, tick, now_tick(spark, d, decay.DECAY_INTERVAL_SECONDS)), "score")


def _ring(spark, nodes=NODES):
    return ring.ring_table(spark, list(nodes))


def _document_keys(spark, d):
    return freq_documents(spark, d).select(cache_key(F.col("query"), F.lit("count")).alias("key"))


def q_key_owner_documents(spark, d):
    return ring.assign_owner(_document_keys(spark, d), "key", _ring(spark))


def q_node_balance_documents(spark, d):
    return ring.node_balance(ring.assign_owner(_document_keys(spark, d), "key", _ring(spark)))


def q_remap_add_node_documents(spark, d):
    return ring.remap_report(_document_keys(spark, d), "key", _ring(spark), _ring(spark, (*NODES, NEW_NODE)), [NEW_NODE])


def q_remap_remove_node_documents(spark, d):
    return ring.remap_report(
        _document_keys(spark, d), "key", _ring(spark, (*NODES, NEW_NODE)), _ring(spark), removed_nodes=[NEW_NODE]
    )


def q_delete_batches_documents(spark, d):
    keys = prefix.affected_prefixes(freq_documents(spark, d))
    owned = ring.assign_owner(keys, "key", _ring(spark), hashed="hash")
    b = ring.delete_batches(owned, "key", "node", DELETE_BATCH, unique=True, hashed="hash")  # affected prefixes are distinct
    return b.select("node", "batch", "n_keys", F.element_at("keys", 1).alias("first_key"), F.element_at("keys", -1).alias("last_key"))


def q_routing_keystrokes(spark, d):
    f = freq_parts(spark, d)
    return ring.routing_report(_keystroke_keys(spark, d).filter(F.col("prefix") != ""), _ring(spark), prefix.build_index(f))


def _serving_log(spark, d):
    log = tables.serving_log(tables.search_events(spark, d))
    keyed = log.withColumn("key", cache_key(normalize(F.col("q")), F.col("rank")))
    owned = ring.assign_owner(keyed, "key", _ring(spark))
    return owned.withColumn("node", F.when(F.col("cache") == "skip", F.lit("")).otherwise(F.col("node")))


def q_hit_rate_by_node(spark, d):
    return reports.hit_rate(_serving_log(spark, d), ("node",))


def q_hit_rate_by_rank(spark, d):
    return reports.hit_rate(tables.serving_log(tables.search_events(spark, d)), ("rank",))


def q_rolling_latency(spark, d):
    r = reports.rolling_latency(_serving_log(spark, d), "node")
    return r.select("node", "event_id", "last", "p50", "p95", "samples")


def _history(spark, d):
    return history.user_history(accepted_events(spark, d))


def q_user_history(spark, d):
    return _history(spark, d)


def q_personalized_merge(spark, d):
    ev = accepted_events(spark, d)
    # requests and global answers each feed two branches of the merge
    req = tables.keystrokes(ev).select("user_id", "typed").distinct().checkpoint(eager=True)
    keys = prefix.request_keys(req.select("typed"), "typed", None)
    glob = prefix.answers_long(prefix.bulk_suggest(freq_parts(spark, d), keys)).filter(F.col("pos").isNotNull())
    return history.personalized_merge(req, _history(spark, d), glob.checkpoint(eager=True))


def q_payloads_parts(spark, d):
    """Cache key and serialized list per index entry; ``n`` decodes the
    payload again."""
    from prefixdex.functions.keys import from_payload, to_payload

    idx = prefix.build_index(freq_parts(spark, d))
    payload = to_payload("suggestions")
    return idx.select(
        "prefix",
        "rank",
        cache_key("prefix", "rank").alias("key"),
        payload.alias("payload"),
        F.size(from_payload(payload)).alias("n"),
    )


def _event_stream(spark, d, source: str | None = None, options: dict | None = None):
    """The events file (or ``source``) read as a stream, each event a search for its
    part's name (stream-static join with ``part``)."""
    source = source or f"{d.rstrip('/')}/events.parq*"
    raw = spark.readStream.schema(tables.load(spark, d, "events").schema).options(**(options or {})).parquet(source)
    part = tables.load(spark, d, "part").select("p_partkey", "p_name")
    n_parts = part.count()  # a literal: a micro-batch plan has no scalar subqueries
    return raw.join(part, (raw.event_id % n_parts) == part.p_partkey).select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("p_name").alias("query")
    )


def _tick_now(spark, d, interval: int) -> int:
    return tables.load(spark, d, "events").select(events.tick_of(F.max("ts"), ANCHOR, interval)).first()[0]


def q_recency_stream(spark, d):
    """O30s: update-mode streaming aggregation, one version per micro-batch; read
    back as the newest row per query and span of ticks."""
    from prefixdex.streaming import search_stream as ss

    root = work_dir(spark, "recency-stream")
    agg = ss.recency_stream(_event_stream(spark, d), ANCHOR, decay.DECAY_FACTOR, DAY)
    ss.write_updates(agg, f"{root}/out", f"{root}/_checkpoint", ("query", "span")).awaitTermination()
    out = ss.scores_at(ss.read_updates(spark, f"{root}/out"), _tick_now(spark, d, DAY), decay.DECAY_FACTOR)
    return _round(out, "score")


def q_window_activity_stream(spark, d):
    """Event-time windows of 6 h with a 6 h watermark: events and distinct queries
    of every window, those still open at the end included."""
    from prefixdex.streaming import search_stream as ss

    root = work_dir(spark, "window-activity")
    counts = ss.window_queries(_event_stream(spark, d), "6 hours", "6 hours")
    ss.write_updates(counts, f"{root}/out", f"{root}/_checkpoint", ("window", "query")).awaitTermination()
    newest = ss.newest_updates(ss.read_updates(spark, f"{root}/out"), "window", "query")
    return ss.window_activity(newest).select(
        events.tick_of(F.col("window.start"), ANCHOR, FLUSH_INTERVAL).alias("window_tick"), "events", "distinct_queries"
    )


def q_pending_stream(spark, d):
    """O42 as a stream: the queries in the buffer when the log ends."""
    from prefixdex.streaming import search_stream as ss

    root = work_dir(spark, "pending-stream")
    counts = ss.pending_stream(_event_stream(spark, d), ANCHOR, FLUSH_INTERVAL)
    ss.write_updates(counts, f"{root}/out", f"{root}/_checkpoint", ("tick", "q")).awaitTermination()
    return ss.pending_at(ss.read_updates(spark, f"{root}/out"), _tick_now(spark, d, FLUSH_INTERVAL))


def _ingest_parts(spark, d):
    """O1–O8 end to end: the part catalog written as a product CSV (all
    eleven text columns), then read, qualified, aggregated, written to the
    versioned store and scanned back."""
    from prefixdex.plans.ingest import ingest_catalog

    root = work_dir(spark, "ingest-csv")
    cat = tables.part_catalog(spark, d)
    cols = {c: F.lit(None).cast("string") for c in catalog.CATALOG_COLUMNS}
    cols.update({"asin": F.col("ordinal").cast("string"), "title": F.col("title"), "reviews": F.col("reviews")})
    out = cat.select(*[cols[c].alias(c) for c in catalog.CATALOG_COLUMNS], "ordinal")
    catalog.write_catalog(out, f"{root}/catalog", "ordinal", int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ingest_catalog(spark, f"{root}/catalog", f"{root}/frequency")


def q_ingest_csv_parts(spark, d):
    return _ingest_parts(spark, d)[0]


def q_ingest_profile_parts(spark, d):
    """The load profile that the ingest job's own pass has counted."""
    return _ingest_parts(spark, d)[1]


def _files_by_time(spark, d, root: str, batches: int) -> str:
    """The events dealt into files by time, one for each micro-batch, and the files' own
    times set in that order, which a stream takes them in."""
    path = f"{root}/events"
    tables.load(spark, d, "events").repartitionByRange(batches, "ts").write.parquet(path)
    fs, p = store._fs(spark, path)
    files = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
    for i, f in enumerate(files):
        fs.setTimes(store._fs(spark, f)[1], 1_700_000_000_000 + 60_000 * i, -1)
    return path


def _user_event_stream(spark, d, source: str):
    raw = spark.readStream.schema(tables.load(spark, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(source)
    raw = raw.repartition("event_id")  # a batch is one file, which one task reads
    part = tables.load(spark, d, "part").select("p_partkey", "p_name")
    n_parts = part.count()  # a literal: a micro-batch plan has no scalar subqueries
    return raw.join(part, (raw.event_id % n_parts) == part.p_partkey).select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("p_name").alias("query")
    )


def _flush_stream(spark, d, batches: int = 10):
    from prefixdex.streaming import flush_stream as fs

    root = work_dir(spark, "flush-stream")
    source = _files_by_time(spark, d, root, batches)
    fs.run_flush_stream(spark, _user_event_stream(spark, d, source), root, f"{root}/_checkpoint", ANCHOR, FLUSH_INTERVAL).awaitTermination()
    return fs.read_flushes(spark, root)


def q_flush_stream(spark, d):
    """O23 over ten micro-batches: flushes by count and timer, numbered across batches."""
    return _flush_stream(spark, d).select("event_id", "tick", "flush_no")


def q_pending_flush_stream(spark, d):
    """O42 from the flush stream: what is left after the last full flush of the open tick."""
    return events.pending_view(_flush_stream(spark, d), F.lit(_tick_now(spark, d, FLUSH_INTERVAL)))


def q_history_stream(spark, d):
    """O40 kept over ten micro-batches."""
    from prefixdex.streaming import flush_stream as fs

    root = work_dir(spark, "history-stream")
    source = _files_by_time(spark, d, root, 10)
    fs.run_history_stream(spark, _user_event_stream(spark, d, source), f"{root}/lists", f"{root}/_checkpoint").awaitTermination()
    return fs.read_history(spark, f"{root}/lists").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _run_search_stream(spark, d, interval: int = DAY, batches: int = 1, compact_every: int = 50, trending: bool = False):
    """O28 end to end: the events file read as a stream, applied by
    ``foreachBatch`` to the stored frequency table and prefix index. With more
    ``batches``, the events are first dealt into as many files by time, one for
    each micro-batch."""
    from prefixdex.streaming import search_stream as ss

    root = work_dir(spark, "search-stream")
    f_root, i_root = f"{root}/frequency", f"{root}/index"
    ss.seed_tables(freq_parts(spark, d), f_root, i_root)
    t_root = f"{root}/trending" if trending else None
    if trending:
        ss.seed_trending(spark, f_root, t_root)
    source, options = f"{d.rstrip('/')}/events.parq*", {}
    if batches > 1:
        source, options = _files_by_time(spark, d, root, batches), {"maxFilesPerTrigger": 1}
    stream = _event_stream(spark, d, source, options)
    q = ss.run_search_stream(
        spark, stream, f_root, f"{root}/_checkpoint", ANCHOR, None if trending else i_root, decay.DECAY_FACTOR, interval,
        compact_every=compact_every, trending_root=t_root,
    )
    q.awaitTermination()
    return f_root, t_root or i_root


def q_trending_stream(spark, d):
    """O16 kept over ten micro-batches and two compactions."""
    from prefixdex.streaming import search_stream as ss

    _, t_root = _run_search_stream(spark, d, batches=10, compact_every=4, trending=True)
    return _round(ss.read_trending(spark, t_root, "count", 50, _tick_now(spark, d, DAY)), "score")


def q_hit_rate_daily_stream(spark, d):
    """Serving log as a stream (events file → responses → owning node, a
    stream-static broadcast join with the ring): daily hit rate per node."""
    from prefixdex.streaming import search_stream as ss

    root = work_dir(spark, "hit-rate-stream")
    raw = spark.readStream.schema(tables.load(spark, d, "events").schema).parquet(f"{d.rstrip('/')}/events.parq*")
    part = tables.load(spark, d, "part").select("p_partkey", "p_name")
    n_parts = part.count()  # a literal: a micro-batch plan has no scalar subqueries
    ev = raw.join(part, (raw.event_id % n_parts) == part.p_partkey).select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.col("p_name").alias("query"),
    )
    log = tables.serving_log(ev).withColumn("key", cache_key(normalize(F.col("q")), F.col("rank")))
    log = ring.assign_owner(log, "key", _ring(spark))
    log = log.withColumn("node", F.when(F.col("cache") == "skip", F.lit("")).otherwise(F.col("node")))
    out = ss.hit_rate_stream(log, "1 day", "1 day")
    ss.write_updates(out, f"{root}/out", f"{root}/_checkpoint", ("window", "node")).awaitTermination()
    res = ss.newest_updates(ss.read_updates(spark, f"{root}/out"), "window", "node")
    return res.select(
        events.tick_of(F.col("window.start"), ANCHOR, DAY).alias("day"), "node", "hits", "misses", "skips", "hit_rate"
    )


def q_stream_frequency(spark, d):
    from prefixdex.streaming import search_stream as ss

    f_root, _ = _run_search_stream(spark, d)
    return _round(ss.read_frequency(spark, f_root, at=_tick_now(spark, d, DAY)), "score")


def q_stream_index(spark, d):
    """The index the stream maintained incrementally, scores at the last event's
    day; equals a full rebuild of the final table."""
    from prefixdex.streaming import search_stream as ss

    _, i_root = _run_search_stream(spark, d)
    return _round(ss.read_index(spark, i_root, at=_tick_now(spark, d, DAY)), "score")


def q_stream_index_minutes(spark, d):
    """60 s ticks, ten micro-batches and two compactions on the way."""
    from prefixdex.streaming import search_stream as ss

    _, i_root = _run_search_stream(spark, d, decay.DECAY_INTERVAL_SECONDS, batches=10, compact_every=4)
    return _round(ss.read_index(spark, i_root, at=_tick_now(spark, d, decay.DECAY_INTERVAL_SECONDS)), "score")


# ------------------------------------------------------------ document lines
# Searches for document lines against a table that holds the English ones only:
# hits, misses, blank and over-long requests, new queries and rejected rows.
STORED_PREFIXES = ("a", "th", "the", "re ", "er", "ED", "on", "in", "wh", "zz")
NOW = "2024-03-01 00:00:00"  # of the lookups; every fifth prefix length is stale by then


def freq_lines(spark, d):
    return frequency.frequency_from_catalog(tables.line_catalog(spark, d))


def _accepted_lines(spark, d):
    return events.split_valid(tables.line_events(spark, d))[0]


def q_catalog_rejects_lines(spark, d):
    c = catalog.classify(tables.line_catalog(spark, d))
    return c.groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def q_search_validation_lines(spark, d):
    from prefixdex.functions.predicates import validate

    return tables.line_events(spark, d).select("event_id", validate(F.col("query"), "trimmed").alias("error"))


def q_upsert_lines(spark, d):
    return frequency.upsert(freq_lines(spark, d), frequency.event_deltas(_accepted_lines(spark, d)))


def _line_lookup(spark, d):
    """(index, table, keys, now): the index of the stored table, part of it stale."""
    f = kept(freq_lines(spark, d), "lines")
    now = F.lit(NOW).cast("timestamp")
    age = F.when(F.length("prefix") % 5 == 0, F.lit(3600)).otherwise(F.lit(60))
    root = work_dir(spark, "line-index")
    store.write_index(prefix.build_runs(f), root)

    def index(keys):
        return store.read_index(spark, root, keys=keys).withColumn("computed_at", now - F.make_interval(secs=age))

    req = tables.typed_requests(tables.line_events(spark, d))
    return index, f, kept(prefix.request_keys(req, "typed", "rank"), "asked"), now


def _served(ans):
    return ans.select(
        "prefix", "rank", "n_requests", "status", "reason", "node",
        F.size("suggestions").alias("n"), F.get("suggestions", F.lit(0))["query"].alias("first"),
    )


def q_lookup_lines(spark, d):
    index, f, keys, now = _line_lookup(spark, d)
    return _served(prefix.lookup(index, f, keys, TTL_SECONDS, now, ring=_ring(spark)))


def q_lookup_twice_lines(spark, d):
    """The second lookup, after the first one's misses were written back."""
    index, f, keys, now = _line_lookup(spark, d)
    stored = prefix.write_back(index, prefix.lookup(index, f, keys, TTL_SECONDS, now), now)
    return _served(prefix.lookup(stored, f, keys, TTL_SECONDS, now, ring=_ring(spark)))


def q_lookup_overlay_lines(spark, d):
    """The second lookup, with the first one's misses in an overlay."""
    index, f, keys, now = _line_lookup(spark, d)
    root = work_dir(spark, "overlay")
    store.write_version(prefix.overlay_rows(prefix.lookup(index, f, keys, TTL_SECONDS, now), now), root, 0, sort_col="prefix")
    stored = prefix.overlaid(index, store.read_version(spark, root, 0))
    return _served(prefix.lookup(stored, f, keys, TTL_SECONDS, now, ring=_ring(spark)))


def q_bulk_suggest_lines(spark, d):
    """O12 with more keys than a broadcast takes (here: than none)."""
    req = tables.typed_requests(tables.line_events(spark, d))
    keys = prefix.request_keys(req, "typed", "rank")
    return prefix.answers_long(prefix.bulk_suggest(freq_lines(spark, d), keys, broadcast_max_rows=0))


def q_suggest_stored_lines(spark, d):
    """Some prefixes, each a range scan of the stored, sorted table."""
    root = work_dir(spark, "suggest-stored")
    store.write_version(freq_lines(spark, d), root, 0)
    out = None
    for p in STORED_PREFIXES:
        one = prefix.suggest_one(store.read_version(spark, root, 0), p, "count").withColumn("prefix", F.lit(p))
        out = one if out is None else out.unionByName(one)
    return out.select("prefix", "pos", "query", "count", "score")


def _stored_lines(spark, d) -> str:
    """The line table and its index, bucketed, after every search for a line in two flushes
    (by time), the second one applied twice."""
    from prefixdex.plans import stored

    root = work_dir(spark, "stored-lines")
    stored.create(freq_lines(spark, d), root)
    ev = kept(_accepted_lines(spark, d).select("event_id", "ts", "query"), "searches")
    middle = ev.agg(F.percentile(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0] or 0
    early = F.unix_micros(F.col("ts").cast("timestamp")) < F.lit(int(middle))
    for version, half in ((1, early), (2, ~early), (2, ~early)):
        stored.apply_deltas(spark, root, frequency.event_deltas(ev.filter(half)), version)
    return root


def q_upsert_store_lines(spark, d):
    """O24 in place: only the buckets of the searched queries are rewritten."""
    from prefixdex.plans import stored

    return stored.read_frequency(spark, _stored_lines(spark, d))


def q_index_store_lines(spark, d):
    """O26 in place: only the buckets of the affected prefixes are read and rewritten."""
    from prefixdex.plans import stored

    return stored.read_index(spark, _stored_lines(spark, d))


def q_prefix_index_radix(spark, d):
    """O13 path-compressed, expanded to the lists of every prefix again."""
    return radix.expand(radix.build_radix(freq_documents(spark, d)))


def q_radix_nodes_documents(spark, d):
    """The nodes of the tree by the number of queries in them, and the prefixes they stand for."""
    tree = radix.nodes(freq_documents(spark, d))
    return tree.groupBy("n_queries").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.length("label")).alias("label_chars"))


def q_radix_lookup_lines(spark, d):
    """Lookups by longest matching node: the lists of the asked prefixes of at most 40 characters."""
    from prefixdex.functions.predicates import validate

    req = tables.typed_requests(tables.line_events(spark, d)).filter(validate("typed", "raw").isNull())
    keys = prefix.request_keys(req, "typed", "rank").checkpoint(eager=True)  # else texts are made anew for each filter
    asked = keys.filter((F.col("prefix") != "") & (F.length("prefix") <= prefix.MAX_INDEXED_PREFIX))
    return radix.lookup_radix(radix.build_radix(freq_lines(spark, d)), asked)


def _placed(spark, d) -> str:
    """The document keys on three nodes, in the shared folder."""
    root = work_dir(spark, "placement")
    placement.create(_document_keys(spark, d), root, _ring(spark))
    return root


def q_rebalance_documents(spark, d):
    """O35 from the stored keys in changed intervals alone."""
    root = _placed(spark, d)
    n_keys = placement.read(spark, root).count()
    moved, _ = placement.moves(spark, root, _ring(spark, (*NODES, NEW_NODE)))
    return placement.rebalance_report(moved, n_keys, new_nodes=(NEW_NODE,))


def q_placement_documents(spark, d):
    """The stored keys and their nodes after a node has joined and another one has left."""
    root = _placed(spark, d)
    placement.rebalance(spark, root, _ring(spark, (*NODES, NEW_NODE)), 1)
    placement.rebalance(spark, root, _ring(spark, (*NODES[1:], NEW_NODE)), 2)
    return placement.read(spark, root).select("key", "node")


def q_routing_lines(spark, d):
    from prefixdex.functions.predicates import is_fresh

    index, _, keys, now = _line_lookup(spark, d)
    asked = keys.filter((F.col("prefix") != "") & F.col("reason").isNull())
    return ring.routing_report(asked, _ring(spark), index, is_fresh("computed_at", TTL_SECONDS, now))


def q_personalized_merge_lines(spark, d):
    ev = _accepted_lines(spark, d)
    req = tables.typed_requests(ev).select("user_id", "typed").distinct().checkpoint(eager=True)
    keys = prefix.request_keys(req.select("typed"), "typed", None)
    glob = prefix.answers_long(prefix.bulk_suggest(freq_lines(spark, d), keys)).filter(F.col("pos").isNotNull())
    return history.personalized_merge(req, history.user_history(ev), glob)


QUERIES = {
    "prefix_index_radix": q_prefix_index_radix,
    "radix_nodes_documents": q_radix_nodes_documents,
    "radix_lookup_lines": q_radix_lookup_lines,
    "rebalance_documents": q_rebalance_documents,
    "placement_documents": q_placement_documents,
    "catalog_rejects_lines": q_catalog_rejects_lines,
    "search_validation_lines": q_search_validation_lines,
    "upsert_lines": q_upsert_lines,
    "lookup_lines": q_lookup_lines,
    "lookup_twice_lines": q_lookup_twice_lines,
    "lookup_overlay_lines": q_lookup_overlay_lines,
    "bulk_suggest_lines": q_bulk_suggest_lines,
    "suggest_stored_lines": q_suggest_stored_lines,
    "upsert_store_lines": q_upsert_store_lines,
    "index_store_lines": q_index_store_lines,
    "flush_stream": q_flush_stream,
    "pending_flush_stream": q_pending_flush_stream,
    "history_stream": q_history_stream,
    "trending_stream": q_trending_stream,
    "routing_lines": q_routing_lines,
    "personalized_merge_lines": q_personalized_merge_lines,
    "frequency_parts": q_frequency_parts,
    "frequency_documents": q_frequency_documents,
    "catalog_rejects_parts": q_catalog_rejects_parts,
    "load_profile_parts": q_load_profile_parts,
    "dataset_size_documents": q_dataset_size_documents,
    "sample_every_parts": q_sample_every_parts,
    "prefix_index_parts": q_prefix_index_parts,
    "prefix_index_documents": q_prefix_index_documents,
    "prefix_index_documents_split": q_prefix_index_documents_split,
    "suggest_prefix_parts": q_suggest_prefix_parts,
    "bulk_suggest_keystrokes": q_bulk_suggest_keystrokes,
    "index_lookup_keystrokes": q_index_lookup_keystrokes,
    "trending_count": q_trending_count,
    "trending_recent": q_trending_recent,
    "rank_movement": q_rank_movement,
    "suggestion_movement": q_suggestion_movement,
    "short_names_documents": q_short_names_documents,
    "search_validation": q_search_validation,
    "flush_assignment": q_flush_assignment,
    "flush_summary": q_flush_summary,
    "batch_stats": q_batch_stats,
    "event_deltas": q_event_deltas,
    "pending_view": q_pending_view,
    "upsert_events": q_upsert_events,
    "affected_prefixes": q_affected_prefixes,
    "incremental_index": q_incremental_index,
    "decay_step": q_decay_step,
    "recency_scores": q_recency_scores,
    "key_owner_documents": q_key_owner_documents,
    "node_balance_documents": q_node_balance_documents,
    "remap_add_node_documents": q_remap_add_node_documents,
    "remap_remove_node_documents": q_remap_remove_node_documents,
    "delete_batches_documents": q_delete_batches_documents,
    "routing_keystrokes": q_routing_keystrokes,
    "hit_rate_by_node": q_hit_rate_by_node,
    "hit_rate_by_rank": q_hit_rate_by_rank,
    "rolling_latency": q_rolling_latency,
    "user_history": q_user_history,
    "personalized_merge": q_personalized_merge,
    "stream_frequency": q_stream_frequency,
    "stream_index": q_stream_index,
    "payloads_parts": q_payloads_parts,
    "ingest_csv_parts": q_ingest_csv_parts,
    "ingest_profile_parts": q_ingest_profile_parts,
    "recency_stream": q_recency_stream,
    "recency_scores_minutes": q_recency_scores_minutes,
    "stream_index_minutes": q_stream_index_minutes,
    "pending_stream": q_pending_stream,
    "window_activity_stream": q_window_activity_stream,
    "hit_rate_daily_stream": q_hit_rate_daily_stream,
}
