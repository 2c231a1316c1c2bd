"""Search-event stream → frequency table and prefix index (O28), streaming
recency score (O30s).

Each micro-batch is one flush: its events are aggregated per normalized query
(O22) and the affected prefixes of the index are recomputed exactly
(O25/O26). Writes are proportional to the change, never to the table:

* ``<root>/base/v=<n>`` — a compacted table covering batches ``< n``
  (``v=0`` is the ingested table);
* ``<root>/delta/v=<b>`` — what micro-batch ``b`` changed: per-query deltas for
  the frequency table, complete new lists of the affected (prefix, rank) keys
  for the index.

Readers merge the newest base with the deltas after it (frequency: sum per
query; index: the newest list per key). A batch whose deltas are committed is
skipped, so a batch replayed after a failure changes nothing (effectively
once, where the reference loses its buffer on a crash). ``compact`` folds the
deltas into a new base every ``compact_every`` batches.

Recency needs no job that rewrites the table: every version's scores are taken
at its ``landmark``, the newest tick that its batch or an earlier one has seen,
which rotates with each batch. A reader moves all scores to one tick (the
newest landmark, or the tick asked for) while merging, so weights never exceed
1 but for late events, and those land on the right tick.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefixdex.functions.keys import RANKS, rank_metric
from prefixdex.functions.predicates import validate
from prefixdex.functions.text import normalize, ws_trim
from prefixdex.operators.decay import DECAY_FACTOR, DECAY_INTERVAL_SECONDS, rescaled, weight
from prefixdex.operators.events import tick_of
from prefixdex.operators.frequency import FREQUENCY_COLUMNS
from prefixdex.operators.prefix import LONG_COLUMNS, affected_prefixes, build_index_long, refresh_lists
from prefixdex.plans.session import broadcast_if_small
from prefixdex.sources import store, tiers

COMPACT_EVERY = 50
TRENDING_LIMIT = 50


def accepted(events: DataFrame, query: str = "query") -> DataFrame:
    """Validated search events (O21) with a non-empty normalized text."""
    return events.filter(validate(F.col(query), "trimmed").isNull()).filter(normalize(F.col(query)) != "")


def batch_deltas(
    batch: DataFrame,
    anchor: str,
    at: Column,
    factor: float = DECAY_FACTOR,
    decay_interval_seconds: float = DECAY_INTERVAL_SECONDS,
) -> DataFrame:
    """``query, display, delta, g``: per-query event count and its recency
    contribution at tick ``at`` (one partial aggregation)."""
    tick = tick_of("ts", anchor, decay_interval_seconds)
    e = batch.select(
        normalize(F.col("query")).alias("query"),
        ws_trim(F.col("query")).alias("display"),
        F.struct("ts", "event_id").alias("_at"),
        weight(tick, at, factor).alias("_w"),
    )
    return e.groupBy("query").agg(
        F.min_by("display", "_at").alias("display"),
        F.count(F.lit(1)).alias("delta"),
        F.sum("_w").alias("g"),
    )


# ------------------------------------------------------------------ layout
def _base(root: str) -> str:
    return f"{root.rstrip('/')}/base"


def _delta(root: str) -> str:
    return f"{root.rstrip('/')}/delta"


def _deltas(spark: SparkSession, root: str, lo: int, hi: int | None = None) -> DataFrame | None:
    """Committed deltas with ``lo <= batch < hi`` (each carries ``batch``)."""
    bs = [b for b in store.committed_versions(spark, _delta(root)) if b >= lo and (hi is None or b < hi)]
    if not bs:
        return None
    return spark.read.parquet(*[store.version_path(_delta(root), b) for b in bs])


def _base_version(spark: SparkSession, root: str, before: int | None = None) -> int:
    vs = [v for v in store.committed_versions(spark, _base(root)) if before is None or v <= before]
    if not vs:
        raise FileNotFoundError(f"no base version under {root}")
    return vs[-1]


def _marked(df: DataFrame, landmark: int) -> DataFrame:
    return df.withColumn("landmark", F.lit(int(landmark)).cast("bigint"))


def newest_landmark(spark: SparkSession, root: str, upto: int | None = None) -> int:
    """The newest landmark of the versions a reader merges (``landmark`` is one
    value in a base version and one in each delta)."""
    v = _base_version(spark, root, upto)
    marks = store.read_version(spark, _base(root), v).select("landmark").limit(1)
    d = _deltas(spark, root, v, upto)
    if d is not None:
        marks = marks.unionByName(d.select("landmark"))
    return marks.agg(F.max("landmark")).first()[0] or 0


def seed_tables(freq: DataFrame, freq_root: str, index_root: str | None = None, landmark: int = 0) -> None:
    """Base version 0: the ingested table (score = count, taken at ``landmark``)
    and its index."""
    store.write_version(_marked(freq.select(*FREQUENCY_COLUMNS), landmark), _base(freq_root), 0)
    if index_root:
        spark = freq.sparkSession
        base = store.read_version(spark, _base(freq_root), 0)
        store.write_version(_marked(build_index_long(base), landmark), _base(index_root), 0, sort_col="prefix")


def _only(df: DataFrame, keys: DataFrame | None, col: str) -> DataFrame:
    """Restrict a stored branch to ``keys`` before any merge: Catalyst does
    not push a semi-join below the merge aggregate/window, so the filter is
    applied to each branch here (map side when the key set is small)."""
    if keys is None:
        return df
    return df.join(keys, col, "left_semi")


def read_frequency(
    spark: SparkSession,
    root: str,
    upto: int | None = None,
    only: DataFrame | None = None,
    at: int | None = None,
    factor: float = DECAY_FACTOR,
) -> DataFrame:
    """Current frequency table (merge on read) with its scores at tick ``at``
    (default: the newest landmark): newest base plus the deltas of later batches
    (``< upto`` when given), optionally only for the queries in ``only`` (column
    ``query``). The base display wins; a new query takes the display of its
    earliest batch."""
    at_tick = F.lit(newest_landmark(spark, root, upto) if at is None else int(at))
    if only is not None:
        only = broadcast_if_small(only.select("query").distinct())
    v = _base_version(spark, root, upto)
    score = rescaled(F.col("score"), F.col("landmark"), at_tick, factor).alias("score")
    old = _only(store.read_version(spark, _base(root), v), only, "query").select("query", "display", "count", score)
    d = _deltas(spark, root, v, upto)
    if d is None:
        return old
    new = _only(d, only, "query").select(
        "query",
        F.col("batch").cast("bigint").alias("_src"),
        "display",
        F.col("delta").cast("bigint").alias("count"),
        rescaled(F.col("g"), F.col("landmark"), at_tick, factor).alias("score"),
    )
    return (
        old.withColumn("_src", F.lit(-1).cast("bigint"))
        .unionByName(new)
        .groupBy("query")
        .agg(F.min_by("display", "_src").alias("display"), F.sum("count").alias("count"), F.sum("score").alias("score"))
        .select(*FREQUENCY_COLUMNS)
    )


def read_index(
    spark: SparkSession,
    root: str,
    upto: int | None = None,
    prefixes: DataFrame | None = None,
    at: int | None = None,
    factor: float = DECAY_FACTOR,
) -> DataFrame:
    """Current long-form index with its scores at tick ``at`` (default: the newest
    landmark): for each (prefix, rank) the rows of the newest version that holds
    it, optionally only for ``prefixes`` (column ``prefix``). The window spans ≤ k
    rows per version of one key."""
    at_tick = F.lit(newest_landmark(spark, root, upto) if at is None else int(at))
    if prefixes is not None:
        prefixes = broadcast_if_small(prefixes.select("prefix").distinct())
    v = _base_version(spark, root, upto)
    rows = _only(store.read_version(spark, _base(root), v), prefixes, "prefix")
    d = _deltas(spark, root, v, upto)
    if d is not None:
        d = _only(d, prefixes, "prefix")
        u = rows.withColumn("batch", F.lit(-1).cast("bigint")).unionByName(d.withColumn("batch", F.col("batch").cast("bigint")))
        newest = F.max("batch").over(Window.partitionBy("prefix", "rank"))
        rows = u.withColumn("_newest", newest).filter(F.col("batch") == F.col("_newest"))
    return rows.withColumn("score", rescaled(F.col("score"), F.col("landmark"), at_tick, factor)).select(*LONG_COLUMNS)


def compact(spark: SparkSession, freq_root: str, index_root: str | None, upto: int, factor: float = DECAY_FACTOR) -> None:
    """Fold the deltas of batches ``< upto`` into base version ``upto``, all scores
    at the newest landmark. What the base before it has folded is deleted, once
    both tables have the new base; readers of the last base are not disturbed."""
    earlier = _base_version(spark, freq_root, upto - 1)
    if not store.is_committed(spark, _base(freq_root), upto):
        at = newest_landmark(spark, freq_root, upto)
        store.write_version(_marked(read_frequency(spark, freq_root, upto, at=at, factor=factor), at), _base(freq_root), upto)
    if index_root and not store.is_committed(spark, _base(index_root), upto):
        at = newest_landmark(spark, index_root, upto)
        store.write_version(_marked(read_index(spark, index_root, upto, at=at, factor=factor), at), _base(index_root), upto, sort_col="prefix")
    for root in filter(None, (freq_root, index_root)):
        store.remove_versions(spark, _base(root), earlier)
        store.remove_versions(spark, _delta(root), earlier)


def _holds(spark: SparkSession, root: str, batch_id: int) -> bool:
    """Whether the table has the batch, as a delta or in a base."""
    return store.is_committed(spark, _delta(root), batch_id) or batch_id < _base_version(spark, root)


def apply_batch(
    spark: SparkSession,
    batch: DataFrame,
    batch_id: int,
    freq_root: str,
    index_root: str | None,
    anchor: str,
    factor: float = DECAY_FACTOR,
    decay_interval_seconds: float = DECAY_INTERVAL_SECONDS,
    compact_every: int = COMPACT_EVERY,
    trending_root: str | None = None,
) -> bool:
    """One flush. Returns False when the batch was already applied. A compaction
    that a crash has left out is made up for on the replay."""
    applied = _apply(spark, batch, batch_id, freq_root, index_root, anchor, factor, decay_interval_seconds)
    if trending_root:
        refresh_trending(spark, freq_root, trending_root, batch_id, factor)
    if compact_every and (batch_id + 1) % compact_every == 0:
        compact(spark, freq_root, index_root, batch_id + 1, factor)
    return applied


def _apply(spark, batch, batch_id, freq_root, index_root, anchor, factor, decay_interval_seconds) -> bool:
    done_f = _holds(spark, freq_root, batch_id)
    done_i = index_root is None or _holds(spark, index_root, batch_id)
    if done_f and done_i:
        return False
    if not done_f:
        # The landmark rotates with the batch and never goes back.
        last = batch.agg(F.max(tick_of("ts", anchor, decay_interval_seconds))).first()[0]
        before = newest_landmark(spark, freq_root, batch_id)
        landmark = before if last is None else max(before, last)
        deltas = batch_deltas(batch, anchor, F.lit(landmark), factor, decay_interval_seconds)
        # written once, then read back by the index refresh (the micro-batch
        # itself is consumed a single time)
        marked = _marked(deltas.withColumn("batch", F.lit(batch_id).cast("bigint")), landmark)
        store.write_version(marked, _delta(freq_root), batch_id)
    deltas = store.read_version(spark, _delta(freq_root), batch_id)
    if not done_i:
        changed = deltas.select("query")
        at = newest_landmark(spark, freq_root, batch_id + 1)
        # New rows of the changed queries only (base ⋉ changed merged with the
        # deltas up to this batch) and the old lists of the affected prefixes,
        # all at this batch's landmark: the stored tables are only filtered,
        # never merged in full.
        new_rows = read_frequency(spark, freq_root, batch_id + 1, only=changed, at=at, factor=factor)
        affected = affected_prefixes(changed).select("prefix").distinct().checkpoint(eager=True)
        old_index = read_index(spark, index_root, batch_id, prefixes=affected, at=at, factor=factor)
        out = refresh_lists(old_index, new_rows, changed).withColumn("batch", F.lit(batch_id).cast("bigint"))
        store.write_version(_marked(out, at), _delta(index_root), batch_id, sort_col="prefix")
    return True


def seed_trending(spark: SparkSession, freq_root: str, trending_root: str, limit: int = TRENDING_LIMIT) -> None:
    """Version 0: the ``limit`` best rows under each ranking (O16) of base version 0."""
    at = newest_landmark(spark, freq_root)
    best = _best(_ranked(read_frequency(spark, freq_root, at=at)), limit)
    store.write_version(_marked(best, at), trending_root, 0, sort_col="rank", num_partitions=1)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.explode(F.array(*[F.lit(r) for r in RANKS])))


def _best(rows: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("rank").orderBy(rank_metric("rank").desc(), F.col("display").asc())
    return rows.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit).select("rank", "pos", *FREQUENCY_COLUMNS)


def refresh_trending(spark: SparkSession, freq_root: str, trending_root: str, batch_id: int, factor: float = DECAY_FACTOR, limit: int = TRENDING_LIMIT) -> bool:
    """The best rows after a batch, as version ``batch_id + 1``: counts only grow and scores
    are compared at one tick, so they are the best of the old list and the batch's own
    queries; the table is read for those queries only."""
    if store.is_committed(spark, trending_root, batch_id + 1):
        return False
    changed = store.read_version(spark, _delta(freq_root), batch_id).select("query")
    at = newest_landmark(spark, freq_root, batch_id + 1)
    new = read_frequency(spark, freq_root, batch_id + 1, only=changed, at=at, factor=factor)
    old = store.read_version(spark, trending_root, batch_id)
    old = old.withColumn("score", rescaled(F.col("score"), F.col("landmark"), F.lit(at), factor))
    kept = old.select("rank", *FREQUENCY_COLUMNS).join(changed, "query", "left_anti")
    best = _best(kept.unionByName(_ranked(new).select("rank", "query", "display", "count", "score")), limit)
    store.write_version(_marked(best, at), trending_root, batch_id + 1, sort_col="rank", num_partitions=1)
    store.remove_versions(spark, trending_root, batch_id)
    return True


def read_trending(spark: SparkSession, trending_root: str, rank: str, limit: int, at: int, factor: float = DECAY_FACTOR) -> DataFrame:
    """``pos`` (from 0), ``query, count, score``, as :func:`trending` gives them for the table."""
    rows = store.read_version(spark, trending_root).filter((F.col("rank") == rank) & (F.col("pos") <= limit))
    score = rescaled(F.col("score"), F.col("landmark"), F.lit(at), factor).alias("score")
    return rows.select((F.col("pos") - 1).alias("pos"), F.col("display").alias("query"), "count", score)


def run_search_stream(
    spark: SparkSession,
    events: DataFrame,
    freq_root: str,
    checkpoint: str,
    anchor: str,
    index_root: str | None = None,
    factor: float = DECAY_FACTOR,
    decay_interval_seconds: float = DECAY_INTERVAL_SECONDS,
    processing_time: str | None = None,
    compact_every: int = COMPACT_EVERY,
    trending_root: str | None = None,
):
    """Start the stream (``availableNow`` unless ``processing_time`` such
    as ``"2 seconds"`` is given). ``events`` is a streaming DataFrame with
    ``event_id, ts, query``; ``freq_root`` must hold base version 0."""

    def process(batch: DataFrame, batch_id: int) -> None:
        apply_batch(
            spark, batch, batch_id, freq_root, index_root, anchor, factor, decay_interval_seconds, compact_every, trending_root
        )

    w = accepted(events).writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    return w.start()


#: Ticks of one span of streaming recency state: f^−1024 is far from overflow.
SPAN_TICKS = 1024


def recency_stream(
    events: DataFrame,
    anchor: str,
    factor: float = DECAY_FACTOR,
    decay_interval_seconds: float = DECAY_INTERVAL_SECONDS,
    span_ticks: int = SPAN_TICKS,
) -> DataFrame:
    """O30s as a plain streaming aggregation (update mode): per normalized
    query and span of ``span_ticks`` ticks the event count and the score at the
    span's last tick, so every weight is at most 1. State is one row per query
    and span it was searched in; no custom state code."""
    tick = tick_of("ts", anchor, decay_interval_seconds)
    span = F.floor(tick / F.lit(span_ticks)).cast("bigint")
    e = accepted(events).select(
        normalize(F.col("query")).alias("query"), span.alias("span"), weight(tick, (span + 1) * span_ticks - 1, factor).alias("_w")
    )
    return e.groupBy("query", "span").agg(F.count(F.lit(1)).alias("events"), F.sum("_w").alias("g"))


def scores_at(updates: DataFrame, now_tick: int, factor: float = DECAY_FACTOR, span_ticks: int = SPAN_TICKS) -> DataFrame:
    """``query, events, score`` at ``now_tick`` from the updates of
    :func:`recency_stream`, a ``batch`` column telling which of a (query, span)'s
    updates is the newest (aggregated, so a much-searched query's updates meet
    in partial maxima, not in one window)."""
    newest = updates.groupBy("query", "span").agg(F.max_by(F.struct("events", "g"), "batch").alias("u"))
    at_end = (F.col("span") + 1) * span_ticks - 1
    score = rescaled(F.col("u.g"), at_end, F.lit(int(now_tick)), factor)
    return newest.groupBy("query").agg(F.sum("u.events").alias("events"), F.sum(score).alias("score"))


def newest_of(updates: DataFrame, *keys: str) -> DataFrame:
    """The newest row (by ``batch``, which stays) of every key."""
    rest = [c for c in updates.columns if c not in keys]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_u"))
    return newest.select(*keys, "_u.*")


def update_sink(root: str, keys: tuple[str, ...]):
    """A ``foreachBatch`` function: batch b of an update-mode query becomes version b of
    ``root``, and versions are merged in tiers, where only the newest row of each of ``keys``
    is kept. A replayed batch changes nothing."""

    def sink(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        if not tiers.holds(spark, root, batch_id):
            store.write_version(df.withColumn("batch", F.lit(batch_id).cast("bigint")), root, batch_id, sort_col=keys[0])
        tiers.merge(spark, root, batch_id, lambda rows: newest_of(rows, *keys), keys[0])

    return sink


def write_updates(updates: DataFrame, root: str, checkpoint: str, keys: tuple[str, ...]):
    """Start an update-mode query into :func:`update_sink`; ``keys`` are its grouping keys."""
    w = updates.writeStream.outputMode("update").foreachBatch(update_sink(root, keys)).option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True).start()


def read_updates(spark: SparkSession, root: str) -> DataFrame:
    return tiers.read(spark, root)


def newest_updates(updates: DataFrame, *keys: str) -> DataFrame:
    """The newest update of every key: windows still open as they stand now."""
    return newest_of(updates, *keys).drop("batch")


def window_queries(events: DataFrame, window: str = "6 hours", lateness: str = "6 hours") -> DataFrame:
    """Per event-time window and query the searches so far, for update mode: the
    watermark bounds the state, windows that are still open are reported with
    every batch, and a late event within ``lateness`` counts in its own window."""
    e = accepted(events).select("ts", normalize(F.col("query")).alias("query")).withWatermark("ts", lateness)
    return e.groupBy(F.window("ts", window).alias("window"), "query").agg(F.count(F.lit(1)).alias("n"))


def window_activity(counts: DataFrame) -> DataFrame:
    """``window, events, distinct_queries`` (the writes one flush per window would
    make) from the newest :func:`window_queries`."""
    return counts.groupBy("window").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("distinct_queries"))


def pending_stream(events: DataFrame, anchor: str, interval_seconds: float, lateness: str = "6 hours") -> DataFrame:
    """O42 as a stream (update mode): per buffer interval and query the searches
    not yet flushed by the timer; ``pending_at`` reads the open interval."""
    e = accepted(events).withWatermark("ts", lateness)
    tick = tick_of("ts", anchor, interval_seconds).alias("tick")
    return e.groupBy(F.window("ts", f"{int(interval_seconds)} seconds").alias("window"), tick, normalize(F.col("query")).alias("q")).agg(
        F.count(F.lit(1)).alias("n")
    )


def pending_at(updates: DataFrame, now_tick: int) -> DataFrame:
    """``q, n`` of the interval that is open at ``now_tick``."""
    return newest_updates(updates, "tick", "q").filter(F.col("tick") == int(now_tick)).select("q", "n")


def hit_rate_stream(log: DataFrame, window: str = "1 day", lateness: str = "1 day", by: tuple[str, ...] = ("node",)) -> DataFrame:
    """O37 over event time: per window (and ``by``) the hits, misses, skips
    and rounded hit rate of a serving-log stream. In append mode a window is
    emitted once the watermark has passed it; in update mode
    (:func:`write_updates`) open windows are reported with every batch."""
    agg = (
        log.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window).alias("window"), *by)
        .agg(
            F.count(F.when(F.col("cache") == "hit", 1)).alias("hits"),
            F.count(F.when(F.col("cache") == "miss", 1)).alias("misses"),
            F.count(F.when(F.col("cache") == "skip", 1)).alias("skips"),
        )
    )
    total = F.col("hits") + F.col("misses")
    rate = F.when(total > 0, F.round(F.col("hits") * 100.0 / total, 0).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return agg.withColumn("hit_rate", rate)
