"""Search-event batching in batch form (O21 validation split, O23 flush
assignment, O27 write-reduction stats, O42 pending view).

The reference flushes its buffer every ``interval`` and whenever it holds
``batch_size`` events. Because the timer empties the buffer at each tick,
flush = (tick, position-in-tick div batch_size). Positions come from
:func:`with_ordinal`, which never puts one tick into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixdex.functions.keys import RANKS
from prefixdex.functions.predicates import validate
from prefixdex.functions.text import normalize
from prefixdex.operators.frequency import event_deltas
from prefixdex.operators.ordinal import with_ordinal
from prefixdex.operators.prefix import MAX_INDEXED_PREFIX, explode_prefixes

# Flush size and timer of the event buffer.
BATCH_SIZE = 50
FLUSH_INTERVAL_SECONDS = 2


def tick_of(ts: Column | str, anchor: str, interval_seconds: float) -> Column:
    """floor((ts − anchor) / interval); an event on a boundary opens the new tick."""
    t = F.col(ts) if isinstance(ts, str) else ts
    us = F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.lit(anchor).cast("timestamp"))
    return F.floor(us / F.lit(int(interval_seconds * 1_000_000))).cast("bigint")


def split_valid(events: DataFrame, query: str = "query", mode: str = "trimmed") -> tuple[DataFrame, DataFrame]:
    """(accepted events, rejected events with ``error``)."""
    e = events.withColumn("error", validate(F.col(query), mode))
    return e.filter(F.col("error").isNull()).drop("error"), e.filter(F.col("error").isNotNull())


def assign_flushes(
    events: DataFrame,
    anchor: str,
    interval_seconds: float = FLUSH_INTERVAL_SECONDS,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """``ts, event_id, query, tick, flush_no`` (within the tick) of accepted
    events. Events whose normalized text is empty are not buffered and get no
    flush. Only these columns are carried through the ordinals."""
    e = events.select("ts", "event_id", "query").filter(normalize(F.col("query")) != "").withColumn(
        "tick", tick_of("ts", anchor, interval_seconds)
    )
    e = with_ordinal(e, ["ts", "event_id"], ["tick"], out="_pos")
    return e.withColumn("flush_no", F.floor(F.col("_pos") / batch_size).cast("bigint")).drop("_pos")


def flush_summary(flushed: DataFrame, max_len: int = MAX_INDEXED_PREFIX) -> DataFrame:
    """Per flush: ``tick, flush_no, events, db_writes, invalidations`` —
    writes are the distinct queries, invalidations the distinct (prefix, rank)
    keys requested. Every group is one flush (≤ batch_size events).

    One pass: each (flush, query) delta is cut into its prefixes; a normalized
    query has exactly one prefix of length 1, which carries its event count,
    so events, writes and distinct prefixes come from two chained
    aggregations without a second pass or a join."""
    deltas = event_deltas(flushed, keys=("tick", "flush_no")).select("tick", "flush_no", "query", "delta")
    x = explode_prefixes(deltas, "query", max_len)
    first = F.length("prefix") == 1
    per_prefix = x.groupBy("tick", "flush_no", "prefix").agg(
        F.sum(F.when(first, F.col("delta")).otherwise(0)).alias("_events"),
        F.count(F.when(first, 1)).alias("_writes"),
    )
    return per_prefix.groupBy("tick", "flush_no").agg(
        F.sum("_events").cast("bigint").alias("events"),
        F.sum("_writes").cast("bigint").alias("db_writes"),
        (F.count(F.lit(1)) * len(RANKS)).alias("invalidations"),
    )


def write_stats(summary: DataFrame, batch_size: int = BATCH_SIZE, interval_seconds: float = FLUSH_INTERVAL_SECONDS) -> DataFrame:
    """One row of totals; ``writes_saved_pct = round((1 − writes/events)·100)``,
    0 when there were no events."""
    t = summary.agg(
        F.count(F.lit(1)).alias("flushes"),
        F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("db_writes"), F.lit(0)).alias("total_db_writes"),
        F.coalesce(F.sum("invalidations"), F.lit(0)).alias("total_invalidations"),
    )
    pct = F.when(
        F.col("total_events") > 0,
        F.round((1 - F.col("total_db_writes") / F.col("total_events")) * 100).cast("bigint"),
    ).otherwise(F.lit(0).cast("bigint"))
    return t.withColumn("writes_saved_pct", pct).withColumn("batch_size", F.lit(batch_size)).withColumn(
        "flush_interval_sec", F.lit(int(round(interval_seconds)))
    )


def pending_view(flushed: DataFrame, now_tick: Column, batch_size: int = BATCH_SIZE) -> DataFrame:
    """The events still in the buffer at ``now_tick``: those of the
    current tick's last, incomplete flush. Returns ``q`` (the buffer key, i.e.
    the normalized query), ``n`` per pending query plus ``pending_events`` and
    ``pending_queries`` on every row (the buffer holds < batch_size events, so
    the window below is tiny)."""
    cur = flushed.filter(F.col("tick") == now_tick)
    last = cur.groupBy("tick", "flush_no").agg(F.count(F.lit(1)).alias("n_ev"))
    last = last.filter(F.col("n_ev") < batch_size)
    pending = cur.join(last, ["tick", "flush_no"], "left_semi")
    per_q = event_deltas(pending).select(F.col("query").alias("q"), F.col("delta").alias("n"))
    w = Window.partitionBy(F.lit(0))
    return per_q.withColumn("pending_events", F.sum("n").over(w)).withColumn(
        "pending_queries", F.count(F.lit(1)).over(w)
    )
