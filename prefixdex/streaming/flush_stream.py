"""Flushes of the event buffer by count or timer, and per-user histories, as streams
(O23, O40, O42).

The buffer is flushed at every tick and whenever it holds ``batch_size`` events. Over
micro-batches that takes one number for each tick: the events it has had so far, kept as
versions of a small table. A micro-batch numbers its own events within their ticks without
putting a tick into one task, adds what the ticks had before, and the number div
``batch_size`` is the flush. Events count in the order they arrive in: by batch, then by
time. A batch that is replayed is numbered as before, and written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixdex.functions.text import normalize
from prefixdex.operators import history
from prefixdex.operators.events import BATCH_SIZE, tick_of
from prefixdex.operators.ordinal import with_ordinal
from prefixdex.plans.session import broadcast_if_small
from prefixdex.sources import store, tiers
from prefixdex.streaming.search_stream import accepted, newest_of, newest_updates


def _flushes(root: str) -> str:
    return f"{root.rstrip('/')}/flushes"


def _counts(root: str) -> str:
    return f"{root.rstrip('/')}/counts"


def assign_batch(spark: SparkSession, batch: DataFrame, batch_id: int, root: str, anchor: str, interval_seconds: float, batch_size: int = BATCH_SIZE) -> bool:
    """Number one micro-batch of accepted events (``ts, event_id, query``); False if it was
    written before."""
    if store.is_committed(spark, _flushes(root), batch_id):
        return False
    rows = batch.filter(normalize(F.col("query")) != "").select("ts", "event_id", "query", tick_of("ts", anchor, interval_seconds).alias("tick"))
    rows = with_ordinal(rows, ["ts", "event_id"], ["tick"], out="_pos").checkpoint(eager=True)
    own = rows.groupBy("tick").agg(F.count(F.lit(1)).alias("n"))
    earlier = tiers.read(spark, _counts(root), batch_id)
    if earlier is None:
        had = own.select("tick", F.lit(0).cast("long").alias("had"))
    else:
        # The ticks of a batch lie close together: the stored counts are read by range.
        span = own.agg(F.min("tick").alias("lo"), F.max("tick").alias("hi")).first()
        near = earlier.where(F.col("tick").between(span["lo"] or 0, span["hi"] or 0))
        had = newest_updates(near, "tick").withColumnRenamed("upto", "had")
    before = own.join(had, "tick", "left").select("tick", "n", F.coalesce("had", F.lit(0)).alias("had")).checkpoint(eager=True)
    if not tiers.holds(spark, _counts(root), batch_id):
        upto = before.select("tick", (F.col("had") + F.col("n")).alias("upto"), F.lit(batch_id).cast("long").alias("batch"))
        store.write_version(upto, _counts(root), batch_id, sort_col="tick")
    numbered = rows.join(broadcast_if_small(before.select("tick", "had")), "tick")
    flush = F.floor((F.col("_pos") + F.col("had")) / batch_size).cast("bigint").alias("flush_no")
    store.write_version(numbered.select("ts", "event_id", "query", "tick", flush), _flushes(root), batch_id, sort_col="tick")
    tiers.merge(spark, _counts(root), batch_id, lambda df: newest_of(df, "tick"), "tick")
    return True


def run_flush_stream(spark: SparkSession, events: DataFrame, root: str, checkpoint: str, anchor: str, interval_seconds: float, batch_size: int = BATCH_SIZE):
    """Start the stream over ``event_id, ts, query`` (all that is available)."""

    def process(batch: DataFrame, batch_id: int) -> None:
        assign_batch(batch.sparkSession, batch, batch_id, root, anchor, interval_seconds, batch_size)

    w = accepted(events).writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True).start()


def read_flushes(spark: SparkSession, root: str) -> DataFrame:
    """``ts, event_id, query, tick, flush_no`` of all batches: what ``assign_flushes`` gives for
    the whole log, and what ``pending_view`` and ``flush_summary`` take."""
    return spark.read.parquet(*[store.version_path(_flushes(root), v) for v in store.committed_versions(spark, _flushes(root))])


def apply_history(spark: SparkSession, batch: DataFrame, batch_id: int, root: str, cap: int = history.HISTORY_MAX) -> bool:
    """One micro-batch of accepted searches (``user_id, ts, event_id, query``): the lists of
    its users, from their old lists and the new searches; no other list is read or written."""
    if tiers.holds(spark, root, batch_id):
        return False
    new = history.entries(batch).checkpoint(eager=True)
    earlier = tiers.read(spark, root, batch_id)
    if earlier is not None:
        users = broadcast_if_small(new.select("user_id").distinct())
        held = newest_updates(earlier.join(users, "user_id", "left_semi"), "user_id")
        new = new.unionByName(held.select("user_id", F.explode("entries").alias("e")).select("user_id", "e.q", "e._at"))
    lists = history.lists(new, cap).withColumn("batch", F.lit(batch_id).cast("long"))
    store.write_version(lists, root, batch_id, sort_col="user_id")
    tiers.merge(spark, root, batch_id, lambda df: newest_of(df, "user_id"), "user_id")
    return True


def run_history_stream(spark: SparkSession, events: DataFrame, root: str, checkpoint: str, cap: int = history.HISTORY_MAX):
    def process(batch: DataFrame, batch_id: int) -> None:
        apply_history(batch.sparkSession, batch, batch_id, root, cap)

    w = accepted(events).writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True).start()


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """``user_id, pos, q, ts``: what ``user_history`` gives for the whole log."""
    held = newest_updates(tiers.read(spark, root), "user_id")
    rows = held.select("user_id", F.posexplode("entries").alias("p", "e"))
    return rows.select("user_id", (F.col("p") + 1).alias("pos"), "e.q", F.col("e._at.ts").alias("ts"))
