"""Derived analytics (O17 rank movement, O18 share of max score, O37 hit
rate, O39 rolling latency percentiles)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixdex.operators.ordinal import with_ordinal
from prefixdex.operators.prefix import trending

# Dashboard arrows, minimum bar width, latency sample count.
UP, DOWN, SAME = "▲", "▼", "—"
MIN_BAR_PCT = 8
LATENCY_SAMPLES = 40


def rank_movement(freq: DataFrame, recent_limit: int = 6, count_limit: int = 50) -> DataFrame:
    """O17 + O18 over the trending lists: for each of the ``recent`` top
    entries, its 0-based position there (``pos``), its position in the
    ``count`` top list (null when absent), ``delta = pos_count − pos``, the
    arrow text and the bar width ``max(8, score / max(scores, 1) · 100)``."""
    recent = trending(freq, "recent", recent_limit)
    by_count = trending(freq, "count", count_limit).select("query", F.col("pos").alias("pos_count"))
    j = recent.join(by_count, "query", "left")  # both sides hold a top list
    d = F.col("pos_count") - F.col("pos")
    arrow = (
        F.when(d > 0, F.concat(F.lit(UP), d.cast("string")))
        .when(d < 0, F.concat(F.lit(DOWN), (-d).cast("string")))
        .otherwise(F.lit(SAME))
    )
    max_score = F.greatest(F.max("score").over(Window.partitionBy(F.lit(0))), F.lit(1.0))
    width = F.round(F.greatest(F.lit(float(MIN_BAR_PCT)), F.col("score") / max_score * 100), 0).cast("bigint")
    return j.select("pos", "query", "count", "score", "pos_count", d.alias("delta"), arrow.alias("arrow"), width.alias("bar_pct"))


def suggestion_movement(index_long: DataFrame) -> DataFrame:
    """O17 for suggestion lists: per prefix, how many places each entry of
    the ``recent`` list sits above its place in the ``count`` list (only
    upward moves are marked). One pass: both positions of a (prefix, query)
    come from one partial aggregation (≤ 2 rows per key), not a self-join."""
    j = (
        index_long.groupBy("prefix", "query")
        .agg(
            F.min(F.when(F.col("rank") == "recent", F.col("pos"))).alias("pos_recent"),
            F.min(F.when(F.col("rank") == "count", F.col("pos"))).alias("pos_count"),
        )
        .filter(F.col("pos_recent").isNotNull())
    )
    d = F.col("pos_count") - F.col("pos_recent")
    return j.select(
        "prefix", "query", "pos_recent", "pos_count",
        F.when(d > 0, F.concat(F.lit(UP), d.cast("string"))).alias("arrow"),
    )


def hit_rate(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``hits, misses, skips, hit_rate`` — skips excluded, rounded
    percent, 0 when there was nothing to count."""
    agg = log.groupBy(*by).agg(
        F.count(F.when(F.col("cache") == "hit", 1)).alias("hits"),
        F.count(F.when(F.col("cache") == "miss", 1)).alias("misses"),
        F.count(F.when(F.col("cache") == "skip", 1)).alias("skips"),
    )
    total = F.col("hits") + F.col("misses")
    rate = F.when(total > 0, F.round(F.col("hits") * 100.0 / total, 0).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return agg.withColumn("hit_rate", rate)


def rolling_latency(
    log: DataFrame,
    group: str = "node",
    order: tuple[str, ...] = ("ts", "event_id"),
    value: str = "latency_ms",
    samples: int = LATENCY_SAMPLES,
) -> DataFrame:
    """For every sample (``group``, ``order`` and ``value`` columns), ``last, p50,
    p95`` over the latest ``samples`` values of its group
    (``sorted[min(n−1, floor(p·n))]``, no interpolation).

    A group may hold a third of all rows, so the window is not partitioned by
    the group alone: rows are numbered per group (:func:`with_ordinal`), cut
    into chunks of ``samples`` rows, and each chunk is windowed together with a
    copy of the previous chunk — every window partition holds ≤ 2·samples
    rows."""
    o = with_ordinal(log.select(group, *order, value), list(order), [group], out="_i")
    chunk = F.floor(F.col("_i") / samples).cast("bigint")
    # each row is its own chunk's target and the next chunk's context
    u = o.withColumn("_own_c", chunk).withColumn("_c", F.explode(F.array(chunk, chunk + 1)))
    u = u.withColumn("_own", F.col("_c") == F.col("_own_c")).drop("_own_c")
    w = Window.partitionBy(group, "_c").orderBy("_i").rowsBetween(-(samples - 1), 0)
    u = u.withColumn("_s", F.array_sort(F.collect_list(value).over(w)))
    n = F.size("_s")

    def pct(p: float):
        return F.element_at("_s", (F.least(n - 1, F.floor(F.lit(p) * n)) + 1).cast("int"))

    return (
        u.filter("_own")
        .withColumn("last", F.col(value))
        .withColumn("p50", pct(0.5))
        .withColumn("p95", pct(0.95))
        .withColumn("samples", n)
        .drop("_i", "_c", "_own", "_s")
    )
