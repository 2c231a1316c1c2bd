"""Frequency table ``query, display, count, score`` (O5 build, O6 load
profile, O24 upsert).

``query`` is the normalized text and the key; ``display`` is the first raw
title seen for it; ``score`` starts equal to ``count``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixdex.functions.text import has_text, normalize, ws_trim
from prefixdex.sources.catalog import classify

FREQUENCY_COLUMNS = ("query", "display", "count", "score")


def build_frequency(
    qualifying: DataFrame, title: str = "title", count: str = "reviews_num", ordinal: str = "ordinal"
) -> DataFrame:
    """Sum the counts of all titles that normalize to the same query; the
    display text is the title with the smallest ordinal (first in file order).

    One shuffle on ``query``; ``sum`` and ``min_by`` aggregate partially on the
    map side, so a query repeated in a third of all rows still arrives at its
    reducer as one partial row per map task."""
    q = qualifying.filter(has_text(title)).select(
        normalize(F.col(title)).alias("query"),
        F.col(title).alias("display"),
        F.col(count).cast("bigint").alias("n"),
        F.col(ordinal).alias("ord"),
    )
    agg = q.groupBy("query").agg(
        F.min_by("display", "ord").alias("display"), F.sum("n").alias("count")
    )
    return agg.select("query", "display", "count", F.col("count").cast("double").alias("score"))


def frequency_from_catalog(catalog: DataFrame) -> DataFrame:
    """Catalog rows ``title, reviews (text), ordinal`` → frequency table."""
    c = classify(catalog)
    return build_frequency(c.filter(F.col("reject_reason").isNull()))


def load_profile(catalog: DataFrame, kept: DataFrame, freq: DataFrame, min_unique: int = 100_000) -> DataFrame:
    """O6 one-row summary: rows read, qualifying, kept after sampling, unique
    queries, count range and the below-minimum flag.

    Each input is reduced to one partial row; the rows are unioned and folded
    with ``max`` (no cross join)."""
    c = classify(catalog).agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count(F.when(F.col("reject_reason").isNull(), 1)).alias("qualifying"),
    )
    k = kept.agg(F.count(F.lit(1)).alias("kept"))
    f = freq.agg(
        F.count(F.lit(1)).alias("unique_queries"),
        F.min("count").alias("min_count"),
        F.max("count").alias("max_count"),
    )
    folded = c.unionByName(k, allowMissingColumns=True).unionByName(f, allowMissingColumns=True)
    out = folded.agg(*[F.max(x).alias(x) for x in ("rows_read", "qualifying", "kept", "unique_queries", "min_count", "max_count")])
    return out.withColumn("below_minimum", F.col("unique_queries") < F.lit(min_unique))


def event_deltas(events: DataFrame, query: str = "query", keys: tuple[str, ...] = ()) -> DataFrame:
    """``[keys…], query, display, delta`` — events aggregated per
    normalized query (optionally per flush ``keys``). ``display`` is the
    trimmed raw text of the earliest event; blank searches are ignored."""
    e = events.filter(has_text(query)).select(
        *keys,
        normalize(F.col(query)).alias("query"),
        ws_trim(F.col(query)).alias("display"),
        F.struct("ts", "event_id").alias("_at"),
    )
    return e.groupBy(*keys, "query").agg(
        F.min_by("display", "_at").alias("display"), F.count(F.lit(1)).alias("delta")
    )


def upsert(freq: DataFrame, deltas: DataFrame, score_delta: str | None = None) -> DataFrame:
    """Add ``delta`` to ``count`` and to ``score`` (or ``score_delta`` to
    ``score`` when the recency contribution differs), insert new queries with
    their first display; an existing display is never replaced.

    Union + aggregate on ``query``: one shuffle, map-side partial sums."""
    sd = F.col(score_delta) if score_delta else F.col("delta").cast("double")
    old = freq.select(
        "query",
        F.lit(0).alias("_src"),
        "display",
        F.col("count").cast("bigint").alias("count"),
        F.col("score").cast("double").alias("score"),
    )
    new = deltas.select(
        "query",
        F.lit(1).alias("_src"),
        "display",
        F.col("delta").cast("bigint").alias("count"),
        sd.alias("score"),
    )
    return (
        old.unionByName(new)
        .groupBy("query")
        .agg(
            F.min_by("display", "_src").alias("display"),
            F.sum("count").alias("count"),
            F.sum("score").alias("score"),
        )
        .select(*FREQUENCY_COLUMNS)
    )
