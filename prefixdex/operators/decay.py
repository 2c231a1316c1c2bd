"""Recency ranking (O29 decay step, O30 closed-form score).

The reference multiplies every ``score`` by ``f`` each tick and adds a
search's delta at flush time. Over an event log the same value has a closed
form, ``score(now) = Σ delta · f^(tick_now − tick_event)``. Every weight is at
most 1, so the sum is finite at any tick length and over any period (an event
so old that its weight underflows counts 0, as it does after that many
multiplications). Stored scores carry the tick they are taken at, their
``landmark``, and are moved to a later one by ``rescaled``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixdex.functions.text import normalize

# Decay factor and tick length.
DECAY_FACTOR = 0.9
DECAY_INTERVAL_SECONDS = 60


def decay_step(freq: DataFrame, factor: float = DECAY_FACTOR, steps: int = 1) -> DataFrame:
    """``score × factor^steps``; ``count`` untouched, order kept."""
    return freq.withColumn("score", F.col("score") * F.lit(float(factor) ** int(steps)))


def weight(tick: Column, at: Column, factor: float = DECAY_FACTOR) -> Column:
    """f^(at − tick): what an event of ``tick`` counts at tick ``at``."""
    return F.pow(F.lit(float(factor)), at - tick)


def rescaled(score: Column, landmark: Column, at: Column, factor: float = DECAY_FACTOR) -> Column:
    """A score taken at ``landmark``, moved to tick ``at``."""
    return score * weight(landmark, at, factor)


def recency_scores(events: DataFrame, tick: Column, now_tick: Column, factor: float = DECAY_FACTOR) -> DataFrame:
    """``query, events, score`` at ``now_tick`` from an event log
    (``query`` raw text, one delta per event). One partial aggregation on the
    normalized query."""
    e = events.select(normalize(F.col("query")).alias("query"), tick.alias("_tick"), now_tick.alias("_now")).filter(
        F.col("query") != ""
    )
    return e.groupBy("query").agg(
        F.count(F.lit(1)).alias("events"), F.sum(weight(F.col("_tick"), F.col("_now"), factor)).alias("score")
    )
