"""Inputs derived from the driver's tables.

Every derived table is a plain DataFrame over the full source tables, so its
size grows with them:

* ``part_catalog``: one catalog row per part, ``title = p_name`` and
  ``reviews`` = number of ``lineitem`` rows of the part (zero-sale parts are
  rejected by the qualifying filter).
* ``document_catalog``: every line of every document is a catalog title with
  one review; whole texts, all lines.
* ``search_events``: one search per event; the searched text is the name of
  part ``event_id mod |part|``.
* ``keystrokes``: the prefixes a user typed before each search, one request
  per keystroke.
* ``line_catalog``: every line of every document, ``reviews`` by the document's
  language, so that all reject reasons occur.
* ``line_events``: one search per event for a line of a document: lines that the
  line catalog lacks, long, blank, over-long and upper-case ones.
* ``serving_log``: one suggest response per event: cache status from the
  event type, latency from ``value``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixdex.plans.session import spread

# Tables whose rows are multiplied or parsed per row downstream.
_SPREAD = {"documents", "events", "lineitem", "orders", "pages", "conversations"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in _SPREAD else df


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``title, reviews (STRING), ordinal`` — catalog rows in part-key order."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    sales = (
        load(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )
    return part.join(sales, part.p_partkey == sales.l_partkey, "left").select(
        F.col("p_name").alias("title"),
        F.coalesce(F.col("n_lines"), F.lit(0)).cast("string").alias("reviews"),
        F.col("p_partkey").alias("ordinal"),
    )


def document_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``title, reviews, ordinal`` — every line of every document, in
    (doc_id, line) order; ``ordinal`` is the struct ``(doc_id, line)``."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "title"))
    return lines.select("title", F.lit("1").alias("reviews"), F.struct("doc_id", "line_no").alias("ordinal"))


# The text in ``reviews`` of a line, by its document's language.
LINE_REVIEWS = {"en": "1", "de": "1.5", "fr": "n/a", "es": "0"}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def line_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``title, reviews, ordinal`` — every line of every document in (doc_id, line)
    order; only English lines have a usable review count."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    reviews = F.lit(None).cast("string")
    for lang, text in LINE_REVIEWS.items():
        reviews = F.when(F.col("lang") == lang, F.lit(text)).otherwise(reviews)
    lines = docs.select("doc_id", reviews.alias("reviews"), F.posexplode(F.split("text", "\n")).alias("line_no", "title"))
    return lines.select("title", "reviews", F.struct("doc_id", "line_no").alias("ordinal"))


def line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, ts, user_id, event_type, value, query``: event e searches for line
    ``e div n`` (around) of document ``e mod n``; errors search for blanks, sign-ups
    for the line repeated beyond 512 characters, purchases in capitals."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    n = load(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()
    events = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", n.alias("_n"))
    both = events.join(docs, (F.col("event_id") % F.col("_n")) == F.col("doc_id"))
    line = F.get("lines", F.expr("cast((event_id div _n) % size(lines) as int)"))
    both = both.withColumn("_line", line)
    text = (
        F.when(F.col("event_type") == "error", F.lit("  "))
        .when(F.col("event_type") == "signup", F.expr("repeat(_line, cast(1 + 512 div greatest(length(_line), 1) as int))"))
        .when(F.col("event_type") == "purchase", F.translate("_line", _LETTERS, _LETTERS.upper()))
        .otherwise(F.col("_line"))
    )
    return both.select("event_id", "ts", "user_id", "event_type", "value", text.alias("query"))


def typed_requests(events: DataFrame) -> DataFrame:
    """``user_id, typed, rank``: what was typed of each search when the list was asked
    for, 1 to 60 characters, or the whole text of a sign-up."""
    cut = F.expr("substring(query, 1, cast(1 + event_id % 60 as int))")
    typed = F.when(F.col("event_type") == "signup", F.col("query")).otherwise(cut)
    rank = F.when(F.col("event_type").isin("click", "purchase"), F.lit("recent")).otherwise(F.lit("count"))
    return events.select("user_id", typed.alias("typed"), rank.alias("rank"))


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, ts, user_id, event_type, value, query`` (``ts`` keeps the
    stored wall-clock type; ticks are computed in UTC)."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    n_parts = part.select(F.count(F.lit(1))).scalar()
    events = load(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        (F.col("event_id") % n_parts).alias("_pk"),
    )
    return events.join(part, events._pk == part.p_partkey).select(
        "event_id", "ts", "user_id", "event_type", "value", F.col("p_name").alias("query")
    )


def keystrokes(events: DataFrame, text: str = "query") -> DataFrame:
    """One suggest request per keystroke of each search text (all of it):
    ``event_id, user_id, ts, typed``."""
    return events.select(
        "event_id",
        "user_id",
        "ts",
        F.explode(
            F.expr(f"transform(sequence(1, greatest(length({text}), 1)), i -> substring({text}, 1, i))")
        ).alias("typed"),
    ).filter(F.length("typed") > 0)


# How the event type of a driver event maps to a cache outcome.
CACHE_STATUS_BY_EVENT = {
    "view": "hit",
    "click": "hit",
    "purchase": "miss",
    "signup": "miss",
    "error": "skip",
}


def serving_log(events: DataFrame) -> DataFrame:
    """``ts, event_id, q, rank, cache, latency_ms`` — one response per event."""
    status = F.lit(None).cast("string")
    for et, st in CACHE_STATUS_BY_EVENT.items():
        status = F.when(F.col("event_type") == et, F.lit(st)).otherwise(status)
    rank = F.when(F.col("event_type").isin("click", "purchase"), F.lit("recent")).otherwise(F.lit("count"))
    return events.select(
        "ts",
        "event_id",
        F.col("query").alias("q"),
        rank.alias("rank"),
        status.alias("cache"),
        F.col("value").alias("latency_ms"),
    )
