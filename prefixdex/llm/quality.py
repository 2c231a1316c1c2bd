"""Quality rules with adaptive thresholds from mergeable quantile sketches.

For every document five rates are measured in thousandths or hundredths, as
integers. A sketch is the histogram of a rate over integer bins whose width
grows with the value (seven leading bits are kept, so a quantile is off by
less than 1 %): sketches of any two sets of documents merge by adding their
counts. There is one sketch for each language and source; a group with fewer
than ``min_docs`` documents uses the merged sketch of its language and, if that
is small too, of all documents.

A rate's upper fence is ``median + spread * width``, and likewise below for the word
length, where the width is the sketch's own: the distance from the median to the ``high``
quantile, or a tenth of the median if that is more. (A small floor keeps the fence off the
median where most documents have the same rate.) So a fence lies below the cutoff of the
base rules where a group's documents are clean. Documents outside a fence fail, those that
fail the fixed base rules fail anyway. The fences are then joined to the documents by
language and source.

Only built-in DataFrame functions are used.

Defined cases: a null or empty text has no words; null language or source is a group
of its own; rows that repeat a doc_id, a null one too, count and are judged each; equal
rates (ties) share a bin; texts of any length are read whole; an empty table gives an
empty result; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixdex.llm import tables

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30  # percent
MIN_DOCS = 200
HIGH = 75  # percent
SPREAD = 6
PART = 10  # the least width is this part of the median

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: rate: (numerator, factor, denominator, least width, has a lower fence)
RATES = {
    "word_length": ("word_chars", 100, "n_words", 20, True),
    "symbol_rate": ("n_symbols", 1000, "n_words", 20, False),
    "dup_line_rate": ("n_dup_lines", 1000, "n_text_lines", 40, False),
    "repeat_rate": ("n_repeat_words", 1000, "n_words", 30, False),
}
QUANTILES = {"low": 100 - HIGH, "mid": 50, "high": HIGH}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("body"))
    base = base.withColumn("bare", F.trim("body", F.lit(_SPACE)))
    base = base.withColumn("words", F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", r"[\x20\x09-\x0D]+")))
    lines = F.filter(F.split("body", "\n", -1), lambda x: F.trim(x, F.lit(_SPACE)) != "")
    base = base.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("body", _SPACE, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashed"),
    )
    windows = F.when(
        F.size("hashed") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("hashed") - WINDOW), lambda i: F.xxhash64(*[F.get("hashed", i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("windows", windows)
    # Most texts repeat no window; only for the others are the positions sorted out.
    repeats = F.size("windows") != F.size(F.array_distinct("windows"))
    placed = F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    base = base.withColumn("placed", F.when(repeats, placed))
    size = F.size("placed")
    twice = F.filter(
        F.transform("placed", lambda x, j: F.when((x["w"] == F.get("placed", j - 1)["w"]) | (x["w"] == F.get("placed", j + 1)["w"]), x["i"])),
        lambda x: x.isNotNull(),
    )
    base = base.withColumn("starts", F.when(size > 0, F.sort_array(twice)))
    covered = F.aggregate(
        F.transform("starts", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    return base.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_text_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def _rate(name: str) -> Column:
    top, factor, bottom, _, _ = RATES[name]
    return F.expr(f"{factor} * {top} div greatest({bottom}, 1)").alias(name)


def _bin(value: Column) -> Column:
    """The value with its seven leading bits: the lower end of its bin."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, rate, bin, n): the sketch of every group. Sketches of
    several tables are merged by ``merge``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), _bin(F.col(r)).alias("bin")) for r in RATES])).alias("p")
    rows = measured.where(~base_failed()).select("lang", "source", *[_rate(r) for r in RATES]).select("lang", "source", pairs)
    return rows.groupBy("lang", "source", "p.rate", "p.bin").agg(F.count(F.lit(1)).alias("n"))


def merge(*parts: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The sketches of all parts together, for the groups ``by``."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The three quantiles of every group and rate, and its size."""
    over = Window.partitionBy(*by, "rate")
    up = sketch.withColumn("upto", F.sum("n").over(over.orderBy("bin"))).withColumn("size", F.sum("n").over(over))
    first = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("size"), F.col("bin")))
    return up.groupBy(*by, "rate").agg(*[first(q).alias(c) for c, q in QUANTILES.items()], F.max("size").alias("size"))


def fences(sketch: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row for each language and source: the lowest and highest value allowed
    of every rate."""
    own = quantiles(sketch, ("lang", "source"))
    wider = quantiles(merge(sketch, by=("lang",)), ("lang",)).select(F.col("lang").alias("l"), F.col("rate").alias("r"), F.struct(*QUANTILES, "size").alias("lang_q"))
    every = quantiles(merge(sketch, by=()), ()).select(F.col("rate").alias("e"), F.struct(*QUANTILES, "size").alias("all_q"))
    rows = own.join(wider, own["lang"].eqNullSafe(F.col("l")) & (own["rate"] == F.col("r"))).join(every, F.col("rate") == F.col("e"))
    chosen = F.when(F.col("size") >= min_docs, F.struct(*QUANTILES, "size")).when(F.col("lang_q.size") >= min_docs, F.col("lang_q")).otherwise(F.col("all_q"))
    rows = rows.select("lang", "source", "rate", chosen.alias("q"))
    aggs = []
    for rate, (_, _, _, least, below) in RATES.items():
        is_it = F.col("rate") == rate
        up = F.expr(f"q.mid + {SPREAD} * greatest(q.high - q.mid, q.mid div {PART}, {least})")
        aggs.append(F.max(F.when(is_it, up)).alias(f"{rate}_max"))
        if below:
            down = F.expr(f"q.mid - {SPREAD} * greatest(q.mid - q.low, q.mid div {PART}, {least})")
            aggs.append(F.max(F.when(is_it, down)).alias(f"{rate}_min"))
    return rows.groupBy(F.col("lang").alias("f_lang"), F.col("source").alias("f_source")).agg(*aggs)


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with base_failed, the failed rules and kept."""
    rows = measured.withColumn("base_failed", base_failed())
    rows = rows.join(limits, rows["lang"].eqNullSafe(F.col("f_lang")) & rows["source"].eqNullSafe(F.col("f_source")), "left")
    failed = []
    for rate, (_, _, _, _, below) in RATES.items():
        out = _rate(rate) > F.col(f"{rate}_max")
        failed.append(F.when(out | (_rate(rate) < F.col(f"{rate}_min")) if below else out, F.lit(rate)))
    rows = rows.withColumn("failed_rules", F.array_compact(F.array(*failed)))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return rows.select(*measured.columns, "base_failed", "failed_rules", "kept")


def score(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    measured = tables.save(measures(docs), "measures")
    return judge(measured, tables.save(fences(sketches(measured), min_docs), "fences"))
