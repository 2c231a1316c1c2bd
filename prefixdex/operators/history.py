"""Per-user search history (O40) and the personalized merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixdex.functions.text import history_key, normalize, ws_trim

# History length, entries in the "recent" view, merged list length.
HISTORY_MAX = 50
RECENT_VIEW = 6
MERGE_LIMIT = 10


def user_history(events: DataFrame, user: str = "user_id", q: str = "query", cap: int = HISTORY_MAX) -> DataFrame:
    """``user_id, pos, q, ts`` — newest first, one entry per
    case-insensitive text (the newest spelling wins), at most ``cap``.

    Dedupe is a partial aggregation; the per-user cap is a row_number filter
    that Catalyst turns into a WindowGroupLimit before the shuffle, so even a
    user with a third of all events ships ≤ cap rows per map task."""
    w = Window.partitionBy("user_id").orderBy(F.col("_at").desc())
    return (
        _latest(entries(events, user, q))
        .withColumn("pos", F.row_number().over(w))
        .filter(F.col("pos") <= cap)
        .select("user_id", "pos", "q", F.col("_at.ts").alias("ts"))
    )


def entries(events: DataFrame, user: str = "user_id", q: str = "query") -> DataFrame:
    """``user_id, q, _at`` of every search with a text."""
    e = events.select(F.col(user).alias("user_id"), ws_trim(F.col(q)).alias("q"), F.struct("ts", "event_id").alias("_at"))
    return e.filter(F.length("q") > 0)


def _latest(rows: DataFrame) -> DataFrame:
    """The newest entry of each user's case-insensitive text."""
    found = rows.groupBy("user_id", history_key(F.col("q")).alias("_k")).agg(F.max_by("q", "_at").alias("q"), F.max("_at").alias("_at"))
    return found.drop("_k")


def lists(rows: DataFrame, cap: int = HISTORY_MAX) -> DataFrame:
    """``user_id, entries`` (at most ``cap``, newest first) of entries, old or new: the newest
    ``cap`` of a list and further searches are those of all the searches."""
    w = Window.partitionBy("user_id").orderBy(F.col("_at").desc())
    kept = _latest(rows).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap)
    listed = kept.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("_n", "q", "_at"))).alias("_e"))
    return listed.select("user_id", F.transform("_e", lambda x: F.struct(x["q"].alias("q"), x["_at"].alias("_at"))).alias("entries"))


def recent_view(history: DataFrame, n: int = RECENT_VIEW) -> DataFrame:
    """The "recent searches" list: the first ``n`` history entries."""
    return history.filter(F.col("pos") <= n)


def personalized_merge(
    requests: DataFrame,
    history: DataFrame,
    global_long: DataFrame,
    limit: int = MERGE_LIMIT,
) -> DataFrame:
    """Per request ``user_id, typed``: the user's history entries whose
    lower-cased text starts with the lower-cased, trimmed input (newest
    first), then the global suggestions for the normalized input, skipping
    texts already listed (case-insensitive), at most ``limit`` in total.

    ``global_long``: ``prefix, pos, query, count, score`` for normalized
    prefixes. Output ``user_id, typed, pos, query, count, score,
    personalized``; a history entry found in the global list takes its text
    and numbers from there.

    Both lists are bounded (≤ 50 entries of a user, ≤ k of a prefix), so they are
    joined as arrays, one row per user and one per prefix: the user's entries first, of
    which a request keeps only those that match it, so that it meets its global list
    without the others and is not shuffled with that list. A request stays one
    row until its merged list is done, a much-asked prefix or user is a skewed
    join key with one row on the other side (which AQE splits), and no text is
    cut into its prefixes."""
    req = requests.select("user_id", "typed").distinct()
    req = req.withColumn("_p", history_key(F.col("typed"))).withColumn("prefix", normalize(F.col("typed")))
    req = req.filter(F.col("_p") != "")  # blank input shows the recent view instead
    # The compared texts are lower-cased once for a prefix and once for a user, not for each
    # request; entries beyond ``limit`` cannot be listed, nor can the suggestions behind them.
    key = F.lower("query").alias("k")
    listed = global_long.groupBy("prefix").agg(F.sort_array(F.collect_list(F.struct("pos", "query", "count", "score", key))).alias("_g"))
    own = history.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "q", F.lower("q").alias("k")))).alias("_h"))
    both = req.join(own, "user_id", "left")
    matching = F.slice(F.filter("_h", lambda x: x["k"].startswith(F.col("_p"))), 1, limit)
    both = both.withColumn("_h", matching).join(listed, "prefix", "left")

    def from_list(x):
        """The history entry, with the text and numbers of its twin in the list."""
        twin = F.get("_g", F.array_position("_g.k", x["k"]).cast("int") - 1)
        return F.struct(
            F.coalesce(twin["query"], x["q"]).alias("query"), twin["count"].alias("count"), twin["score"].alias("score"),
            F.lit(True).alias("personalized"),
        )

    mine = F.transform("_h", from_list)
    named = F.coalesce("_h.k", F.array().cast("array<string>"))
    rest = F.transform(
        F.filter("_g", lambda y: ~F.array_contains(named, y["k"])),
        lambda y: F.struct(y["query"].alias("query"), y["count"].alias("count"), y["score"].alias("score"), F.lit(False).alias("personalized")),
    )
    none = F.array().cast("array<struct<query:string,count:bigint,score:double,personalized:boolean>>")
    merged = F.slice(F.concat(F.coalesce(mine, none), F.coalesce(rest, none)), 1, limit)
    return (
        both.select("user_id", "typed", F.posexplode(merged).alias("_i", "_e"))
        .select("user_id", "typed", (F.col("_i") + 1).alias("pos"), "_e.query", "_e.count", "_e.score", "_e.personalized")
    )
