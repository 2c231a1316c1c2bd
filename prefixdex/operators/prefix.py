"""Prefix top-k: the flagship index (O13, direct and split forms, array and
long layouts), one-prefix lookup (O9), bulk lookup (O12), index lookup with
fall-through (O15), trending (O16), affected prefixes (O25), plain
invalidation and the exact incremental refresh (O26).

Every ranking orders by the rank's metric descending, then by the display
text ascending (the reference leaves ties unordered; the display is unique per
normalized query, so this makes every list deterministic). The ``query`` of a
suggestion is the display text. Exploded candidates carry no text but their
prefix: the table is sorted by display once, and a number in that order stands
for the display in the ranking and brings text and counts back to the rows that
are in a list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefixdex.functions.keys import RANKS, cache_key, parse_rank, rank_metric
from prefixdex.functions.predicates import has_prefix, is_fresh, validate
from prefixdex.functions.text import normalize, normalize_literal
from prefixdex.plans.session import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, broadcast_if_small

# List length and the longest indexed prefix.
SUGGEST_LIMIT = 10
MAX_INDEXED_PREFIX = 40

LONG_COLUMNS = ("prefix", "rank", "pos", "query", "count", "score")
SUGGESTION_TYPE = "array<struct<query:string,count:bigint,score:double>>"


def _prefix_lengths_expr(query: Column, max_len: int, lengths: Sequence[int] | None, min_len: int = 1) -> Column:
    """Lengths at which to cut ``query``: min_len..min(len, max_len), or only the
    listed ``lengths`` that fit."""
    top = F.least(F.length(query), F.lit(max_len))
    if lengths is None:
        return F.when(top >= min_len, F.sequence(F.lit(min_len), top))
    arr = F.array(*[F.lit(int(n)) for n in sorted(set(lengths))])
    return F.filter(arr, lambda n: (n >= min_len) & (n <= top))


def explode_prefixes(
    df: DataFrame,
    query: str = "query",
    max_len: int = MAX_INDEXED_PREFIX,
    lengths: Sequence[int] | None = None,
    min_len: int = 1,
) -> DataFrame:
    """One row per (row, prefix of ``query``) of length min_len..min(len, max_len);
    prefixes ending in a space are dropped (a normalized prefix never ends in
    one, so such keys are never asked for)."""
    q = F.col(query)
    out = df.filter(F.length(q) >= 1).withColumn(
        "_plen", F.explode(_prefix_lengths_expr(q, max_len, lengths, min_len))
    )
    out = out.withColumn("prefix", q.substr(F.lit(1), F.col("_plen"))).drop("_plen")
    return out.filter(~F.col("prefix").endswith(" "))


def _top_k(cands: DataFrame, k: int, *by: str) -> DataFrame:
    """Top-k per (prefix, rank), in each group ``by`` if given, of rows with their text."""
    w = Window.partitionBy("prefix", "rank", *by).orderBy(rank_metric("rank").desc(), F.col("query").asc())
    return cands.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


# Prefixes short enough to be hot, and the groups their candidates are dealt into.
SHORT_PREFIX = 2
SHORT_GROUPS = 32


def _numbered(freq: DataFrame) -> DataFrame:
    """``query, display, count, score, _ord``: ``_ord`` ascends with the display. It
    depends on the physical order, so the rows are written before it is used."""
    rows = freq.select("query", "display", "count", "score").repartitionByRange("display").sortWithinPartitions("display")
    return rows.withColumn("_ord", F.monotonically_increasing_id()).checkpoint(eager=True)


def _narrow(numbered: DataFrame, ranks: Sequence[str], *more: str) -> DataFrame:
    """``_key`` (normalized query, cut into prefixes and then dropped), ``rank``,
    ``_m`` (the rank's metric), ``_ord``: nothing as wide as the display."""
    entries = F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), _metric(r).alias("m")) for r in ranks])).alias("e")
    rows = numbered.select(F.col("query").alias("_key"), "_ord", *more, entries)
    return rows.select("_key", "_ord", *more, F.col("e.rank").alias("rank"), F.col("e.m").alias("_m"))


def _metric(rank: str) -> Column:
    return F.col("score" if rank == "recent" else "count").cast("double")


def _cut(rows: DataFrame, max_len: int, lengths: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates of the short prefixes and of all others, each cut by itself."""
    short = explode_prefixes(rows, "_key", min(SHORT_PREFIX, max_len), lengths)
    return short.drop("_key"), explode_prefixes(rows, "_key", max_len, lengths, SHORT_PREFIX + 1).drop("_key")


def _top_numbers(short: DataFrame, long: DataFrame, k: int) -> DataFrame:
    """``prefix, rank, pos, _ord`` of the top-k per (prefix, rank). ``row_number() <= k``
    lets Catalyst insert a WindowGroupLimit on both sides of the shuffle, so a
    prefix ships at most k rows per map task; the short prefixes, which every
    map task has, are first cut to k in each of some groups."""
    best = [F.col("_m").desc(), F.col("_ord").asc()]
    grouped = short.withColumn("_group", F.pmod("_ord", F.lit(SHORT_GROUPS)))
    first = Window.partitionBy("prefix", "rank", "_group").orderBy(*best)
    grouped = grouped.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).drop("_n", "_group")
    w = Window.partitionBy("prefix", "rank").orderBy(*best)
    both = long.unionByName(grouped)
    return both.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k).select("prefix", "rank", "pos", "_ord")


def _with_text(top: DataFrame, numbered: DataFrame) -> DataFrame:
    """Text and numbers of the rows in a list (broadcast when the table is measured
    small, else an equi-join on the unique number)."""
    texts = broadcast_if_small(numbered.select("_ord", F.col("display").alias("query"), "count", "score"))
    return top.join(texts, "_ord").select(*LONG_COLUMNS)


def _candidates(freq: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """``_key`` (normalized query), ``query`` (display), ``count``, ``score``, ``rank``."""
    return freq.select(
        F.col("query").alias("_key"),
        F.col("display").alias("query"),
        "count",
        "score",
        F.explode(F.array(*[F.lit(r) for r in ranks])).alias("rank"),
    )


def _explode_candidates(
    freq: DataFrame, ranks: Sequence[str], max_len: int, lengths: Sequence[int] | None = None
) -> DataFrame:
    return explode_prefixes(_candidates(freq, ranks), "_key", max_len, lengths).drop("_key")


# Consecutive rows of the sorted table whose candidates one task ranks.
NEIGHBOUR_CHUNK = 4096


def _lcp(a: Column, b: Column, max_len: int) -> Column:
    """Length of the common prefix of two strings, capped at ``max_len``
    (0 when either is null): bit by bit, from the highest one."""
    n = F.least(F.length(a), F.length(b), F.lit(max_len))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max_len.bit_length()))])
    one = F.lit(1)
    run = F.aggregate(
        steps,
        F.lit(0),
        lambda acc, step: F.when((acc + step <= n) & (a.substr(one, acc + step) == b.substr(one, acc + step)), acc + step).otherwise(acc),
    )
    return F.when(a.isNull() | b.isNull(), F.lit(0)).otherwise(run)


def _with_branches(rows: DataFrame) -> DataFrame:
    """``_ends``: the lengths, ascending, at which prefixes that a key shares inside its range
    branch off, for rows sorted by ``_key`` as :func:`_ranged` takes them: what a key shares with
    another one is the least that neighbours share between them. ``_head`` and ``_tail``: what
    it shares with the first and the last key of its range."""
    size = NEIGHBOUR_CHUNK

    def common(a, b):
        n = min(len(a), len(b))
        return next((i for i in range(n) if a[i] != b[i]), n)

    def branches(keys):
        met = [set() for _ in keys]
        shared = [common(a, b) for a, b in zip(keys, keys[1:], strict=False)]
        head, tail = accumulate([len(keys[0]), *shared], min), accumulate([len(keys[-1]), *reversed(shared)], min)
        for steps in (range(1, len(keys)), range(len(keys) - 2, -1, -1)):
            above = []
            for i in steps:
                n = shared[i - 1 if steps.step > 0 else i]
                while above and above[-1] >= n:
                    above.pop()
                above.append(n)
                met[i].update(above)
        return [sorted(x - {0}) for x in met], list(head), list(tail)[::-1]

    def marked(held):
        found = branches([k for b in held for k in b.column(0).to_pylist()])
        new = [pa.array(x, t) for x, t in zip(found, (pa.list_(pa.int32()), pa.int32(), pa.int32()), strict=True)]
        lo = 0
        for b in held:
            yield pa.RecordBatch.from_arrays([*b.columns, *(x.slice(lo, b.num_rows) for x in new)], [*b.schema.names, "_ends", "_head", "_tail"])
            lo += b.num_rows

    def run(batches):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, size - n))
                n, batch = n + held[-1].num_rows, batch.slice(size - n)
                if n == size:
                    yield from marked(held)
                    held, n = [], 0
        if held:
            yield from marked(held)

    rows = rows.select("_key", *[c for c in rows.columns if c != "_key"])
    more = T.StructType.fromDDL("_ends array<int>, _head int, _tail int")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more.fields]))


def _sorted_keys(freq: DataFrame, max_len: int) -> DataFrame:
    rows = freq.filter(F.length("query") >= 1).repartitionByRange("query").sortWithinPartitions("query")
    return rows.select(F.col("query").substr(1, max_len).alias("_key"), F.col("display").alias("query"), "count", "score")


def _open(max_len: int) -> Column:
    return F.greatest(*[_lcp(F.col("_key"), F.col(c), max_len) for c in ("_before", "_after")])


def in_branches(freq: DataFrame, max_len: int = MAX_INDEXED_PREFIX) -> tuple[DataFrame, int]:
    """The rows of :func:`in_ranges` with ``_ends``, the lengths at which prefixes that they share
    inside their range branch off, and the number of ranges. The rows are written, so that
    nothing is compared again, and not dealt to the ranges yet.

    What a key shares with the one before its range is the least of what that one shares
    with the range's first key and the first key with it; so only the ends are compared."""
    rows, n = _ranged(_with_branches(_sorted_keys(freq, max_len)), max_len)
    rows = rows.withColumn("_open", F.greatest(F.least("_head", "_low"), F.least("_tail", "_high")))
    return rows.withColumn("_shared", F.greatest("_open", F.array_max("_ends"))).drop("_head", "_tail", "_low", "_high"), n


def in_ranges(freq: DataFrame, max_len: int = MAX_INDEXED_PREFIX) -> DataFrame:
    """``_range, _ord, _key, query, count, score, _open, _shared``: the table sorted by query
    in ranges of at most ``NEIGHBOUR_CHUNK`` consecutive rows, each in one task (the frame is
    partitioned by ``_range``). ``_ord`` numbers the rows in that order, ``_key`` is the
    indexed part of the query, ``query`` the display text.

    Queries sharing a prefix are contiguous in sorted order, so the prefixes that a query
    shares with others are those that it shares with one of its neighbours (up to
    ``_shared`` characters), and those that go on in another range are shared with the
    last query before the range or the first one after it (up to ``_open``)."""
    dealt, key = _dealt(_sorted_keys(freq, max_len)), F.col("_key")
    dealt = dealt.withColumn("_open", _open(max_len))
    inside = F.greatest(*[_lcp(key, F.col(c), max_len) for c in ("_prev", "_next")])
    return dealt.withColumn("_shared", F.greatest("_open", inside)).drop("_before", "_after", "_prev", "_next")


def _ranged(rows: DataFrame, max_len: int | None = None) -> tuple[DataFrame, int]:
    """Rows that are sorted by ``_key``, in ranges of at most ``NEIGHBOUR_CHUNK`` of them: ``_range``,
    the row's number ``_ord``, the last key before the range and the first one after it
    (given ``max_len``, what the range's ends share with these: ``_low``, ``_high``); and
    the number of ranges."""
    order = F.monotonically_increasing_id()  # partition and, in the low 33 bits, position
    rows = rows.select(order.alias("_ord"), "*")
    position = F.col("_ord").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.withColumn("_range", F.col("_ord") - position + F.floor(position / NEIGHBOUR_CHUNK)).checkpoint(eager=True)
    w = Window.orderBy("_range")  # one row a range
    ends = rows.groupBy("_range").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last"))
    ends = ends.select("_range", "_first", "_last", F.lag("_last").over(w).alias("_before"), F.lead("_first").over(w).alias("_after"))
    outside = ["_before", "_after"] if max_len is None else [_lcp(F.col(a), F.col(b), max_len).alias(c) for a, b, c in (("_before", "_first", "_low"), ("_last", "_after", "_high"))]
    ends = ends.select("_range", *outside).checkpoint(eager=True)
    return rows.join(broadcast_if_small(ends), "_range"), max(1, ends.count())


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows of :func:`_ranged`, each range in one task, with their neighbours ``_prev`` and
    ``_next`` in the range."""
    rows, n = _ranged(rows)
    key, near = F.col("_key"), Window.partitionBy("_range").orderBy("_key")
    return rows.repartitionByRange(n, "_range").withColumn("_prev", F.lag(key).over(near)).withColumn("_next", F.lead(key).over(near))


def with_ranks(rows: DataFrame, ranks: Sequence[str] = RANKS) -> DataFrame:
    return rows.withColumn("rank", F.explode(F.array(*[F.lit(r) for r in ranks])))


def cut_key(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """One row per prefix of ``_key`` with lo..hi characters (none when hi < lo) that does
    not end in a space."""
    cut = rows.withColumn("_plen", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    cut = cut.withColumn("prefix", F.col("_key").substr(F.lit(1), F.col("_plen"))).drop("_plen")
    return cut.filter(~F.col("prefix").endswith(" "))


def _lists(rows: DataFrame, k: int, ranks: Sequence[str], min_len: int, all_ranked: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lists in long form: of the prefixes that several ranges have (cut to k in each
    range, then shuffled), of the other ones, ranked where they are (``_range`` is kept),
    and the rows with the length ``_lo`` from which on their prefixes are their own.
    ``all_ranked`` sends those through the ranking too."""
    entries = with_ranks(rows, ranks)
    open_, shared, end = F.col("_open"), F.col("_shared"), F.length("_key")
    least = F.lit(min_len)
    several = _top_k(_top_k(cut_key(entries, least, open_), k, "_range"), k)
    within = _top_k(cut_key(entries, F.greatest(open_ + 1, least), end if all_ranked else shared), k, "_range")
    alone = rows.withColumn("_lo", F.greatest(shared + 1, least)).filter(F.col("_lo") <= end)
    return several, within, alone


def build_index_long(
    freq: DataFrame,
    k: int = SUGGEST_LIMIT,
    max_len: int = MAX_INDEXED_PREFIX,
    ranks: Sequence[str] = RANKS,
    split_shared: bool = False,
    min_len: int = 1,
) -> DataFrame:
    """O13 in long form: ``prefix, rank, pos, query, count, score`` for every
    prefix of length min_len..max_len of every query, both ranks, top k each.

    The table is sorted once, in ranges (:func:`in_ranges`); a prefix is ranked in the
    range that has it, and only the few that go on in another range are shuffled, cut
    to k rows a range. So the shuffles carry each query a few times, not each of its
    prefixes.

    Direct form: every candidate (query × prefix × rank) goes through the top-k window.

    Split form (``split_shared``, the caller's choice; equal results): only prefixes a
    query shares with another query do; the longer ones are its alone, so their
    one-entry lists are emitted where the query is, with no sort. On text-like queries
    most of the ≤ 40 prefixes are unshared (three quarters on the document catalog)."""
    several, within, alone = _lists(in_ranges(freq, max_len), k, ranks, min_len, not split_shared)
    out = several.select(*LONG_COLUMNS).unionByName(within.select(*LONG_COLUMNS))
    if not split_shared:
        return out
    alone = cut_key(with_ranks(alone, ranks), F.col("_lo"), F.length("_key"))
    return out.unionByName(alone.withColumn("pos", F.lit(1)).select(*LONG_COLUMNS))


def to_index(long_df: DataFrame, computed_at: Column | None = None) -> DataFrame:
    """Long form → one row per (prefix, rank) with the ordered suggestion array
    (the cached value). Groups hold ≤ k rows; the input is already clustered
    on (prefix, rank) by the top-k window, so this adds no shuffle."""
    computed_at = F.current_timestamp() if computed_at is None else computed_at
    return _to_index(long_df).withColumn("computed_at", computed_at)


def _to_index(long_df: DataFrame, *by: str) -> DataFrame:
    return long_df.groupBy("prefix", "rank", *by).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", "query", "count", "score"))),
            lambda s: F.struct(
                s["query"].alias("query"), s["count"].alias("count"), s["score"].alias("score")
            ),
        ).alias("suggestions")
    ).drop(*by)


def build_runs(freq: DataFrame, k: int = SUGGEST_LIMIT, max_len: int = MAX_INDEXED_PREFIX, min_len: int = 1) -> DataFrame:
    """O13 with one row for nested prefixes that the same queries begin with: ``prefix, lo, ranks,
    suggestions`` stands for the prefixes of ``prefix`` with lo or more characters (and at
    least ``min_len``), under each of ``ranks``. A list's texts are there once, not once
    for each of those prefixes (the nodes of :mod:`prefixdex.operators.radix`)."""
    from prefixdex.operators.radix import node_runs

    return node_runs(freq, k, max_len, RANKS, min_len)


def expand_runs(runs: DataFrame) -> DataFrame:
    """``prefix, rank`` and the other columns of every prefix that a run stands for."""
    rows = runs.withColumn("rank", F.explode("ranks")).withColumnRenamed("prefix", "_key")
    return cut_key(rows, F.col("lo"), F.length("_key")).drop("_key", "lo", "ranks")


def find_runs(runs: DataFrame, keys: DataFrame) -> DataFrame:
    """``prefix, rank, _run`` of those of the distinct ``prefix, rank`` keys that a run (``prefix, lo,
    ranks, _run``) stands for.

    All queries that begin with a key begin with its run's prefix, and so do all longer
    prefixes of runs that begin with the key; so it is the first one from the key on in
    sorted order. Runs and keys are sorted together, from the last to the first, and
    neither are cut into prefixes; a key whose run stands in an earlier range gets the
    last one that those have (``_near`` of ``_lo`` characters at least)."""
    order = [F.col("_t").desc(), F.col("_lo").desc_nulls_last()]
    rows = runs.select(F.col("prefix").cast("binary").alias("_t"), F.length("prefix").alias("_n"), F.col("lo").alias("_lo"), "ranks", F.lit(None).cast("string").alias("rank"), "_run")
    rows = rows.unionByName(keys.select(F.col("prefix").cast("binary").alias("_t"), F.length("prefix").alias("_n"), "rank"), allowMissingColumns=True)
    rows = rows.filter(F.col("_t").isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    out = T.StructType.fromDDL("_t binary, _n int, rank string, _run long, _near binary, _lo int, _range int")

    def run(batches):
        near, place, schema = {}, None, ["_t", "_n", "rank", "_run", "_near", "_lo", "_range"]
        types = [pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema)
        for batch in batches:
            found = []
            for t, n, lo, ranks, rank, run, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lo is not None:
                    near.update((r, (t, lo, run)) for r in ranks)
                elif rank not in near:
                    found.append((t, n, rank, None, None, None, place))
                elif near[rank][0].startswith(t) and n >= near[rank][1]:
                    found.append((t, n, rank, near[rank][2], None, None, place))
            if found:
                yield made(found)
        if place is not None:
            yield made([(None, None, r, *((near[r][2], near[r][0], near[r][1]) if r in near else (None,) * 3), place) for r in RANKS])

    met = rows.mapInArrow(run, out).checkpoint(eager=True)  # sampled and sorted
    earlier = Window.partitionBy("rank").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range and rank
    last = F.last(F.when(F.col("_near").isNotNull(), F.struct("_near", "_lo", "_run")), ignorenulls=True).over(earlier)
    carried = broadcast_if_small(met.filter(F.col("_t").isNull()).select("_range", "rank", last.alias("_e")))
    rest = met.filter(F.col("_t").isNotNull() & F.col("_run").isNull()).select("_t", "_n", "rank", "_range").join(carried, ["_range", "rank"])
    rest = rest.filter(F.startswith(F.col("_e._near"), F.col("_t")) & (F.col("_n") >= F.col("_e._lo"))).select("_t", "rank", F.col("_e._run").alias("_run"))
    here = met.filter(F.col("_t").isNotNull() & F.col("_run").isNotNull()).select("_t", "rank", "_run")
    found = here.unionByName(rest).select(F.col("_t").cast("string").alias("prefix"), "rank", "_run")
    return found.filter(~F.col("prefix").endswith(" "))


def build_index(freq: DataFrame, k: int = SUGGEST_LIMIT, max_len: int = MAX_INDEXED_PREFIX) -> DataFrame:
    """The materialized prefix index ``prefix, rank, suggestions, computed_at``."""
    index = expand_runs(build_runs(freq, k, max_len))
    return index.select("prefix", "rank", "suggestions", F.current_timestamp().alias("computed_at"))


def index_to_long(index: DataFrame) -> DataFrame:
    return index.select(
        "prefix", "rank", F.posexplode("suggestions").alias("p", "s")
    ).select(
        "prefix",
        "rank",
        (F.col("p") + 1).alias("pos"),
        F.col("s.query").alias("query"),
        F.col("s.count").alias("count"),
        F.col("s.score").alias("score"),
    )


def suggest_one(freq: DataFrame, prefix: str, rank: str = "count", k: int = SUGGEST_LIMIT) -> DataFrame:
    """Top-k for one prefix straight from the frequency table. The
    normalized prefix is a literal, so the filter reaches the Parquet scan
    (``StringStartsWith``) and the sort becomes TakeOrderedAndProject."""
    p = normalize_literal(prefix)
    r = "recent" if rank == "recent" else "count"
    if p == "":
        return freq.limit(0).select(
            F.lit(1).alias("pos"), F.col("display").alias("query"), "count", "score"
        )
    metric = F.col("score") if r == "recent" else F.col("count")
    top = (
        freq.filter(has_prefix("query", p))
        .orderBy(metric.desc(), F.col("display").asc())
        .limit(k)
    )
    w = Window.orderBy(metric.desc(), F.col("display").asc())  # ≤ k rows
    return top.select(
        F.row_number().over(w).alias("pos"), F.col("display").alias("query"), "count", "score"
    )


def clamp_trending_limit(limit) -> int:
    """Default 6 (also for 0, NaN or missing), then clamped to 1..50."""
    try:
        v = float(limit) if limit is not None else 6.0
    except (TypeError, ValueError):
        v = float("nan")
    if v != v or v == 0:
        v = 6.0
    return int(min(max(v, 1.0), 50.0))


def trending(freq: DataFrame, rank: str = "count", limit: int = 6) -> DataFrame:
    """Global top-N for any N (TakeOrderedAndProject: each task keeps N
    rows). Limits of requests are parsed by :func:`clamp_trending_limit`."""
    metric = F.col("score") if rank == "recent" else F.col("count")
    top = freq.orderBy(metric.desc(), F.col("display").asc()).limit(int(limit))
    w = Window.orderBy(metric.desc(), F.col("display").asc())  # ≤ limit rows
    return top.select(
        (F.row_number().over(w) - 1).alias("pos"),
        F.col("display").alias("query"),
        "count",
        "score",
    )


def request_keys(requests: DataFrame, prefix: str = "prefix", rank: str | None = "rank") -> DataFrame:
    """Requests → distinct ``prefix, rank, n_requests, reason`` (normalized prefix;
    empty prefixes are kept and later answered with ``skip``). ``reason`` is null for
    accepted requests; a raw text longer than 512 characters has one and is
    answered with ``error``, as the suggest endpoint does (see :func:`validate`).
    Accepted prefixes have ≤ 512 characters, which bounds the number of
    distinct lengths :func:`bulk_suggest` collects."""
    r = parse_rank(F.col(rank)) if rank else F.lit("count")
    return (
        requests.select(normalize(F.col(prefix)).alias("prefix"), r.alias("rank"), validate(F.col(prefix), "raw").alias("reason"))
        .groupBy("prefix", "rank", "reason")
        .agg(F.count(F.lit(1)).alias("n_requests"))
    )


def _without_list(keys: DataFrame) -> DataFrame:
    """Answers of the keys that are not looked up: ``error`` or ``skip``."""
    status = F.when(F.col("reason").isNotNull(), F.lit("error")).otherwise(F.lit("skip"))
    return keys.filter(F.col("reason").isNotNull() | (F.col("prefix") == "")).select(
        "prefix", "rank", "n_requests", status.alias("status"), F.array().cast(SUGGESTION_TYPE).alias("suggestions"), "reason"
    )


def _with_reason(keys: DataFrame) -> DataFrame:
    return keys if "reason" in keys.columns else keys.withColumn("reason", F.lit(None).cast("string"))


def _with_chains(live: DataFrame) -> DataFrame:
    """``prefix, _chain``: the distinct asked prefixes and the lengths of those among them
    that each begins with, its own included.

    Sorted, all keys between one and a longer one that begins with it begin with it too. So a
    key's chain is what it shares of the chain of the key before it; only the first key
    of each range is cut, for those that stand in earlier ranges (``held``, shortest first)."""
    asked = live.select("prefix").filter(~F.col("prefix").endswith(" ")).distinct()
    asked = asked.repartitionByRange("prefix").sortWithinPartitions("prefix").withColumn("_range", F.spark_partition_id()).checkpoint(eager=True)
    first = asked.groupBy("_range").agg(F.min("prefix").alias("_p"))  # one row a range
    cut = explode_prefixes(first, "_p", 1 << 30).filter(F.col("prefix") != F.col("_p")).select("_p", "prefix")
    key = [F.length("prefix").alias("n"), F.col("prefix").cast("binary").alias("bytes")]
    held = asked.join(F.broadcast(cut), "prefix").groupBy("_p").agg(F.sort_array(F.collect_list(F.struct(*key))).alias("held"))
    rows = asked.join(F.broadcast(held), F.col("prefix") == F.col("_p"), "left").select("prefix", *key, "held")

    def run(batches):
        above = []
        for batch in batches:
            chains = []
            for n, text, held in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                above.extend((x["bytes"], x["n"]) for x in held or ())
                while above and not text.startswith(above[-1][0]):
                    above.pop()
                above.append((text, n))
                chains.append([x[1] for x in above])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chains, pa.list_(pa.int32()))], ["prefix", "_chain"])

    return rows.mapInArrow(run, "prefix string, _chain array<int>").checkpoint(eager=True)  # sampled and sorted


def _deepest_asked(numbered: DataFrame, chains: DataFrame) -> DataFrame:
    """``_ord, count, score, prefix, _chain``: every query with the longest asked prefix that it
    begins with, if it has one.

    Keys and queries are sorted together, in ranges. All texts between a query and a key that
    it begins with begin with that key too; so the query's longest key is one of those that
    its nearest key before it begins with, which may stand in an earlier range."""
    queries = numbered.select(F.col("query").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("array<int>").alias("_chain"), "_ord", "count", "score")
    keys = chains.select(
        F.col("prefix").alias("_t"), F.lit(0).alias("_kind"), "_chain",
        *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in ("_ord", "count", "score")],
    )
    both = queries.unionByName(keys).repartitionByRange("_t", "_kind").sortWithinPartitions("_t", "_kind")
    both = both.withColumn("_range", F.spark_partition_id()).checkpoint(eager=True)
    key = F.when(F.col("_kind") == 0, F.struct("_t", "_chain"))
    before = Window.partitionBy("_range").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_near", F.last(key, ignorenulls=True).over(before)).filter(F.col("_kind") == 1)
    last = both.groupBy("_range").agg(F.max(key).alias("_last"))  # one row a range
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_range", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    near = here.join(broadcast_if_small(carried), "_range").withColumn("_near", F.coalesce("_near", "_carried"))
    begins = F.filter("_near._chain", lambda n: F.col("_t").substr(F.lit(1), n) == F.col("_near._t").substr(F.lit(1), n))
    near = near.withColumn("_chain", begins).filter(F.size("_chain") > 0)
    return near.select("_ord", "count", "score", F.col("_t").substr(F.lit(1), F.array_max("_chain")).alias("prefix"), "_chain")


def _top_by_deepest(numbered: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """``prefix, rank, pos, _ord`` of the asked keys, when they are too many for a broadcast:
    each query is a candidate once, of its longest asked prefix; that prefix's k best are
    candidates of the shorter ones."""
    deepest = _deepest_asked(numbered, _with_chains(live))
    entries = F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), _metric(r).alias("m")) for r in RANKS])).alias("e")
    rows = deepest.select("prefix", "_chain", "_ord", entries).select("prefix", "_chain", "_ord", F.col("e.rank").alias("rank"), F.col("e.m").alias("_m"))
    best = [F.col("_m").desc(), F.col("_ord").asc()]
    w = Window.partitionBy("prefix", "rank").orderBy(*best)
    own = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")
    up = own.withColumn("_len", F.explode("_chain")).withColumn("prefix", F.col("prefix").substr(F.lit(1), F.col("_len"))).drop("_len", "_chain")
    short = F.length("prefix") <= SHORT_PREFIX
    up = up.join(live.select("prefix", "rank"), ["prefix", "rank"], "left_semi")
    return _top_numbers(up.filter(short), up.filter(~short), k)


def bulk_suggest(
    freq: DataFrame,
    keys: DataFrame,
    k: int = SUGGEST_LIMIT,
    broadcast_max_rows: int = BROADCAST_MAX_ROWS,
) -> DataFrame:
    """Answers for a table of distinct ``prefix, rank`` keys (see
    :func:`request_keys`) straight from the frequency table.

    The starts-with join is rewritten to an equi-join: each query is cut only
    at the prefix lengths that occur among the keys (≤ 512 distinct values by
    request validation), then joined on the prefix. When the keys are few
    (rows and bytes checked) they are broadcast and the top-k window sees candidates
    without a shuffle first, so its partial limit applies on the map side.
    Otherwise keys and queries are sorted together and each query meets the longest
    key that it begins with; lists then go up to the shorter keys (see
    :func:`_top_by_deepest`), so no query is cut at lengths that nobody asked for.

    Returns ``prefix, rank, n_requests, status, suggestions, reason`` with status
    ``skip`` (empty prefix), ``error`` (rejected, with the reason) or ``miss``
    (computed; empty array if nothing matches)."""
    # The keys feed a size check and the main job: materialize them once.
    keys = _with_reason(keys).checkpoint(eager=True)
    live = keys.filter((F.col("prefix") != "") & F.col("reason").isNull())
    by_len = (
        live.groupBy(F.length("prefix").alias("n"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("prefix") + 16).alias("bytes"))
        .collect()
    )  # ≤ 512 rows: request validation bounds the prefix length
    lengths = [r["n"] for r in by_len]
    n_keys = sum(r["rows"] for r in by_len)
    key_bytes = sum(r["bytes"] for r in by_len)
    empty = F.array().cast(SUGGESTION_TYPE)
    if not lengths:  # only blank or rejected requests
        return _without_list(keys)
    numbered = _numbered(freq)
    if n_keys <= broadcast_max_rows and key_bytes <= BROADCAST_MAX_BYTES:
        short, long = _cut(_narrow(numbered, RANKS), 1 << 30, lengths)
        wanted = F.broadcast(live.select("prefix", "rank"))
        top = _top_numbers(*(c.join(wanted, ["prefix", "rank"], "left_semi") for c in (short, long)), k)
    else:
        top = _top_by_deepest(numbered, live, k)
    answers = to_index(_with_text(top, numbered)).drop("computed_at")
    answered = live.join(answers, ["prefix", "rank"], "left").select(
        "prefix",
        "rank",
        "n_requests",
        F.lit("miss").alias("status"),
        F.coalesce(F.col("suggestions"), empty).alias("suggestions"),
        "reason",
    )
    return answered.unionByName(_without_list(keys))


# An index: all its rows ``prefix, rank, suggestions, computed_at``, or what gives those of
# distinct ``prefix, rank`` keys, as a store does that finds them (``store.read_index``).
Index = DataFrame | Callable[[DataFrame], DataFrame]


def rows_of(index: Index, keys: DataFrame) -> DataFrame:
    """The index rows of the keys (a frame is filtered, map side when the key set is small)."""
    return index(keys) if callable(index) else index.join(broadcast_if_small(keys), ["prefix", "rank"], "left_semi")


def _laid_over(index: Index, newer: DataFrame) -> Index:
    """The index with the rows ``newer`` instead of its own of the same keys."""
    columns = ["prefix", "rank", "suggestions", "computed_at"]
    if callable(index):
        own = newer.select("prefix", "rank")

        def rows(keys: DataFrame) -> DataFrame:
            old = index(keys.join(own, ["prefix", "rank"], "left_anti"))
            return old.select(*columns).unionByName(newer.join(keys, ["prefix", "rank"], "left_semi").select(*columns))

        return rows
    own = broadcast_if_small(newer.select("prefix", "rank"))
    return index.select(*columns).join(own, ["prefix", "rank"], "left_anti").unionByName(newer)


def lookup(
    index: Index,
    freq: DataFrame,
    keys: DataFrame,
    ttl_seconds: int = 300,
    now: Column | None = None,
    k: int = SUGGEST_LIMIT,
    ring: DataFrame | None = None,
) -> DataFrame:
    """Serve keys from fresh index rows (``hit``); the rest (stale,
    absent, or longer than the indexed prefixes) are computed by
    :func:`bulk_suggest` (``miss``); empty prefixes are ``skip``, rejected requests
    ``error``. With a ``ring``, ``node`` is the owner of each key that was looked
    up. :func:`write_back` gives the index rows that the misses add.

    Keys and index rows are both unique per (prefix, rank), so the joins have
    no skewed key."""
    keys = _with_reason(keys).checkpoint(eager=True)  # measured, probed and passed on: derive once
    asked = F.col("reason").isNull() & (F.col("prefix") != "")
    live = keys.filter(asked)
    fresh = rows_of(index, live.select("prefix", "rank")).filter(is_fresh("computed_at", ttl_seconds, now)).select("prefix", "rank", "suggestions")
    if not callable(index):  # (≤ one row per key) used twice; a store has met the keys, and its lists are needed once
        fresh = fresh.filter(F.col("suggestions").isNotNull()).checkpoint(eager=True)
    hits = live.join(fresh, ["prefix", "rank"]).select(
        "prefix", "rank", "n_requests", F.lit("hit").alias("status"), "suggestions", "reason"
    )
    missing = live.join(fresh.select("prefix", "rank"), ["prefix", "rank"], "left_anti").unionByName(keys.filter(~asked))
    out = hits.unionByName(bulk_suggest(freq, missing.select("prefix", "rank", "n_requests", "reason"), k))
    if ring is None:
        return out
    from prefixdex.operators.ring import assign_owner

    owned = assign_owner(out.withColumn("_key", cache_key("prefix", "rank")), "_key", ring).drop("_key")
    return owned.withColumn("node", F.when(F.col("status").isin("hit", "miss"), F.col("node")))


def write_back(index: Index, answers: DataFrame, now: Column | None = None) -> Index:
    """The index after the misses of :func:`lookup` are stored: one row for each
    computed list (empty lists too, so that a prefix without a match is a hit
    the next time), stamped ``now``, instead of a stale row of the same key."""
    now = F.current_timestamp() if now is None else now
    computed = answers.filter(F.col("status") == "miss").select("prefix", "rank", "suggestions", now.alias("computed_at"))
    return _laid_over(index, computed.checkpoint(eager=True))  # read twice; the misses are not computed again


def overlay_rows(answers: DataFrame, now: Column | None = None) -> DataFrame:
    """What the misses of :func:`lookup` add to an index: one row for each computed list, to be
    appended as a version of its own (:func:`overlaid`), so that a write follows the misses."""
    now = F.current_timestamp() if now is None else now
    return answers.filter(F.col("status") == "miss").select("prefix", "rank", "suggestions", now.alias("computed_at"))


def overlaid(index: Index, overlay: DataFrame) -> Index:
    """The index with the newest overlay row of each key instead of its own (overlays are
    written after the index they lie on; a new index begins without). The index is only
    filtered, map side while the overlay's keys are measured small."""
    newest = overlay.groupBy("prefix", "rank").agg(F.max_by(F.struct("suggestions", "computed_at"), "computed_at").alias("_u"))
    return _laid_over(index, newest.select("prefix", "rank", "_u.suggestions", "_u.computed_at"))


def answers_long(answers: DataFrame) -> DataFrame:
    """Answers with arrays → one row per suggestion (null ``pos`` when empty)."""
    return answers.select(
        "prefix", "rank", "n_requests", "status", F.posexplode_outer("suggestions").alias("p", "s")
    ).select(
        "prefix",
        "rank",
        "n_requests",
        "status",
        (F.col("p") + 1).alias("pos"),
        F.col("s.query").alias("query"),
        F.col("s.count").alias("count"),
        F.col("s.score").alias("score"),
    )


def affected_prefixes(
    changed: DataFrame, query: str = "query", max_len: int = MAX_INDEXED_PREFIX, ranks: Sequence[str] = RANKS
) -> DataFrame:
    """Distinct ``prefix, rank, key`` whose lists a change to the given
    queries can alter: prefixes of length 1..min(len, max_len) not ending in a
    space, under every rank.

    Queries with a common prefix are contiguous in sorted order: each gives those of its
    prefixes that the query before it lacks, so the queries are shuffled, not the prefixes."""
    key = F.col(query).substr(1, max_len).alias("_key")
    rows = changed.select(key).filter(F.length("_key") >= 1).repartitionByRange("_key").sortWithinPartitions("_key")
    known = _lcp(F.col("_key"), F.coalesce("_prev", "_before"), max_len)
    new = _dealt(rows).select("_key", (known + 1).alias("_lo")).checkpoint(eager=True)  # compared once
    p = cut_key(new, F.col("_lo"), F.length("_key")).select("prefix")
    return p.select(
        "prefix", F.explode(F.array(*[F.lit(r) for r in ranks])).alias("rank")
    ).withColumn("key", cache_key("prefix", "rank"))


def invalidate(index: DataFrame, affected: DataFrame) -> DataFrame:
    """O26, plain form (what a cache-aside deployment does): drop the index
    entries of the affected ``prefix, rank`` keys; later lookups of those keys
    miss and are computed directly (:func:`lookup`)."""
    keys = broadcast_if_small(affected.select("prefix", "rank").distinct())
    return index.join(keys, ["prefix", "rank"], "left_anti")


def refresh_lists(
    old_long: DataFrame,
    new_rows: DataFrame,
    changed_queries: DataFrame,
    k: int = SUGGEST_LIMIT,
    max_len: int = MAX_INDEXED_PREFIX,
) -> DataFrame:
    """O26, exact incremental refresh: the new lists (long form) of exactly
    the (prefix, rank) keys a change can alter, given the old long-form index,
    the changed queries (column ``query``, normalized; non-negative deltas) and
    their new frequency rows (``new_rows`` may hold more rows; only the changed
    ones are used).

    Counts only grow and recency scores are compared landmark-scaled, so an
    unchanged query outside a prefix's top-k can never enter it. The new list
    of an affected prefix is therefore top-k(old list without the changed
    queries ∪ the changed queries' new rows). The old index is only filtered
    (map side, against the broadcast affected prefixes when their count is
    small); the rest of the work is proportional to the change."""
    return _refresh(old_long, new_rows, changed_queries, k, max_len)[0]


def _refresh(old_long, new_rows, changed_queries, k, max_len) -> tuple[DataFrame, DataFrame]:
    """(refreshed lists of the affected keys, the affected prefixes)."""
    changed = changed_queries.select("query").distinct()
    changed_rows = new_rows.join(changed, "query", "left_semi")
    fresh_cands = _explode_candidates(changed_rows, RANKS, max_len)
    affected = broadcast_if_small(fresh_cands.select("prefix").distinct().checkpoint(eager=True))
    old_affected = old_long.join(affected, "prefix", "left_semi")
    # A suggestion's normalized key is normalize(display); drop the changed ones.
    old_kept = old_affected.withColumn("_key", normalize(F.col("query"))).join(
        changed.withColumnRenamed("query", "_key"), "_key", "left_anti"
    )
    cols = ["prefix", "rank", "query", "count", "score"]
    recomputed = _top_k(old_kept.select(*cols).unionByName(fresh_cands.select(*cols)), k)
    return recomputed.select(*LONG_COLUMNS), affected


def refresh_index_long(
    old_long: DataFrame,
    new_freq: DataFrame,
    changed_queries: DataFrame,
    k: int = SUGGEST_LIMIT,
    max_len: int = MAX_INDEXED_PREFIX,
) -> DataFrame:
    """The whole index after a change: untouched keys keep their rows, the
    affected keys get :func:`refresh_lists`. (A stored index only needs the
    refreshed lists written; see the streaming sink.)"""
    lists, affected = _refresh(old_long, new_freq, changed_queries, k, max_len)
    untouched = old_long.join(affected, "prefix", "left_anti")
    return untouched.select(*LONG_COLUMNS).unionByName(lists)
