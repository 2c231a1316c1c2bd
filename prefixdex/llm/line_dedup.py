"""Line dedup that can be taken back: sharded cuckoo filters over exact
reference counts.

State, as plain tables:

* postings ``(key, doc_id)``: each document's distinct line keys;
* counts ``(key, n_docs, holder)``: in how many documents a key is found and
  the largest id among them, exact;
* filters ``(shard, filter)``: for each shard of the key space, a cuckoo filter
  of the keys found in at least ``min_docs`` documents.

A document's lines are first asked of the filters: a key that its shard's
filter does not hold is surely not repeated, and only the few that it may hold
are looked up in the counts, which decide. Insertions and deletions change the
counts of the keys they touch; a key enters its filter when it reaches
``min_docs`` and is deleted from it when it falls below, so after a deletion
the state is the one that the remaining documents alone would give.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z in lower case,
held as its 128-bit md5. Keys under ``min_chars`` code points are not looked at.

Rows are told apart by their id and the md5 of their text (rows that agree in both
have the same lines and lose the same).

Defined cases: a null or empty text is one empty line; each row is a document
of its own; rows that repeat a doc_id all count, and the lines of each are kept
where that id is the holder; a null doc_id ranks below every other; lines of any length
and texts of any number of lines are read whole; ties between holders cannot be, as the
largest id is one; an empty table gives an empty result; further columns are kept,
whatever their names, but for n_lines, n_dropped and kept_text, which are the result's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixdex.llm import cuckoo, tables
from prefixdex.plans.session import broadcast_if_small

MIN_DOCS = 3
MIN_CHARS = 20
SHARD_KEYS = 50_000  # repeated keys for each filter, on average
PROBE_ROWS = 2_000_000  # probed lines for each group, on average

_EDGE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines():
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def _key(line):
    return F.translate(F.trim(line, F.lit(_EDGE)), _UPPER, _LOWER)


def _digest(key):
    return F.unhex(F.md5(key.cast("binary")))


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc_id): the distinct line keys of every document row."""
    keys = F.array_distinct(F.transform(_lines(), _key))
    out = docs.select(tables.known_id().alias("doc_id"), F.explode(keys).alias("k")).where(F.length("k") >= min_chars)
    return out.select(_digest(F.col("k")).alias("key"), "doc_id")


def reference_counts(posted: DataFrame) -> DataFrame:
    return posted.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder"))


def _hash():
    return F.xxhash64("key")


def _shard(n: int):
    return F.pmod(_hash(), F.lit(n)).cast("int").alias("shard")


def build_filters(counts: DataFrame, shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """One filter for each shard that has a repeated key."""

    def run(shard, rows):
        made = cuckoo.build(rows["hash"].to_numpy())
        return pa.table({"shard": pa.array([shard[0].as_py()], pa.int32()), "filter": pa.array([made.dump()], pa.binary())})

    repeated = counts.where(F.col("n_docs") >= min_docs).select(_shard(shards), _hash().alias("hash"))
    return repeated.groupBy("shard").applyInArrow(run, "shard int, filter binary")


def shards_for(counts: DataFrame, min_docs: int = MIN_DOCS) -> int:
    return 1 + counts.where(F.col("n_docs") >= min_docs).count() // SHARD_KEYS


def insert(state: tuple[DataFrame, DataFrame] | None, docs: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(postings, counts) after adding documents."""
    new = tables.save(postings(docs, min_chars), "postings")
    added = reference_counts(new)
    if state is None:
        return new, tables.save(added, "counts")
    held, counts = state
    both = counts.unionByName(added).groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))
    return held.unionByName(new), tables.save(both, "counts")


def delete(state: tuple[DataFrame, DataFrame], doc_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, counts) after taking documents out again. Only the keys that
    those documents hold are counted anew."""
    held, counts = state
    gone = doc_ids.select(tables.known_id().alias("doc_id")).distinct()
    touched = held.join(gone, "doc_id", "left_semi").select("key").distinct()
    left = tables.save(held.join(gone, "doc_id", "left_anti"), "postings")
    anew = reference_counts(left.join(touched, "key", "left_semi"))
    return left, tables.save(counts.join(touched, "key", "left_anti").unionByName(anew), "counts")


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """The filters of ``after`` from those of ``before``: keys that reached
    ``min_docs`` are inserted, keys that fell below are deleted."""
    old = before.where(F.col("n_docs") >= min_docs).select("key")
    new = after.where(F.col("n_docs") >= min_docs).select("key")
    change = new.join(old, "key", "left_anti").withColumn("up", F.lit(True))
    change = change.unionByName(old.join(new, "key", "left_anti").withColumn("up", F.lit(False)))
    change = change.select(_shard(shards), _hash().alias("hash"), "up")
    kept = new.select(_shard(shards), _hash().alias("hash"), F.lit(None).cast("boolean").alias("up"))
    # The keys themselves go along for the shards that change, in case one has to grow.
    moved = change.select("shard").distinct()
    rows = change.unionByName(kept.join(moved, "shard", "left_semi"))

    def run(shard, one, rows):
        raw = one["filter"].to_pylist()
        if not rows.num_rows:
            return one
        up, hashed = np.array(rows["up"].to_pylist(), object), rows["hash"].to_numpy()
        now = hashed[up == None]  # noqa: E711
        made = cuckoo.CuckooFilter.load(raw[0]) if raw else cuckoo.build(now)
        if raw:
            made.delete(hashed[up == False])  # noqa: E712
            if not made.insert(hashed[up == True]):  # noqa: E712
                made = cuckoo.build(now, 2 * len(now))
        return pa.table({"shard": pa.array([shard[0].as_py()], pa.int32()), "filter": pa.array([made.dump()], pa.binary())})

    return filters.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(run, "shard int, filter binary")


def spreads(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, spread): the groups over which the lines of a shard are dealt, for those
    with more documents' lines than a group is to have. At most one row for each
    ``PROBE_ROWS`` lines."""
    sized = counts.groupBy(_shard(shards)).agg(F.sum("n_docs").alias("n"))
    return tables.save(sized.select("shard", F.expr(f"cast(1 + n div {PROBE_ROWS} as int)").alias("spread")).where("spread > 1"), "spreads")


def maybe_repeated(lines: DataFrame, filters: DataFrame, shards: int, spread: DataFrame) -> DataFrame:
    """The rows of ``lines`` (key, doc_id, row, pos) that their shard's filter may hold.
    Rows of a shard with many are dealt over its ``spread`` groups by row and position,
    each with a copy of the filter, so that a frequent line is not one group."""
    schema = "key binary, doc_id long, row binary, pos int"
    spread = broadcast_if_small(spread)
    parts = F.coalesce("spread", F.lit(1))
    dealt = lines.select(_shard(shards), _hash().alias("hash"), "key", "doc_id", "row", "pos").join(spread, "shard", "left")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "pos"), parts).cast("int")).drop("spread")
    copies = filters.join(spread, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), "filter")

    def run(rows, one):
        out = rows.select(["key", "doc_id", "row", "pos"])
        if not one.num_rows or not rows.num_rows:
            return out.slice(0, 0)
        made = cuckoo.CuckooFilter.load(one["filter"][0].as_py())
        return out.filter(pa.array(made.contains(rows["hash"].to_numpy())))

    by = ["shard", "salt"]
    return dealt.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(run, schema)


def dropped_lines(docs: DataFrame, counts: DataFrame, filters: DataFrame, shards: int,
                  min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row, pos) of every line to drop; row is the md5 of its text."""
    # The digest is taken before the lines are dealt out, once for each row.
    rows = docs.select(tables.known_id().alias("doc_id"), tables.digest().alias("row"), "text")
    lines = rows.select("doc_id", "row", F.posexplode(_lines()).alias("pos", "line"))
    lines = lines.select("doc_id", "row", "pos", _key(F.col("line")).alias("k")).where(F.length("k") >= min_chars)
    lines = lines.select(_digest(F.col("k")).alias("key"), "doc_id", "row", "pos")
    asked = maybe_repeated(lines, filters, shards, spreads(counts, shards))
    exact = counts.where(F.col("n_docs") >= min_docs).select("key", "holder")
    found = asked.join(exact.hint("merge"), "key").where(F.col("doc_id") != F.col("holder"))
    return found.select("doc_id", "row", "pos").distinct()


def clean(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` with their lines without the dropped ones: the columns of ``docs``
    plus n_lines, n_dropped and kept_text."""
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    ident, row, missing, every = (tables.unused(docs, c) for c in ("__id", "__row", "__gone", "__lines"))
    gone = dropped.groupBy(F.col("doc_id").alias(ident), F.col("row").alias(row)).agg(F.collect_list("pos").alias(missing))
    # What is dropped grows with the documents, so it is never broadcast.
    keyed = docs.withColumn(ident, tables.known_id()).withColumn(row, tables.digest())
    with_lines = keyed.join(gone.hint("merge"), [ident, row], "left").withColumn(every, _lines())
    positions = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col(missing))
    text = F.when(F.col(missing).isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(positions, lambda p: F.get(every, p)), "\n")
    )
    counted = with_lines.withColumn("n_lines", F.size(every).cast("long"))
    counted = counted.withColumn("n_dropped", F.coalesce(F.size(missing), F.lit(0)).cast("long"))
    return counted.withColumn("kept_text", text).drop(ident, row, missing, every)


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All documents against each other, starting from an empty state."""
    counts = tables.save(reference_counts(postings(docs, min_chars)), "counts")
    shards = shards_for(counts, min_docs)
    filters = tables.save(build_filters(counts, shards, min_docs), "filters")
    return clean(docs, tables.save(dropped_lines(docs, counts, filters, shards, min_docs, min_chars), "dropped"))
