"""Keys stored by their place on the hash ring, moved when the ring changes.

``<root>/rows/v=<n>`` holds ``hash, key, node`` sorted by hash, ``<root>/rings/v=<n>`` the
ring's owner intervals and ``<root>/changed/v=<n>`` the intervals whose owner is another
since the version before. A change of the ring reads and writes the keys in changed
intervals only: ranges of the hash, pushed to the files. A row counts as long as no later
version has changed its interval. A compacted version has changed the whole hash space.
The rows' marker commits a version; what a crash leaves without one is written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefixdex.functions.keys import hash32
from prefixdex.operators.ring import HASH_SPACE, bucket_shift, in_buckets, owner_intervals
from prefixdex.plans.session import broadcast_if_small
from prefixdex.sources import store

MAX_RANGES = 256  # ranges in a pushed filter; more changed intervals are joined up to so many


def _root(root: str, part: str) -> str:
    return f"{root.rstrip('/')}/{part}"


def changed_intervals(before: DataFrame, after: DataFrame) -> DataFrame:
    """``lo, hi, old, new``: where two tables of owner intervals differ. The bounds of both
    cut the space; a piece's owner is that of the next bound of each ring."""
    bounds = before.select("hi", F.col("node").alias("old"), F.lit(None).cast("string").alias("new")).unionByName(
        after.select("hi", F.lit(None).cast("string").alias("old"), F.col("node").alias("new"))
    )
    cuts = bounds.groupBy("hi").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    w = Window.orderBy("hi")  # nodes × vnodes rows
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    pieces = cuts.select(
        F.coalesce(F.lag("hi").over(w), F.lit(-1).cast("bigint")).alias("lo"), "hi",
        F.first("old", ignorenulls=True).over(ahead).alias("old"), F.first("new", ignorenulls=True).over(ahead).alias("new"),
    )
    return pieces.filter(F.col("old") != F.col("new"))


def _covering(intervals: DataFrame) -> list[tuple[int, int]]:
    """At most ``MAX_RANGES`` ranges over the intervals, joined across the smallest gaps."""
    rows = sorted((r["lo"], r["hi"]) for r in intervals.select("lo", "hi").collect())  # nodes × vnodes rows
    gaps = sorted(range(1, len(rows)), key=lambda i: rows[i][0] - rows[i - 1][1], reverse=True)
    cuts = sorted(i for i in gaps[: MAX_RANGES - 1] if rows[i][0] > rows[i - 1][1])
    bounds = [0, *cuts, len(rows)] if rows else []
    return [(rows[a][0], rows[b - 1][1]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _within(ranges: list[tuple[int, int]]) -> Column:
    """The hash is in one of the ranges: an OR of pushable comparisons, as a balanced tree."""
    if not ranges:
        return F.lit(False)
    if len(ranges) == 1:
        lo, hi = ranges[0]
        return (F.col("hash") > F.lit(lo)) & (F.col("hash") <= F.lit(hi))
    middle = len(ranges) // 2
    return _within(ranges[:middle]) | _within(ranges[middle:])


def _joined(rows: DataFrame, intervals: DataFrame, how: str) -> DataFrame:
    """Rows joined with the interval that their hash is in, on its bucket."""
    shift = bucket_shift(max(2, intervals.count()))
    pieces = broadcast_if_small(in_buckets(intervals, shift))
    inside = (F.shiftright("hash", shift) == F.col("bucket")) & (F.col("hash") > F.col("lo")) & (F.col("hash") <= F.col("hi"))
    return rows.join(pieces, inside, how)


def _write(spark: SparkSession, root: str, version: int, intervals: DataFrame, changed: DataFrame, rows: DataFrame) -> None:
    store.write_version(intervals, _root(root, "rings"), version, "lo", 1)
    store.write_version(changed.select("lo", "hi"), _root(root, "changed"), version, "lo", 1)
    store.write_version(rows.select("hash", "key", "node"), _root(root, "rows"), version, "hash")


def _everything(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(-1, HASH_SPACE - 1)], "lo long, hi long")


def create(keys: DataFrame, root: str, ring: DataFrame) -> None:
    """Version 0: every distinct ``key`` with its owner."""
    spark, intervals = keys.sparkSession, owner_intervals(ring)
    hashed = keys.select("key").distinct().select(hash32("key").alias("hash"), "key")
    _write(spark, root, 0, intervals, _everything(spark), _joined(hashed, intervals, "inner"))


def versions(spark: SparkSession, root: str) -> list[int]:
    return store.committed_versions(spark, _root(root, "rows"))


def read(spark: SparkSession, root: str, ranges: list[tuple[int, int]] | None = None, below: int | None = None) -> DataFrame:
    """``hash, key, node`` as of the newest version (below a number, if given); with
    ``ranges`` only the rows there, by a filter on the stored hash."""
    found = [v for v in versions(spark, root) if below is None or v < below]
    out = None
    for i, v in enumerate(found):
        rows = store.read_version(spark, _root(root, "rows"), v)
        if ranges is not None:
            rows = rows.filter(_within(ranges))
        later = [store.read_version(spark, _root(root, "changed"), n) for n in found[i + 1 :]]
        for changed in later:
            rows = _joined(rows, changed, "left_anti")
        out = rows if out is None else out.unionByName(rows)
    return out


def moves(spark: SparkSession, root: str, ring: DataFrame, below: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``hash, key, old, new`` of the keys that a change to ``ring`` moves, and the changed
    intervals; no key outside of them is read."""
    found = [v for v in versions(spark, root) if below is None or v < below]
    changed = changed_intervals(store.read_version(spark, _root(root, "rings"), found[-1]), owner_intervals(ring)).checkpoint(eager=True)
    rows = read(spark, root, _covering(changed), below).drop("node")
    return _joined(rows, changed, "inner").select("hash", "key", "old", "new"), changed


def rebalance(spark: SparkSession, root: str, ring: DataFrame, version: int) -> bool:
    """Version ``version`` (1, 2, ...): the keys moved to ``ring``; False if it is committed."""
    if store.is_committed(spark, _root(root, "rows"), version):
        return False
    moved, changed = moves(spark, root, ring, version)
    _write(spark, root, version, owner_intervals(ring), changed, moved.withColumnRenamed("new", "node"))
    return True


def compact(spark: SparkSession, root: str, version: int) -> bool:
    """All rows as version ``version``; the versions before it are removed."""
    if store.is_committed(spark, _root(root, "rows"), version):
        return False
    found = [v for v in versions(spark, root) if v < version]
    intervals = store.read_version(spark, _root(root, "rings"), found[-1])
    _write(spark, root, version, intervals, _everything(spark), read(spark, root, below=version))
    for part in ("rows", "changed", "rings"):
        store.remove_versions(spark, _root(root, part), version)
    return True


def rebalance_report(moved: DataFrame, n_keys: int, new_nodes: tuple[str, ...] = (), removed_nodes: tuple[str, ...] = ()) -> DataFrame:
    """The figures of ``ring.remap_report`` from the moved keys alone."""
    elsewhere = ~F.col("new").isin(*new_nodes) & ~F.col("old").isin(*removed_nodes)
    out = moved.agg(F.lit(n_keys).cast("bigint").alias("keys"), F.count(F.lit(1)).alias("moved"), F.count(F.when(elsewhere, 1)).alias("moved_elsewhere"))
    return out.withColumn("moved_pct", F.round(F.col("moved") * 100.0 / F.col("keys"), 2))
