"""Versions of a sink, merged in tiers.

Batch b is ``<root>/v=<b>``. Every ``BASE`` batches are merged into one piece of tier 1
(``<root>/tier=1/v=<end>``), every ``BASE`` pieces of a tier into one of the next, and what
a piece holds is deleted. A reader lists at most ``BASE - 1`` pieces of each tier, and a
row is written again once for each tier: the logarithm of the batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prefixdex.sources import store

BASE = 8


def _tier(root: str, k: int) -> str:
    return root.rstrip("/") + (f"/tier={k}" if k else "")


def _ends(spark: SparkSession, root: str) -> list[set[int]]:
    """For each tier the ends (first batch after) of its committed pieces."""
    out, k = [{v + 1 for v in store.committed_versions(spark, root)}], 1
    while store._fs(spark, _tier(root, k))[0].exists(store._fs(spark, _tier(root, k))[1]):
        out.append(set(store.committed_versions(spark, _tier(root, k))))
        k += 1
    return out


def _path(root: str, k: int, end: int) -> str:
    return store.version_path(_tier(root, k), end if k else end - 1)


def _cover(root: str, ends: list[set[int]], lo: int, hi: int, base: int) -> list[str]:
    """Paths of the largest pieces that make up the batches [lo, hi)."""
    out, at = [], lo
    while at < hi:
        for k in range(len(ends) - 1, -1, -1):
            if at % base**k == 0 and at + base**k in ends[k] and at + base**k <= hi:
                out.append(_path(root, k, at + base**k))
                at += base**k
                break
        else:
            at += 1  # a batch without a version
    return out


def pieces(spark: SparkSession, root: str, below: int | None = None, base: int = BASE) -> list[str]:
    """What a reader of all batches (below one, if given) has to read. A batch below is read
    only while no piece reaches beyond it, which holds for the batch being written."""
    ends = _ends(spark, root)
    last = max((e for s in ends for e in s), default=0)
    return _cover(root, ends, 0, last if below is None else min(below, last), base)


def read(spark: SparkSession, root: str, below: int | None = None, base: int = BASE) -> DataFrame | None:
    found = pieces(spark, root, below, base)
    return spark.read.parquet(*found) if found else None


def holds(spark: SparkSession, root: str, batch: int, base: int = BASE) -> bool:
    """Whether the batch is there, by itself or in a piece."""
    ends = _ends(spark, root)
    return any(end - base**k <= batch < end for k, s in enumerate(ends) for end in s)


def merge(spark: SparkSession, root: str, batch: int, fold: Callable[[DataFrame], DataFrame], sort_col: str, base: int = BASE) -> None:
    """After batch ``batch`` was written: make the pieces that end with it."""
    end, k = batch + 1, 1
    while end % base**k == 0:
        lo = end - base**k
        if not store.is_committed(spark, _tier(root, k), end):
            held = _cover(root, _ends(spark, root)[:k], lo, end, base)
            if held:
                store.write_version(fold(spark.read.parquet(*held)), _tier(root, k), end, sort_col)
        for piece in store.committed_versions(spark, _tier(root, k - 1)):
            if lo < (piece if k > 1 else piece + 1) <= end:
                fs, p = store._fs(spark, store.version_path(_tier(root, k - 1), piece))
                fs.delete(p, True)
        k += 1
