"""Exact ranks by parallel sorting by regular sampling.

Each partition is sorted by itself and written as a run. Every run gives samples
at regular places, from which splitters are taken; they cut the key range into
segments of about equal size (a run adds one step between two samples at most).
The rows of a segment, a sorted stretch of every run, are exchanged and merged in one
task. A segment's rows before it are the prefix sum of the segments' counts, which
makes each place within it an exact rank. Segments that begin after the last wanted
rank are neither exchanged nor merged.

The order is total: the key, the id (null last), and the row's place among the runs,
so equal rows, however many, are spread over segments too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixdex.llm import tables

SEGMENT = 50_000  # rows of a segment, on average, while there are at most ...
SEGMENTS = 16_384  # ... so many segments
SAMPLES = 16  # for each segment


def _keys(score, ident, row) -> np.ndarray:
    """Sort keys (highest score first) as byte strings, which compare alike."""
    low = np.uint64(1 << 63)
    parts = np.empty((len(score), 3), ">u8")
    parts[:, 0] = ~(score.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ low)
    parts[:, 1] = ident.cast(pa.int64()).fill_null((1 << 63) - 1).to_numpy().view(np.uint64) ^ low
    parts[:, 2] = row.to_numpy().astype(np.uint64)
    return parts.view("S24").ravel()


def ranked(rows: DataFrame, score: str, ident: str, among: str, take) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, ... by falling score, ties by rising id) for the first
    ``take(N)`` of the N rows where ``among`` holds, and null for all others. ``rows`` has the
    narrow columns to be ranked by; it is written once, as sorted runs."""
    inside = F.coalesce(F.col(among), F.lit(False))
    runs = rows.withColumn("__in", inside).sortWithinPartitions(F.col("__in").desc(), F.col(score).desc(), F.col(ident).asc_nulls_last())
    runs = tables.save(runs.withColumn("__row", F.monotonically_increasing_id()), "runs")
    n = runs.where("__in").count()
    wanted = take(n)
    segments = min(SEGMENTS, 1 + n // SEGMENT)
    step = max(1, n // (segments * SAMPLES))
    # A row's number has its run above bit 33 and its place in the run below.
    place = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    sampled = runs.where(F.col("__in") & (place % step == step // 2)).select(score, ident, "__row").toArrow().combine_chunks()
    found = np.sort(_keys(*(sampled.column(i).combine_chunks() for i in range(3))))
    splitters = found[[len(found) * i // segments for i in range(1, segments)]] if len(found) else found
    shared = rows.sparkSession.sparkContext.broadcast(splitters)
    names = [*rows.columns, "__row", "__segment"]

    def deal(batches):
        for b in batches:
            at = np.searchsorted(shared.value, _keys(b.column(score), b.column(ident), b.column("__row")), "right")
            yield pa.RecordBatch.from_arrays([*b.select(names[:-1]).columns, pa.array(at.astype(np.int64))], names)

    schema = tables.extended(rows.schema, __row="long", __segment="long")
    dealt = runs.where("__in").select(*names[:-1]).mapInArrow(deal, schema)
    sizes = {r["__segment"]: r["count"] for r in dealt.groupBy("__segment").count().collect()}  # one row a segment
    size = np.array([sizes.get(i, 0) for i in range(segments)])
    before = np.cumsum(size) - size
    last = int(np.searchsorted(before, wanted))  # segments from here on begin after the last wanted rank

    def merge(key, t):
        order = np.argsort(_keys(*(t[c].combine_chunks() for c in (score, ident, "__row"))))
        rank = before[key[0].as_py()] + 1 + np.arange(len(order))
        t = t.take(pa.array(order)).select(names[:-2])
        return t.append_column("rank", pa.array(rank, mask=rank > wanted))

    merged = dealt.where(F.col("__segment") < last).groupBy("__segment").applyInArrow(merge, tables.extended(rows.schema, rank="long"))
    rest = dealt.where(F.col("__segment") >= last).drop("__row", "__segment").unionByName(runs.where(~F.col("__in")).select(*rows.columns))
    return merged.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))
