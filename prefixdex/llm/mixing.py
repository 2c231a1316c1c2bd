"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a hash order, are dealt into blocks. Weights are whole
numbers, scaled from the target weights without rounding: a source with ``w`` of
``whole`` has its block j released at slot ``floor(j * whole / w)`` and due by
``ceil((j + 1) * whole / w)``; earliest deadline first then gives each slot to one
released block. After every slot of the whole mixture each source has had its
weight's part of the slots to within less than one block. With a ``period``, the
weights are first made whole shares of so many slots.

The driver runs the schedule over its whole length and holds one weight for each
source and, for each chunk of slots (16 for each source at least), the number of blocks
each source has had before it; tasks run the chunks again from there, and the slots are
joined to the blocks.

All of this is done on keys, a hash of each whole row; the rows themselves move once,
to their places (and once more to be put in order by ``mixed``).

The mixture ends when every document has had its turn: no document is left out,
and a source that runs out begins anew (``epoch`` counts up), as its weight asks
for more than it has. Default weights are the sources' sizes to the power
``alpha``.

Defined cases: a null source is a source of its own; rows that repeat a doc_id, a null
one too, and rows alike in every column are documents of their own; empty and very
long texts are carried, not looked at; ties in the hash order follow the row's hash; an
empty table gives an empty result; further columns are carried along, but ``mix`` puts
its own columns (epoch, block, slot, release, deadline, position) in the place of
columns of those names, which ``mixed`` keeps.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefixdex.llm import tables
from prefixdex.plans.session import broadcast_if_small

BLOCK = 8
PERIOD = 1000
ALPHA = 0.7
CHUNK = 1 << 16  # slots that a task schedules at a time
RANGE = 2_000_000  # keys numbered by a task
PLACED = ["epoch", "block", "slot", "release", "deadline", "position"]


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of a period for each source: largest remainders, one at least. The
    period grows where there are too many sources for it."""
    period = max(period, 4 * len(weights))
    whole = sum(weights.values())
    exact = {s: w / whole * period for s, w in weights.items()}
    given = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(given, key=lambda s: (given[s] - exact[s], s))
    while sum(given.values()) < period:
        for s in order:
            if sum(given.values()) == period:
                break
            given[s] += 1
    while sum(given.values()) > period:
        largest = max((s for s in given if given[s] > 1), key=lambda s: (given[s] - exact[s], s))
        given[largest] -= 1
    assert min(given.values()) >= 1 and sum(given.values()) == period
    return given


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers, without rounding."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be above zero: every document has its turn")
    scale = math.lcm(*(w.denominator for w in exact.values()))
    given = {s: int(w * scale) for s, w in exact.items()}
    common = math.gcd(*given.values())
    return {s: w // common for s, w in given.items()}


def _blocks(given: dict[str, int], done: dict[str, int], slot: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) from ``slot`` on, by earliest deadline;
    ``done`` has the blocks of each source before it."""
    whole = sum(given.values())
    waiting = [(done[s] * whole // w, -(-(done[s] + 1) * whole // w), s, done[s]) for s, w in given.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    while True:
        while waiting and waiting[0][0] <= slot:
            release, deadline, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        yield s, j, slot, release, deadline
        w = given[s]
        heapq.heappush(waiting, ((j + 1) * whole // w, -(-(j + 2) * whole // w), s, j + 1))
        slot += 1


def schedule(given: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of one period, by earliest deadline."""
    run = _blocks(given, dict.fromkeys(given, 0), 0)
    return [next(run) for _ in range(sum(given.values()))]


def chunks(given: dict[str, int], need: dict[str, int], size: int = CHUNK) -> tuple[list[tuple[int, int, list[int]]], dict[str, int]]:
    """(first slot, slots, blocks of each source before) of each chunk of the schedule,
    up to the slot in which the last source has had its ``need`` of blocks; and the
    blocks of each source in all."""
    done, left = dict.fromkeys(given, 0), len(need)
    size = max(size, 16 * len(given))
    out: list[tuple[int, int, list[int]]] = []
    for s, j, slot, _, _ in _blocks(given, done, 0) if given else ():
        if slot % size == 0:
            out.append((slot, size, list(done.values())))
        done[s] = j + 1
        if done[s] == need[s]:
            left -= 1
            if not left:
                first, _, before = out[-1]
                out[-1] = (first, slot + 1 - first, before)
                break
    return out, done


def _numbered(keys: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(__key, __src, __place) of every row of ``keys``, its place in its source, and the
    rows of each source. Sources are range-partitioned by hash, so a large one spans many
    tasks."""
    spark = keys.sparkSession
    name = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source")))
    rows = tables.save(keys.select("__key", name.alias("__src"), F.xxhash64(F.lit(seed), "doc_id").alias("__order")), "mix_keys")
    by = ["__src", "__order", "__key"]
    ranges = max(tables.shuffle_partitions(spark), 1 + rows.count() // RANGE)
    rows = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    rows = tables.save(rows.select("__key", "__src", F.monotonically_increasing_id().alias("__at")), "mix")
    part = F.shiftright("__at", 33).alias("__part")
    counts = rows.groupBy("__src", part).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__src").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = tables.save(counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))), "mix_counts")
    rows = rows.withColumn("__part", F.shiftright("__at", 33)).join(counts.select("__src", "__part", "__first", "__before"), ["__src", "__part"])
    rows = rows.select("__key", "__src", (F.col("__at") - F.col("__first") + F.col("__before")).alias("__place"))
    return rows, counts.groupBy("__src").agg(F.sum("__n").alias("n"))


def _order(spark: SparkSession, given: dict[str, int], pieces: list[tuple[int, int, list[int]]]) -> DataFrame:
    """The slot of every block, each chunk scheduled in a task."""
    shared = spark.sparkContext.broadcast(given)

    def run(batches):
        for rows in batches:
            for first, n, before in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                part = _blocks(shared.value, dict(zip(shared.value, before, strict=True)), first)
                for lo in range(0, n, CHUNK):
                    cols = zip(*(next(part) for _ in range(min(CHUNK, n - lo))), strict=True)
                    kinds = [pa.string(), *[pa.int64()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["__src", "block", "slot", "release", "deadline"])

    held = spark.createDataFrame(pieces, "first long, n long, before array<long>").repartition(max(1, len(pieces)))
    return held.mapInArrow(run, "__src string, block long, slot long, release long, deadline long")


def _positions(keys: DataFrame, weights: dict[str | None, float] | None, block: int, period: int | None, alpha: float, seed: int) -> DataFrame:
    """(__key, epoch, block, slot, release, deadline, position) of every turn of every row."""
    spark = keys.sparkSession
    rows, totals = _numbered(keys, seed)
    sizes = {r["__src"]: r["n"] for r in totals.collect()}  # one row a source
    if weights is None:
        target = {s: n**alpha for s, n in sizes.items()}
    else:
        named = {"-" if s is None else f"={s}": w for s, w in weights.items()}
        target = {s: named[s] for s in sizes}
    given = {}
    if sizes:
        given = whole_weights(target) if period is None else shares(target, period)
    pieces, done = chunks(given, {s: -(-n // block) for s, n in sizes.items()})
    sources = spark.createDataFrame([(s, n, block * done[s]) for s, n in sizes.items()], "__src string, __size long, __items long")
    order = tables.save(_order(spark, given, pieces), "mix_order")

    # The sources are measured; the order grows with the blocks.
    rows = rows.join(broadcast_if_small(sources), "__src")
    rows = rows.withColumn("epoch", F.explode(F.expr("sequence(0L, (__items - 1 - __place) div __size)")))
    rows = rows.withColumn("__item", F.col("__place") + F.col("epoch") * F.col("__size"))
    rows = rows.withColumn("block", F.expr(f"__item div {block}"))
    rows = rows.join(order.hint("merge"), ["__src", "block"])
    rows = rows.withColumn("position", F.col("slot") * block + F.expr(f"__item % {block}"))
    return tables.save(rows.select("__key", *PLACED), "mix_positions")


def _placed(rows: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK,
            period: int | None = None, alpha: float = ALPHA, seed: int = 7) -> DataFrame:
    """``rows`` (with their __key) once for each turn, with the columns of ``PLACED``."""
    positions = _positions(rows.select("__key", "doc_id", "source"), weights, block, period, alpha, seed)
    if not positions.where("epoch = 0").groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        rows = rows.dropDuplicates(["__key"])  # alike in every column: their turns are all in ``positions``
    return rows.join(positions.hint("merge"), "__key")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in mixed order, once or more each: their columns plus epoch, block,
    slot, release, deadline and position. Options: weights, block, period, alpha, seed."""
    docs = docs.drop(*PLACED)
    out = _placed(docs.withColumn("__key", tables.row_key(docs)), **options)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *PLACED)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves in mixed order, with their own columns only."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select("doc_id", "source", whole, tables.row_key(docs).alias("__key"))
    return _placed(rows, **options).orderBy("position").select("__row.*")
