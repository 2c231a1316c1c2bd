"""Exact ordinals within groups, without putting a group into one task.

``row_number() over (partition by g order by o)`` sends every row of a group
to one task; a group holding a third of the data would then be sorted by one
core. Here the rows are range-partitioned on ``(g, o)`` instead (a hot group
spans many partitions), numbered inside each partition by position, and the
per-(partition, group) row counts — a table with at most
``#partitions + #groups`` rows — are turned into offsets with a small window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixdex.plans.session import broadcast_if_small, ensure_checkpoint_dir

_LOCAL_MASK = (1 << 33) - 1


def with_ordinal(
    df: DataFrame,
    order_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    out: str = "ordinal",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out``: 0-based position of each row inside its group when rows
    are ordered by ``order_cols`` (which must make the order total)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [*group_cols, *order_cols]
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    tagged = (
        ranged.sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_mid", 33))
        .withColumn("_local", F.col("_mid").bitwiseAND(F.lit(_LOCAL_MASK)))
        .drop("_mid")
    )
    # Positions depend on the physical partitioning: cut lineage so the count
    # job and the join below see the same rows in the same places, also after
    # a lost executor recomputes a task.
    tagged = tagged.checkpoint(eager=True)

    stats = tagged.groupBy("_pid", *group_cols).agg(
        F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    spec = Window.partitionBy(*group_cols) if group_cols else Window  # ≤ #partitions rows
    w = spec.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    out_df = tagged.join(broadcast_if_small(stats), ["_pid", *group_cols])
    return out_df.withColumn(out, F.col("_off") + F.col("_local") - F.col("_first")).drop(
        "_pid", "_local", "_first", "_off"
    )
