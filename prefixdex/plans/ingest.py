"""Catalog ingest job (O1 → O2 → O3 → O4/O5 → O7, with the O6 profile).

One shuffle on the normalized query for the aggregation and one range
repartition for the sorted write. The table is written to a new version
directory and becomes visible when its commit marker is written, so readers
of the previous version are never disturbed (full refresh). The load counters
are collected with ``Observation`` by the jobs that already read the data,
so the profile costs no extra pass over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from prefixdex.operators.frequency import build_frequency
from prefixdex.operators.ordinal import with_ordinal
from prefixdex.sources import catalog, store


def ingest_catalog(
    spark: SparkSession,
    csv_path: str,
    root: str,
    sample_every: int = 1,
    version: int | None = None,
    multiline: bool = True,
    min_unique: int = 100_000,
) -> tuple[DataFrame, DataFrame]:
    """Returns (the committed frequency table, the one-row load profile)."""
    raw = catalog.read_catalog(spark, csv_path, multiline=multiline)
    # file order (path, split start, position in the split) is the ordinal
    # that "first display" and 1-in-N sampling refer to
    raw = raw.withColumn("ordinal", F.struct("_file", "_block", "_row"))
    classified = catalog.classify(raw).withColumn("_ok", F.col("reject_reason").isNull())
    keep = F.col("_ok")
    if catalog.check_sample_interval(sample_every) != 1:
        # 1-in-N over the qualifying rows: positions are counted within the
        # qualifying / rejected groups, so rejects need no separate pass
        classified = with_ordinal(classified, ["_file", "_block", "_row"], ["_ok"], out="_pos")
        keep = keep & ((F.col("_pos") + 1) % sample_every == 0)
    # Counters ride on the rows as they flow into the write, exactly once
    # (positions are recomputed identically if a task is retried).
    seen = Observation("catalog")
    observed = classified.observe(
        seen, F.count(F.lit(1)).alias("rows_read"), F.count(F.when(F.col("_ok"), 1)).alias("qualifying")
    )
    kept_obs = Observation("kept")
    kept = observed.filter(keep).observe(kept_obs, F.count(F.lit(1)).alias("kept"))
    latest = store.latest_version(spark, root)
    v = version if version is not None else (0 if latest is None else latest + 1)
    store.write_version(build_frequency(kept), root, v)
    committed = store.read_version(spark, root, v)
    c, k = seen.get, kept_obs.get
    f = committed.agg(
        F.count(F.lit(1)).alias("unique_queries"), F.min("count").alias("min_count"), F.max("count").alias("max_count")
    )
    profile = f.select(
        F.lit(c["rows_read"]).cast("bigint").alias("rows_read"),
        F.lit(c["qualifying"]).cast("bigint").alias("qualifying"),
        F.lit(k["kept"]).cast("bigint").alias("kept"),
        "unique_queries",
        "min_count",
        "max_count",
        (F.col("unique_queries") < F.lit(min_unique)).alias("below_minimum"),
    )
    return committed, profile
