"""Session construction and the few plan-level decisions we make ourselves.

Catalyst + AQE choose join strategies at run time; the helpers here only
cover what they cannot know in advance: a broadcast is issued only after the
small side's row count has been checked against a bound, and lineage is cut
in the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bounds for a side to be broadcast: rows and (measured) bytes.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 128 << 20


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "prefixdex") -> SparkSession:
    """Session for tests and the bench. On a cluster, use the session the
    platform provides; every function in the package only needs a DataFrame."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and versioned tables.

    Read from ``spark.checkpoint.dir`` (or an already-set context dir). Only a
    local master (tests, the bench) falls back to a folder under the warehouse
    directory; a cluster without the setting is an error, since executors and
    driver do not share local folders."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(base)
    return sc._jsc.sc().getCheckpointDir().get()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, the shuffle files that a write's own plan has made go when it has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder, compressed, and read again: unlike a checkpoint's,
    its columns are read one by one, and no shuffle file stays."""
    path = work_dir(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measure(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> tuple[int, int]:
    """(rows, bytes) of ``df``, counting at most ``max_rows + 1`` rows; bytes
    are the string/binary payload plus 8 per other column."""
    from pyspark.sql import types as T

    width = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width.append(F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)))
        else:
            width.append(F.lit(8))
    row_bytes = sum(width[1:], width[0]) if width else F.lit(0)
    r = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES
) -> DataFrame:
    """Broadcast hint only when the side is proven small (rows and bytes
    measured); otherwise the join stays a shuffle join that AQE may still
    convert at run time."""
    n, b = measure(df, max_rows)
    return F.broadcast(df) if n <= max_rows and b <= max_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer partitions than the cluster has cores
    (one large Parquet row group is read by one task) before per-row work
    that multiplies rows. A scan that is already split (the normal case for
    large inputs) is returned unchanged, so no shuffle is added at scale."""
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


def bench_cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", "8"))
