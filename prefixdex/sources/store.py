"""Versioned Parquet store for the frequency table and the prefix index
(O7 full-refresh sink, O8 scan and size).

Parquet has no MERGE, so every change writes a new version directory
``<root>/v=<version>``; a version is visible once its ``_SUCCESS`` marker is
there (written last by the Parquet committer), so readers never see half a
write. A streaming batch writes version ``batch_id``; replaying a batch whose version is already committed is a no-op (exactly-once sink).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixdex.plans.session import shuffles_dropped


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/v={version:012d}"


def committed_versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v="):
            marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")
            if fs.exists(marker):
                out.append(int(name[2:]))
    return sorted(out)


def latest_version(spark: SparkSession, root: str) -> int | None:
    v = committed_versions(spark, root)
    return v[-1] if v else None


def is_committed(spark: SparkSession, root: str, version: int) -> bool:
    fs, _ = _fs(spark, version_path(root, version) + "/_SUCCESS")
    jvm = spark.sparkContext._jvm
    return fs.exists(jvm.org.apache.hadoop.fs.Path(version_path(root, version) + "/_SUCCESS"))


def write_version(
    df: DataFrame, root: str, version: int, sort_col: str = "query", num_partitions: int | None = None
) -> str:
    """Range-partition and sort by ``sort_col`` so prefix scans of one file
    are served by Parquet min/max statistics (StringStartsWith pushdown). Without
    ``num_partitions`` AQE sizes the files: a micro-batch writes few."""
    path = version_path(root, version)
    ranged = df.repartitionByRange(num_partitions, sort_col) if num_partitions else df.repartitionByRange(sort_col)
    with shuffles_dropped(df.sparkSession):
        ranged.sortWithinPartitions(sort_col).write.mode("overwrite").parquet(path)
    return path


def remove_versions(spark: SparkSession, root: str, below: int) -> None:
    """Delete the versions before ``below`` (folded into a later one), so that a
    listing does not grow with the history."""
    for v in committed_versions(spark, root):
        if v < below:
            fs, p = _fs(spark, version_path(root, v))
            fs.delete(p, True)


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    v = latest_version(spark, root) if version is None else version
    if v is None:
        raise FileNotFoundError(f"no committed version under {root}")
    return spark.read.parquet(version_path(root, v))


def dataset_size(freq: DataFrame) -> DataFrame:
    """Number of rows in the frequency table, as a one-row DataFrame."""
    return freq.agg(F.count(F.lit(1)).alias("dataset_size"))


def write_index(runs: DataFrame, root: str, version: int = 0) -> None:
    """The prefix index as its runs (``prefix.build_runs``), each with a number."""
    with shuffles_dropped(runs.sparkSession):
        runs.withColumn("_run", F.monotonically_increasing_id()).write.mode("overwrite").parquet(version_path(root, version))


def read_index(spark: SparkSession, root: str, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """``prefix, rank, suggestions`` of every prefix, or of distinct ``prefix, rank`` keys: those are
    sorted with the runs' prefixes, and no run is cut into its prefixes. The lists stand
    beside the prefixes and are joined by the run's number, so that a join with some keys
    (left semi or anti), which Spark makes below that join, shuffles prefixes without lists."""
    from prefixdex.operators.prefix import expand_runs, find_runs

    stored = read_version(spark, root, version)
    runs = stored.select("prefix", "lo", "ranks", "_run")
    entries = expand_runs(runs) if keys is None else find_runs(runs, keys)
    return entries.join(stored.select("_run", "suggestions"), "_run").select("prefix", "rank", "suggestions")
