"""Intermediate tables in the shared folder, and defaults shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prefixdex.plans.session import work_dir

#: While a table is written: drop shuffle files at its end, and hand texts to Python
#: in batches of few megabytes.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table under the shared checkpoint folder and read
    it back: lineage is cut, the rows survive lost executors, and the shuffle
    files that made them are dropped as soon as the write has ended."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def digest(column: str = "text"):
    """md5 of the whole text (null: the empty text). With the id it names a row: rows
    that agree in both are alike in all that an operator looks at."""
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))


def row_key(df: DataFrame):
    """md5 of the whole row, by column names: rows with one key are alike in every column."""
    named = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return F.unhex(F.md5(named.cast("binary")))


def known_id(column: str = "doc_id", null: int = -(1 << 63)):
    """The id as a long that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(null))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one like it that is no column of ``df``."""
    while name in df.columns:
        name += "_"
    return name


def doc_hash(column: str = "doc_id"):
    """crc32 of the id written as text (null: the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def extended(schema: StructType, **more: str) -> StructType:
    """The schema with further columns (name: type), as a new object."""
    extra = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in more.items()))
    return StructType([*schema.fields, *extra.fields])
