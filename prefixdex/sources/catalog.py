"""Catalog ingest front end (O1 CSV source, O2 qualifying filter, O3 1-in-N).

The catalog is a product CSV whose columns all arrive as text; only
``title`` and ``reviews`` matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefixdex.functions.text import has_text
from prefixdex.operators.ordinal import with_ordinal

# The catalog's column layout.
CATALOG_COLUMNS = (
    "asin",
    "title",
    "imgUrl",
    "productURL",
    "stars",
    "reviews",
    "price",
    "listPrice",
    "category_id",
    "isBestSeller",
    "boughtInLastMonth",
)
CATALOG_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in CATALOG_COLUMNS])

# A finite decimal number, optionally signed, optionally with an exponent,
# surrounded by optional white space. Hex, "Infinity", "NaN", "1,000" and
# Java suffixes such as "1d" do not match and are rejected.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def read_catalog(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Header CSV, all columns STRING. Quoted fields may contain quotes and
    newlines; short rows get nulls, extra fields are dropped (PERMISSIVE).

    ``_file``, ``_block`` and ``_row`` (file, split start, position in the task) record
    the file order, which the first-display rule and the 1-in-N sample depend
    on. A file with line breaks in its fields is read by one task (``multiline``),
    so a large catalog is a folder of many files; without line breaks the files
    are split as well."""
    df = (
        spark.read.schema(CATALOG_SCHEMA)
        .option("header", "true")
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("multiLine", str(multiline).lower())
        .csv(path)
    )
    return df.select(
        *CATALOG_COLUMNS,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def classify(df: DataFrame, title: str = "title", reviews: str = "reviews") -> DataFrame:
    """Add ``reviews_num`` (DOUBLE) and ``reject_reason`` (null = qualifying).

    A row qualifies when ``reviews`` is a finite number > 0 and the title is
    not blank; a qualifying count that is not integral is rejected too, since
    the frequency table stores integer counts."""
    r = F.col(reviews)
    num = F.when(r.rlike(NUMBER_PATTERN), F.expr(f"try_cast(trim({reviews}) AS DOUBLE)"))
    blank = ~F.coalesce(has_text(title), F.lit(False))
    reason = (
        F.when(num.isNull(), F.lit("reviews not a number"))
        .when(~(num > 0), F.lit("reviews not positive"))
        .when(blank, F.lit("blank title"))
        .when(num != F.floor(num), F.lit("reviews not integral"))
    )
    return df.withColumn("reviews_num", num).withColumn("reject_reason", reason)


def qualify(df: DataFrame, title: str = "title", reviews: str = "reviews") -> tuple[DataFrame, DataFrame]:
    """(qualifying rows, rejected rows with their reason)."""
    c = classify(df, title, reviews)
    good = c.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = c.filter(F.col("reject_reason").isNotNull())
    return good, bad


def check_sample_interval(n) -> int:
    """The 1-in-N interval must be an integer ≥ 1."""
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise ValueError(f"sample interval must be a positive integer, got {n!r}")
    return n


def sample_every(df: DataFrame, n: int, order_cols: list[str]) -> DataFrame:
    """Keep rows N, 2N, 3N, … (1-based) in ``order_cols`` order. N must be an
    integer ≥ 1; N = 1 keeps everything without any extra job."""
    check_sample_interval(n)
    if n == 1:
        return df
    with_pos = with_ordinal(df, order_cols, out="_pos")
    return with_pos.filter((F.col("_pos") + 1) % n == 0).drop("_pos")


def write_catalog(df: DataFrame, path: str, order_col: str, files: int) -> None:
    """Write ``df`` (with the catalog's columns and ``order_col``) as a folder of
    header CSVs whose names follow ``order_col``: range-partitioned and sorted in
    many tasks, so the file order is the row order."""
    ordered = df.repartitionByRange(files, order_col).sortWithinPartitions(order_col)
    ordered.select(*CATALOG_COLUMNS).write.option("header", "true").option("escape", '"').csv(path)
