"""Connected components of an edge table, by alternating star contractions.

Each step replaces a node's edges by edges to the smallest node it knows, on the
side of the larger neighbours and then of the smaller ones, until every
component is a star around its smallest node; the number of steps grows with
the logarithm of a component's size, and every step is a grouped minimum and an
equi-join (a much-linked node is a skewed join key, which AQE splits).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixdex.llm import tables


def _print(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("s")).first()
    return r["n"], r["s"] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b); label is the smallest node."""
    now = tables.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _print(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = tables.save(large.where("a <> b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = tables.save(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, seen = seen, _print(now)
        if seen == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def local(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n nodes, within one task."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[new]
        if (new == label).all():
            return label
        label = new
    return label
