"""Consistent-hash ring (O31 hash, O32 ring table, O33 key → owner, O34
balance, O35 remap, O36 routing report, O38 delete batches).

A key is owned by the first virtual node whose hash is ≥ the key's hash,
wrapping to the first virtual node. The ring is turned into half-open
intervals ``(lo, hi]`` and cut into buckets of the hash space, as many as fit the
ring's size, so the owner lookup is an equi-join on the bucket plus a range
check, broadcast when the measured ring is small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefixdex.functions.keys import hash32

# Fixed value: virtual nodes per node.
VNODES = 150
HASH_SPACE = 1 << 32


def ring_table(spark: SparkSession, nodes: Sequence[str], vnodes: int = VNODES) -> DataFrame:
    """``node, vnode, hash, ord`` for every virtual node (``ord`` is the
    insertion order, which breaks ties between equal hashes). Adding a node
    twice changes nothing; an empty ring is an error."""
    uniq = list(dict.fromkeys(nodes))
    if not uniq:
        raise ValueError("hash ring is empty")
    base = spark.createDataFrame([(n, i) for i, n in enumerate(uniq)], "node string, node_ord int")
    v = base.select("node", "node_ord", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("vnode"))
    return v.select(
        "node",
        "vnode",
        hash32(F.concat(F.col("node"), F.lit("#"), F.col("vnode").cast("string"))).alias("hash"),
        (F.col("node_ord") * vnodes + F.col("vnode")).alias("ord"),
    )


def bucket_shift(virtual_nodes: int) -> int:
    """Bits below a bucket of the hash space: 256 buckets for small rings, then
    about one for each virtual node, so a key meets a few intervals only."""
    return 32 - min(24, max(8, (virtual_nodes - 1).bit_length()))


def owner_intervals(ring: DataFrame) -> DataFrame:
    """``lo, hi, node``: who owns the hashes in ``(lo, hi]``. Equal hashes keep the
    earliest-added entry."""
    first = ring.groupBy("hash").agg(F.min_by("node", "ord").alias("node"))
    w = Window.orderBy("hash")  # the ring is small (nodes × vnodes rows)
    iv = first.select(
        "node",
        F.col("hash").alias("hi"),
        F.lag("hash").over(w).alias("lo"),
        F.max("hash").over(Window.partitionBy(F.lit(0))).alias("_last"),
    )
    # The first entry also owns the wrap-around piece (last, 2^32 − 1].
    wrap = iv.filter(F.col("lo").isNull()).select(
        "node", F.lit(HASH_SPACE - 1).cast("bigint").alias("hi"), F.col("_last").alias("lo")
    )
    head = iv.select("node", "hi", F.coalesce(F.col("lo"), F.lit(-1).cast("bigint")).alias("lo"))
    return head.unionByName(wrap).filter(F.col("hi") > F.col("lo")).select("lo", "hi", "node")


def in_buckets(intervals: DataFrame, shift: int = 24) -> DataFrame:
    """Intervals split on the hash without its ``shift`` low bits (``bucket``)."""
    buckets = F.sequence(F.shiftright(F.col("lo") + 1, shift), F.shiftright(F.col("hi"), shift))
    return intervals.withColumn("bucket", F.explode(buckets))


def ring_buckets(ring: DataFrame, shift: int = 24) -> DataFrame:
    """Owner intervals ``(lo, hi]`` by bucket: ``lo, hi, node, bucket``."""
    return in_buckets(owner_intervals(ring), shift)


def assign_owner(keys: DataFrame, key: str, ring: DataFrame, out: str = "node", hashed: str | None = None) -> DataFrame:
    """Add ``out`` = owning node of ``key``, and its hash as ``hashed`` if named."""
    from prefixdex.plans.session import broadcast_if_small

    shift = bucket_shift(ring.count())
    b = broadcast_if_small(ring_buckets(ring, shift).withColumnRenamed("node", out))
    # Never null (a null key has no bucket): no filter before the join hashes the key again.
    h = keys.withColumn("_h", F.coalesce(hash32(F.col(key)), F.lit(-1))).withColumn("_b", F.shiftright(F.col("_h"), shift))
    cond = (F.col("_b") == F.col("bucket")) & (F.col("_h") > F.col("lo")) & (F.col("_h") <= F.col("hi"))
    owned = h.join(b, cond, "inner").drop("_b", "bucket", "lo", "hi")
    return owned.withColumnRenamed("_h", hashed) if hashed else owned.drop("_h")


def node_balance(owned: DataFrame, node: str = "node") -> DataFrame:
    """``node, keys, share_pct`` (share of all keys, rounded to 0.1)."""
    per = owned.groupBy(node).agg(F.count(F.lit(1)).alias("keys"))
    total = F.sum("keys").over(Window.partitionBy(F.lit(0)))  # one row per node
    return per.withColumn("share_pct", F.round(F.col("keys") * 100.0 / total, 1))


def remap_report(
    keys: DataFrame,
    key: str,
    before: DataFrame,
    after: DataFrame,
    new_nodes: Sequence[str] = (),
    removed_nodes: Sequence[str] = (),
) -> DataFrame:
    """Owners under two rings, computed in one pass (two broadcast
    joins, no join of keys with keys): ``keys, moved, moved_pct,
    moved_elsewhere`` where *elsewhere* = between nodes that are in both rings:
    neither to one of ``new_nodes`` nor from one of ``removed_nodes``."""
    a = assign_owner(keys.select(F.col(key).alias("_k")), "_k", before, "_old")
    ab = assign_owner(a, "_k", after, "_new")
    moved = F.col("_old") != F.col("_new")
    elsewhere = moved
    if new_nodes:
        elsewhere = elsewhere & ~F.col("_new").isin(*new_nodes)
    if removed_nodes:
        elsewhere = elsewhere & ~F.col("_old").isin(*removed_nodes)
    out = ab.agg(
        F.count(F.lit(1)).alias("keys"),
        F.count(F.when(moved, 1)).alias("moved"),
        F.count(F.when(elsewhere, 1)).alias("moved_elsewhere"),
    )
    return out.withColumn("moved_pct", F.round(F.col("moved") * 100.0 / F.col("keys"), 2))


def delete_batches(owned: DataFrame, key: str = "key", node: str = "node", batch_size: int = 1000, unique: bool = False, hashed: str | None = None) -> DataFrame:
    """Distinct keys grouped by owner into delete batches of about
    ``batch_size`` keys: ``node, batch, n_keys, keys``.

    A node owns about 1/n of all keys, so one list per node would be an
    unbounded group; the keys of a node are spread over
    ``ceil(keys/batch_size)`` batches by their hash (``hashed``: the column that has
    it). The distinct owned keys are made once, in the shared folder, and read for the
    counts and for the batches. Keys that are ``unique`` already (the caller's word) are
    derived twice instead. Keys are shuffled one by one: a task has few of a batch."""
    h = F.col(hashed) if hashed else hash32(key)
    d = owned.select(F.col(key).alias("key"), F.col(node).alias("node"), h.alias("_h"))
    if not unique:
        d = d.distinct().checkpoint(eager=True)
    per = d.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / F.lit(batch_size)).alias("_nb"))
    # one row per node: bounded by the ring size
    d = d.join(F.broadcast(per), "node").select("node", F.pmod("_h", F.col("_nb")).alias("batch"), "key")
    return d.repartition("node", "batch").groupBy("node", "batch").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sort_array(F.collect_list("key")).alias("keys")
    )


def invalidation_counts(owned: DataFrame, index: DataFrame, fresh: Column | None = None) -> DataFrame:
    """Per node the keys asked to be deleted and those that the index held:
    ``node, requested, deleted`` (``owned``: ``prefix, rank, node``)."""
    held = (index if fresh is None else index.filter(fresh)).select("prefix", "rank", F.lit(True).alias("_held"))
    asked = owned.select("prefix", "rank", "node").distinct()
    return asked.join(held, ["prefix", "rank"], "left").groupBy("node").agg(
        F.count(F.lit(1)).alias("requested"), F.count("_held").alias("deleted")
    )


def routing_report(keys: DataFrame, ring: DataFrame, index: DataFrame | Callable[[DataFrame], DataFrame], fresh: Column | None = None) -> DataFrame:
    """``prefix, rank, key, node, status`` with HIT when the index holds a
    (fresh) list for the key, MISS otherwise."""
    from prefixdex.functions.keys import cache_key
    from prefixdex.operators.prefix import rows_of

    k = keys.select("prefix", "rank").distinct().checkpoint(eager=True)
    owned = assign_owner(k.withColumn("key", cache_key("prefix", "rank")), "key", ring)
    idx = rows_of(index, k)
    idx = idx if fresh is None else idx.filter(fresh)
    present = idx.select("prefix", "rank").withColumn("_present", F.lit(True))
    return owned.join(present, ["prefix", "rank"], "left").select(
        "prefix",
        "rank",
        "key",
        "node",
        F.when(F.col("_present"), F.lit("HIT")).otherwise(F.lit("MISS")).alias("status"),
    )
