from conftest import seed_freq
from prefixdex.operators import prefix, ring


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_index_uses_group_limit_on_both_sides(spark):
    plan = _plan(prefix.build_index_long(seed_freq(spark, [("a b", 1), ("a c", 2)])))
    assert "WindowGroupLimit" in plan


def test_prefix_filter_reaches_parquet(spark, tmp_path):
    path = str(tmp_path / "freq")
    seed_freq(spark, [("iphone 15", 3), ("yoga", 1)]).write.parquet(path)
    df = prefix.suggest_one(spark.read.parquet(path), "IPhone")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(query,iphone)" in plan
    assert "TakeOrderedAndProject" in plan


def test_owner_join_is_broadcast(spark):
    keys = spark.createDataFrame([("k1",), ("k2",)], "key string")
    df = ring.assign_owner(keys, "key", ring.ring_table(spark, ["a", "b"]))
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString() or "BroadcastHashJoin" in _plan(df)


def test_broadcast_only_when_measured_small(spark):
    from pyspark.sql import functions as F

    from prefixdex.plans.session import broadcast_if_small, measure

    df = spark.createDataFrame([("abc", 1), ("de", 2)], "s string, n int")
    assert measure(df) == (2, 3 + 8 + 2 + 8)
    small = broadcast_if_small(df)
    big = broadcast_if_small(df, max_bytes=10)
    probe = spark.range(3).withColumn("n", F.col("id").cast("int"))
    assert "BroadcastHashJoin" in probe.join(small, "n")._jdf.queryExecution().executedPlan().toString()
    assert "ResolvedHint (strategy=broadcast)" not in big._jdf.queryExecution().analyzed().toString()
