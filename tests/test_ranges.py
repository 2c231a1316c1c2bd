"""Index build inside sorted ranges, the index stored as runs, flushes of the stored index."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import seed_freq
from prefixdex.operators import prefix, radix, ring
from prefixdex.plans import stored
from prefixdex.sources import bucketed, store


def _freq(spark, n=300, seed=7):
    rng = random.Random(seed)
    texts = {" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 20))) for _ in range(n)}
    return seed_freq(spark, [(t, rng.randint(1, 5), rng.randint(1, 5)) for t in sorted(texts)])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(tuple(r) for r in df.select(*prefix.LONG_COLUMNS).collect())


def _brute(freq, k=10, max_len=40):
    rows = [tuple(r) for r in freq.select("query", "display", "count", "score").collect()]
    lists = {}
    for q, d, c, s in rows:
        for n in range(1, min(len(q), max_len) + 1):
            if q[n - 1] != " ":
                for rank, m in (("count", c), ("recent", s)):
                    lists.setdefault((q[:n], rank), []).append((-m, d, c, s))
    return sorted((p, r, i + 1, d, c, s) for (p, r), v in lists.items() for i, (_, d, c, s) in enumerate(sorted(v)[:k]))


@pytest.mark.parametrize("chunk", [1, 5, 4096])
def test_ranges_of_any_size_give_the_brute_force_lists(spark, monkeypatch, chunk):
    monkeypatch.setattr(prefix, "NEIGHBOUR_CHUNK", chunk)
    freq = _freq(spark, 60)
    want = _brute(freq)
    assert _rows(prefix.build_index_long(freq)) == want
    assert _rows(prefix.build_index_long(freq, split_shared=True)) == want
    assert _rows(radix.expand(radix.build_radix(freq))) == want
    assert _rows(prefix.index_to_long(prefix.build_index(freq))) == want
    assert _rows(prefix.build_index_long(freq, split_shared=True, min_len=4)) == [r for r in want if len(r[0]) >= 4]


def test_candidates_of_one_range_are_not_shuffled(spark, monkeypatch):
    """Only the prefixes of several ranges are dealt by prefix; texts are not joined to lists."""
    monkeypatch.setattr(prefix, "NEIGHBOUR_CHUNK", 50)
    for built in (prefix.build_index_long(_freq(spark)), prefix.build_index_long(_freq(spark), split_shared=True), prefix.build_index(_freq(spark))):
        plan = _plan(built)
        assert len(re.findall(r"Exchange hashpartitioning\(prefix#\d+, rank#\d+, \d+\)", plan)) == 1
        assert "_range#" not in "".join(re.findall(r"Exchange hashpartitioning\([^)]*\)", plan))
        assert "SortMergeJoin" not in plan
    assert "_range#" not in "".join(re.findall(r"Exchange hashpartitioning\([^)]*\)", _plan(radix.build_radix(_freq(spark)))))


def test_stored_runs_are_filtered_by_keys_before_lists_are_joined(spark, tmp_path):
    freq = _freq(spark)
    want = _brute(freq)
    store.write_index(prefix.build_runs(freq), str(tmp_path))
    assert spark.read.parquet(store.version_path(str(tmp_path), 0)).count() < len({r[:2] for r in want})
    index = store.read_index(spark, str(tmp_path))
    assert _rows(prefix.index_to_long(index)) == want
    keys = index.select("prefix", "rank").filter(F.length("prefix") == 6).checkpoint()
    asked = index.join(keys, ["prefix", "rank"], "left_semi")
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftSemi")
    assert _rows(prefix.index_to_long(asked)) == [r for r in want if len(r[0]) == 6]


def test_a_flush_takes_long_prefixes_from_the_frequency_buckets(spark, tmp_path):
    """Old lists are only read for short prefixes, and of buckets without a changed query."""
    freq, root = _freq(spark), str(tmp_path)
    stored.create(freq, root, buckets=4)
    deltas = freq.limit(5).select("query", "display", F.lit(3).cast("bigint").alias("delta"))
    deltas = deltas.unionByName(spark.createDataFrame([("abc new", "abc new", 2), ("b", "b", 1)], "query string, display string, delta bigint"))
    assert stored.apply_deltas(spark, root, deltas, 1)
    assert _rows(stored.read_index(spark, root)) == _brute(stored.read_frequency(spark, root))
    lists, _ = stored.refreshed(spark, root, deltas.select("query"), 1)
    filters = re.findall(r"Filter .*length\(prefix#\d+\) < 4", lists._jdf.queryExecution().optimizedPlan().toString())
    assert len(filters) >= 2


def test_the_stored_index_has_a_list_once_for_its_prefixes(spark, tmp_path):
    """One row for nested prefixes of the same queries and for ranks with the same list."""
    freq = seed_freq(spark, [("abcdef one", 3), ("abcdef two", 2), ("abxyz", 1), ("éé é", 1)])
    stored.create(freq, str(tmp_path), buckets=4)
    deltas = freq.limit(1).select("query", "display", F.lit(3).cast("bigint").alias("delta"))
    for version in (0, 1):
        if version:
            stored.apply_deltas(spark, str(tmp_path), deltas, 1)
        want = _brute(stored.read_frequency(spark, str(tmp_path)))
        assert _rows(stored.read_index(spark, str(tmp_path))) == want
        runs = bucketed.read(spark, stored.index_root(str(tmp_path)))
        assert runs.count() < len({r[:2] for r in want}) / 2
        long = [(r.prefix, r.lo, sorted(r.ranks)) for r in runs.filter("length(prefix) >= 4").collect()]
        both = ["count", "recent"]
        assert sorted(long) == [("abcdef", 4, both), ("abcdef one", 8, both), ("abcdef two", 8, both), ("abxyz", 4, both), ("éé é", 4, both)]


def test_buckets_are_written_in_one_pass(spark, tmp_path):
    """What makes the rows runs once: no sample of them is taken first."""
    passes = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            passes.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(f"{c}{i}", i) for c in ("hot", "warm", "é") for i in range(100)], "k string, n int")
    bucketed.create(rows.mapInArrow(seen, rows.schema), str(tmp_path), "k", 4)
    assert passes.value == 300
    assert sorted(tuple(r) for r in bucketed.read(spark, str(tmp_path)).collect()) == sorted(tuple(r) for r in rows.collect())


@pytest.mark.parametrize("chunk", [3, 4096])
def test_keys_find_their_runs_without_cutting_them(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(prefix, "NEIGHBOUR_CHUNK", chunk)
    freq = _freq(spark, 80)
    want = _brute(freq)
    store.write_index(prefix.build_runs(freq), str(tmp_path))
    texts = {r[0] for r in want if len(r[0]) % 3 == 1}
    texts |= {"", "zz", "a" * 60, *(t + "z" for t in texts), *(t + " " for t in texts), *(t[:-1] for t in texts)}
    keys = spark.createDataFrame([(t, r) for t in sorted(texts) for r in ("count", "recent")] + [(None, "count")], "prefix string, rank string")
    got = store.read_index(spark, str(tmp_path), keys=keys.repartition(3))
    assert _rows(prefix.index_to_long(got)) == [r for r in want if r[0] in texts]
    assert "Generate" not in _plan(got)


def test_a_lookup_asks_the_store_for_its_keys_alone(spark, tmp_path):
    freq, now, asked = _freq(spark, 80), F.lit("2024-03-01 00:00:00").cast("timestamp"), []
    store.write_index(prefix.build_runs(freq), str(tmp_path))
    stamp = now - F.make_interval(secs=F.when(F.length("prefix") % 2 == 0, 3600).otherwise(60))
    whole = store.read_index(spark, str(tmp_path)).withColumn("computed_at", stamp)

    def index(keys):
        asked.append(keys.count())
        return store.read_index(spark, str(tmp_path), keys=keys).withColumn("computed_at", stamp)

    typed = [q[:n] for q in sorted(r.query for r in freq.collect()) for n in (1, 2, 5, 30, 60)] + ["  ", "zz", "x" * 600]
    req = spark.createDataFrame([(t, "recent" if i % 3 else "count") for i, t in enumerate(typed)], "typed string, rank string")
    keys = prefix.request_keys(req, "typed", "rank")
    plain = lambda df: sorted(map(str, df.collect()))
    first = [prefix.lookup(i, freq, keys, 300, now).checkpoint() for i in (whole, index)]
    assert plain(first[0]) == plain(first[1]) and {r.status for r in first[0].collect()} == {"hit", "miss", "skip", "error"}
    for keep in (prefix.write_back, lambda i, a, t: prefix.overlaid(i, prefix.overlay_rows(a, t))):
        second = [prefix.lookup(keep(i, a, now), freq, keys, 300, now) for i, a in zip((whole, index), first, strict=True)]
        assert plain(second[0]) == plain(second[1]) and "miss" not in {r.status for r in second[0].collect()}
    live = keys.filter("prefix != '' and reason is null").count()
    assert asked[0] == live and 0 < asked[1] < live  # what an overlay has is not asked again
    nodes = ring.ring_table(spark, ["n1", "n2"])
    reports = [ring.routing_report(keys.filter("reason is null"), nodes, i, F.col("computed_at") > now - F.expr("interval 1 minute 1 second")) for i in (whole, index)]
    assert plain(reports[0]) == plain(reports[1])
