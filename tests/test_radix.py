"""Path-compressed index and bulk lookup by sorted keys."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import seed_freq
from prefixdex.operators import prefix, radix

WORDS = ["iphone 15", "iphone 15 pro", "iphone 15 pro max", "ipad", "yoga mat", "yogurt", "zebra", "rice", "rice cooker", "a", "ab", "a b", "日本 茶", "日本酒"]


def _random_freq(spark, seed=1, n=400):
    rng = random.Random(seed)
    texts = {" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 20))) for _ in range(n)}
    return seed_freq(spark, [(t, rng.randint(1, 30), rng.randint(1, 30)) for t in sorted(texts | set(WORDS))])


def _rows(df, cols=prefix.LONG_COLUMNS):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def _brute_nodes(queries):
    sets = {}
    for q in queries:
        for n in range(1, min(len(q), 40) + 1):
            if q[n - 1] != " ":
                sets.setdefault(q[:n], set()).add(q)
    runs = {}
    for p, s in sets.items():
        runs.setdefault(frozenset(s), []).append(p)
    return sorted((min(ps, key=len), max(ps, key=len), len(s)) for s, ps in runs.items())


def test_expands_to_the_plain_index_with_fewer_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix, "NEIGHBOUR_CHUNK", 7)  # edges of chunks share more than they must
    for freq in (_random_freq(spark), seed_freq(spark, [(w, 10 * i + 5) for i, w in enumerate(WORDS)])):
        tree = radix.build_radix(freq).checkpoint()
        plain = prefix.build_index_long(freq)
        assert _rows(radix.expand(tree)) == _rows(plain)
        assert tree.count() < plain.count()
        want = _brute_nodes([r[0] for r in freq.select("query").collect()])
        assert _rows(radix.nodes(freq), radix.NODE_COLUMNS) == want
        assert _rows(tree.select(*radix.NODE_COLUMNS).distinct(), radix.NODE_COLUMNS) == want
    assert radix.build_radix(freq.limit(0)).count() == 0


def test_lookup_by_the_node_a_prefix_ends_in(spark):
    freq = _random_freq(spark, 2)
    asked = ["i", "iph", "iphone 15 pro", "iphone 15 pro max", "yog", "nothing", "日", "日本", "a", "ab é"]
    keys = spark.createDataFrame([(p, r) for p in asked for r in ("count", "recent")], "prefix string, rank string")
    want = prefix.build_index_long(freq).join(keys, ["prefix", "rank"], "left_semi")
    assert _rows(radix.lookup_radix(radix.build_radix(freq), keys)) == _rows(want)


def test_keys_and_labels_meet_in_sorted_order(spark, monkeypatch):
    """Keys are not cut: a checkpointed tree is joined without an explode."""
    monkeypatch.setattr(prefix, "NEIGHBOUR_CHUNK", 7)
    freq = _random_freq(spark, 6)
    tree = radix.build_radix(freq).checkpoint()
    queries = [r[0] for r in freq.select("query").collect()]
    asked = {q[:n] for q in queries for n in range(1, len(q) + 1, 3)} | {"", "  ", "zzz", "a ", "iphone ", "iphone 15 pro maxi", "é" * 50, None}
    keys = spark.createDataFrame([(p, r) for p in asked for r in ("count", "recent", None)], "prefix string, rank string")
    found = radix.lookup_radix(tree, keys)
    want = radix.expand(tree).join(keys, ["prefix", "rank"], "left_semi")
    ending = [(r.prefix, r.rank, r.pos, r.query, r["count"], r.score) for r in found.filter(F.col("prefix").endswith(" ")).collect()]
    assert _rows(found.filter(~F.col("prefix").endswith(" "))) == _rows(want) and want.count() > 500
    nodes = tree.collect()  # a key with a space at its end lies within a node or nowhere
    whole = [(p, n.rank, n.pos, n.query, n["count"], n.score) for n in nodes for p in asked if p and p.endswith(" ") and p.startswith(n.head) and n.label.startswith(p)]
    assert sorted(ending) == sorted(whole) and len(whole) > 0
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_branches_are_where_sorted_texts_part(spark):
    rng = random.Random(8)
    for n in (1, 2, 60):
        texts = sorted("".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(n))
        want = [sorted({len(os.path.commonprefix([t, o])) for j, o in enumerate(texts) if i != j} - {0}) for i, t in enumerate(texts)]
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, _key string").coalesce(1)
        assert [r["_ends"] for r in sorted(prefix._with_branches(rows).collect(), key=lambda r: r["i"])] == want


def test_a_query_is_a_candidate_once_a_node(spark):
    freq = _random_freq(spark, 9)
    rows, _ = prefix.in_branches(freq)
    cut = radix._nodes_within(rows)
    assert cut.count() == cut.select("label", "query").distinct().count()
    assert cut.count() < prefix.cut_key(rows, F.col("_open") + 1, F.col("_shared")).count()


@pytest.mark.parametrize("seed", [3, 4])
def test_bulk_suggest_by_sorted_keys_equals_the_broadcast_form(spark, seed):
    freq = _random_freq(spark, seed)
    rng = random.Random(seed)
    queries = [r[0] for r in freq.select("query").collect()]
    typed = [q[: rng.randint(1, len(q) + 1)] for q in rng.sample(queries, 120)]
    typed += [q for q in queries[:20]] + [q + "x" for q in queries[:20]] + ["", "  ", "zzz", "a", "b", "é", "y" * 600]
    req = spark.createDataFrame([(t, rng.choice(["count", "recent", None])) for t in typed], "prefix string, rank string")
    keys = prefix.request_keys(req)
    got = [sorted(map(str, prefix.bulk_suggest(freq, keys, broadcast_max_rows=n).collect())) for n in (0, 1000)]
    assert got[0] == got[1] and len(got[0]) > 100


def test_each_query_is_a_candidate_once(spark):
    freq = _random_freq(spark, 5)
    live = spark.createDataFrame([("a",), ("ab",), ("iphone",), ("iphone 15 pro",), ("y",)], "prefix string")
    deepest = prefix._deepest_asked(prefix._numbered(freq), prefix._with_chains(live))
    got = {(r["_ord"], r["prefix"], tuple(sorted(r["_chain"]))) for r in deepest.collect()}
    assert len(got) == len({o for o, _, _ in got}) == freq.filter(F.col("query").rlike("^(a|iphone|y)")).count()
    assert {c for _, p, c in got if p == "iphone 15 pro"} == {(6, 13)} and {c for _, p, c in got if p == "ab"} == {(1, 2)}
