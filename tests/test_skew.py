"""Results stay exact when one key holds most of the rows."""

import datetime as dt

from conftest import seed_freq
from prefixdex.operators import history, prefix


def test_hot_user_history(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=i), 0 if i % 4 else 1 + i % 3, f"q{i % 97}") for i in range(3000)]
    ev = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, query string")
    got = {}
    for r in history.user_history(ev).collect():
        got.setdefault(r.user_id, []).append((r.pos, r.q))
    for user in {r[2] for r in rows}:
        newest = {}
        for i, ts, u, q in rows:
            if u == user:
                newest[q.lower()] = (ts, i, q)
        want = [v[2] for v in sorted(newest.values(), reverse=True)][:50]
        assert [q for _, q in sorted(got[user])] == want


def test_hot_prefix_bulk_lookup(spark):
    # two thirds of the table and of the requests start with "a"
    rows = [(f"a{i:04d}", i % 17 + 1) for i in range(600)] + [(f"b{i:03d}", i % 5 + 1) for i in range(300)]
    freq = seed_freq(spark, rows)
    reqs = [("a", "count")] * 500 + [("a0", "recent")] * 100 + [("b1", "count")] * 250
    keys = prefix.request_keys(spark.createDataFrame(reqs, "prefix string, rank string"))
    got = {}
    for r in prefix.answers_long(prefix.bulk_suggest(freq, keys)).collect():
        got.setdefault((r.prefix, r.rank, r.n_requests), []).append((r.pos, r.query))
    for (p, rank, n), lst in got.items():
        m = [r for r in rows if r[0].startswith(p)]
        want = [q for q, _ in sorted(m, key=lambda r: (-r[1], r[0]))[:10]]
        assert [q for _, q in sorted(lst)] == want
        assert n == sum(1 for x in reqs if x[0] == p and x[1] == rank)
