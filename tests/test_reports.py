import datetime as dt

from conftest import seed_freq
from prefixdex.operators import reports


def test_hit_rate_excludes_skips(spark):
    log = spark.createDataFrame([(c,) for c in ["hit"] * 3 + ["miss"] + ["skip"] * 2], "cache string")
    r = reports.hit_rate(log).first()
    assert (r.hits, r.misses, r.skips, r.hit_rate) == (3, 1, 2, 75)
    empty = reports.hit_rate(log.filter("cache = 'skip'")).first()
    assert empty.hit_rate == 0


def _pct(vals, p):
    s = sorted(vals)
    return s[min(len(s) - 1, int(p * len(s)))]


def test_rolling_latency_last_40(spark):
    t0 = dt.datetime(2024, 1, 1)
    vals = [float((i * 37) % 101) for i in range(130)]
    rows = [("n1" if i % 4 else "n2", t0 + dt.timedelta(seconds=i), i, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "node string, ts timestamp, event_id bigint, latency_ms double")
    got = {r.event_id: r for r in reports.rolling_latency(df).collect()}
    for node in ("n1", "n2"):
        seq = [r for r in rows if r[0] == node]
        for i, r in enumerate(seq):
            window = [x[3] for x in seq[max(0, i - 39): i + 1]]
            g = got[r[2]]
            assert (g.last, g.p50, g.p95, g.samples) == (r[3], _pct(window, 0.5), _pct(window, 0.95), len(window))


def test_rank_movement(spark):
    # recent order: d, c, b, a, f, e; count order: a, b, c, d, e (f absent from count top)
    rows = [("a", 50, 1), ("b", 40, 2), ("c", 30, 3), ("d", 20, 4), ("e", 10, 0.5), ("f", 1, 0.9)]
    got = {r.query: r for r in reports.rank_movement(seed_freq(spark, rows), 6, 5).collect()}
    assert got["d"].delta == 3 and got["d"].arrow == "▲3"
    assert got["a"].delta == -3 and got["a"].arrow == "▼3"
    assert got["e"].pos == 5 and got["e"].pos_count == 4 and got["e"].arrow == "▼1"
    assert got["f"].pos_count is None and got["f"].arrow == "—"
    assert got["d"].bar_pct == 100 and got["e"].bar_pct == 13
    assert min(r.bar_pct for r in got.values()) >= 8
