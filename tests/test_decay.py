import datetime as dt
import random

from pyspark.sql import functions as F

from conftest import seed_freq
from prefixdex.operators import decay, events


def test_decay_multiplies_score_and_keeps_order(spark):
    freq = seed_freq(spark, [("a", 100, 100), ("b", 100, 50)])
    got = {r.query: r for r in decay.decay_step(freq).collect()}
    assert abs(got["a"].score - 90) < 1e-6 and abs(got["b"].score - 45) < 1e-6
    assert got["a"].score > got["b"].score
    assert got["a"]["count"] == 100


def test_closed_form_equals_step_replay(spark):
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=rnd.randint(0, 600)), rnd.choice(["x", "y", "z"])) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, query string")
    tick = events.tick_of("ts", "2024-01-01 00:00:00", 60)
    now = 600
    got = {r.query: r.score for r in decay.recency_scores(df, tick, F.lit(now)).collect()}
    # replay: every tick multiply by 0.9, add each event at its tick
    score = {"x": 0.0, "y": 0.0, "z": 0.0}
    by_tick = {}
    for _, ts, q in rows:
        by_tick.setdefault(int((ts - t0).total_seconds() // 60), []).append(q)
    for t in range(0, now + 1):
        if t > 0:
            score = {k: v * 0.9 for k, v in score.items()}
        for q in by_tick.get(t, []):
            score[q] += 1
    for q, v in got.items():
        assert abs(v - score[q]) <= 1e-9 * max(1.0, score[q])
