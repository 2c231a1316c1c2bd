"""Bench: time the headline jobs on ``$BENCH_SF_DIR`` (default sf0.1) with
``local[$BENCH_CPUS]``; print one JSON line.

Each job is executed in full through the ``noop`` sink (no collect to the
driver), after one untimed warm-up of the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


from prefixdex.operators import decay, frequency, prefix  # noqa: E402
from prefixdex.plans import registry  # noqa: E402
from prefixdex.plans.session import build_session, work_dir  # noqa: E402
from prefixdex.sources import store  # noqa: E402


def _decay_documents(spark, d):
    return decay.decay_step(registry.freq_documents(spark, d))


class Stored:
    """The document frequency table and its index written once (untimed), as
    a deployed index would be; the change is every search event."""

    def __init__(self, spark, d):
        root = work_dir(spark, "bench-stored")
        self.freq_path, self.index_path = f"{root}/freq", f"{root}/index"
        store.write_version(registry.freq_documents(spark, d), self.freq_path, 0)
        freq = store.read_version(spark, self.freq_path, 0)
        store.write_version(prefix.build_index_long(freq), self.index_path, 0, sort_col="prefix")
        self.deltas = registry.event_totals(spark, d).checkpoint(eager=True)

    def incremental(self, spark, d):
        freq = store.read_version(spark, self.freq_path, 0)
        changed = self.deltas.select("query")
        new_rows = frequency.upsert(freq.join(changed, "query", "left_semi"), self.deltas)
        old = store.read_version(spark, self.index_path, 0)
        return prefix.refresh_lists(old, new_rows, changed)

    def rebuild(self, spark, d):
        freq = store.read_version(spark, self.freq_path, 0)
        return prefix.build_index_long(frequency.upsert(freq, self.deltas))

    def decay(self, spark, d):
        return decay.decay_step(store.read_version(spark, self.freq_path, 0))


def _ring_figures(spark):
    """The published ring figures: 20,000 generated keys over 3 nodes, then a
    4th node (fixed input; reported, not timed)."""
    from prefixdex.operators import ring

    digits = "0123456789abcdefghijklmnopqrstuvwxyz"

    def b36(n):
        s = ""
        while True:
            n, r = divmod(n, 36)
            s = digits[r] + s
            if n == 0:
                return s

    keys = spark.createDataFrame([("sug:" + b36((i * 2654435761) % (1 << 32))[:4],) for i in range(20000)], "key string")
    three = ring.ring_table(spark, ["redis-0", "redis-1", "redis-2"])
    four = ring.ring_table(spark, ["redis-0", "redis-1", "redis-2", "redis-3"])
    bal = {r.node: r.share_pct for r in ring.node_balance(ring.assign_owner(keys, "key", three)).collect()}
    remap = ring.remap_report(keys, "key", three, four, ["redis-3"]).first()
    return {"ring_share_pct": dict(sorted(bal.items())), "remap_pct": remap.moved_pct, "remap_elsewhere": remap.moved_elsewhere}


HEADLINE = {
    "ingest_documents": registry.q_frequency_documents,
    "index_build_documents": registry.q_prefix_index_documents,
    "index_build_documents_split": registry.q_prefix_index_documents_split,
    "index_build_parts": registry.q_prefix_index_parts,
    "bulk_suggest_keystrokes": registry.q_bulk_suggest_keystrokes,
    "index_lookup_keystrokes": registry.q_index_lookup_keystrokes,
    "recency_scores": registry.q_recency_scores,
    "decay_step_documents": _decay_documents,
    "flush_summary": registry.q_flush_summary,
    "node_balance_documents": registry.q_node_balance_documents,
    "remap_add_node_documents": registry.q_remap_add_node_documents,
    "rolling_latency": registry.q_rolling_latency,
    "personalized_merge": registry.q_personalized_merge,
    "stream_frequency": registry.q_stream_frequency,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus))
    registry.freq_parts(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    jobs = dict(HEADLINE)
    if not only or any(n.endswith("_stored") for n in only):
        stored = Stored(spark, sf_dir)
        jobs.update(
            {
                "incremental_refresh_stored": stored.incremental,
                "full_rebuild_stored": stored.rebuild,
                "decay_step_stored": stored.decay,
            }
        )
    for name, fn in jobs.items():
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    figures = {}
    if not only:
        figures = _ring_figures(spark)
        st = registry.q_batch_stats(spark, sf_dir).first()
        figures["batch_write_reduction"] = {
            "events": st.total_events,
            "db_writes": st.total_db_writes,
            "flushes": st.flushes,
            "writes_saved_pct": st.writes_saved_pct,
        }
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_jobs_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "cpus": cpus,
                "figures": figures,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
