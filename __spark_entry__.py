"""

``entry(spark)`` runs the flagship job (the prefix top-k index over the
document catalog) on sf0.001. ``queries()`` maps every job of
``prefixdex.plans.registry`` to a callable ``(spark, sf_dir) → DataFrame``;
``oracle_sql()`` gives, per job, the same computation as plain SQL over the
driver's tables (DuckDB dialect), with identical column names.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from prefixdex.plans import registry  # noqa: E402
from prefixdex.plans.session import ensure_checkpoint_dir  # noqa: E402

try:  # the training-data operators are an optional part
    import corpus_pipeline
    from prefixdex.llm import oracle as llm_oracle
    from prefixdex.llm import queries as llm_queries
except ImportError:
    corpus_pipeline = llm_oracle = llm_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"


def _prepare(spark: SparkSession) -> None:
    """Ticks and event-time windows are defined on UTC wall-clock time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: top-10 suggestions of every prefix (length 1..40) under both
    rankings, for the frequency table built from all document lines."""
    _prepare(spark)
    return registry.q_prefix_index_documents(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            _prepare(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        return run

    found = {name: wrap(fn) for name, fn in registry.QUERIES.items()}
    if llm_queries is not None:
        found |= {name: wrap(fn) for name, fn in llm_queries.QUERIES.items()}
        found["pipeline"] = wrap(corpus_pipeline.run)
    return found


# --------------------------------------------------------------------------
# Oracle SQL. Shared pieces are SQL text macros; every query is self-contained.
# --------------------------------------------------------------------------

_WS = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_NUM = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_ANCHOR = "TIMESTAMP '2024-01-01 00:00:00'"
_F = 0.9


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{_WS}+', ' ', 'g'))"


def _wtrim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _tick(ts: str, seconds: int) -> str:
    return f"CAST(floor((epoch_us({ts}) - epoch_us({_ANCHOR})) / {seconds * 1_000_000}) AS BIGINT)"


def _hash32(x: str) -> str:
    return f"CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"


_PART_CATALOG = """
part_catalog AS (
  SELECT p.p_name AS title, CAST(coalesce(s.n_lines, 0) AS VARCHAR) AS reviews, p.p_partkey AS ordinal
  FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS n_lines FROM lineitem GROUP BY l_partkey) s
    ON p.p_partkey = s.l_partkey)"""

_DOC_CATALOG = """
doc_catalog AS (
  SELECT u.line AS title, '1' AS reviews, d.doc_id * 1048576 + (u.pos - 1) AS ordinal
  FROM documents d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS u(line, pos))"""


def _classified(src: str, name: str) -> str:
    num = f"CASE WHEN regexp_full_match(reviews, '{_NUM}') THEN TRY_CAST(trim(reviews) AS DOUBLE) END"
    return f"""
{name} AS (
  SELECT *, CASE
      WHEN num IS NULL THEN 'reviews not a number'
      WHEN NOT (num > 0) THEN 'reviews not positive'
      WHEN length({_wtrim("coalesce(title, '')")}) = 0 THEN 'blank title'
      WHEN num <> floor(num) THEN 'reviews not integral'
    END AS reject_reason
  FROM (SELECT *, {num} AS num FROM {src}))"""


def _freq(src: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT query, arg_min(title, ordinal) AS display, CAST(sum(n) AS BIGINT) AS count,
         CAST(sum(n) AS DOUBLE) AS score
  FROM (SELECT {_norm("title")} AS query, title, CAST(num AS BIGINT) AS n, ordinal
        FROM {src} WHERE reject_reason IS NULL)
  WHERE query <> ''
  GROUP BY query)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


_PARTS_FREQ = [_PART_CATALOG, _classified("part_catalog", "part_classified"), _freq("part_classified", "freq")]
_DOCS_FREQ = [_DOC_CATALOG, _classified("doc_catalog", "doc_classified"), _freq("doc_classified", "freq")]

_EVENTS = f"""
search_events AS (
  SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, p.p_name AS query
  FROM events e JOIN part p ON p.p_partkey = e.event_id % (SELECT count(*) FROM part)),
accepted AS (
  SELECT * FROM search_events
  WHERE length({_wtrim("coalesce(query, '')")}) BETWEEN 1 AND 512)"""

_LINES = """
line_catalog AS (
  SELECT u.line AS title, CASE d.lang WHEN 'en' THEN '1' WHEN 'de' THEN '1.5' WHEN 'fr' THEN 'n/a' WHEN 'es' THEN '0' END AS reviews,
         d.doc_id * 1048576 + (u.pos - 1) AS ordinal
  FROM documents d, unnest(string_split(d.text, chr(10))) WITH ORDINALITY AS u(line, pos))"""
_LINES_FREQ = [_LINES, _classified("line_catalog", "line_classified"), _freq("line_classified", "freq")]

_LINE_EVENTS = f"""
line_of AS (
  SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, l.lines[CAST(e.event_id // n.n % len(l.lines) AS BIGINT) + 1] AS line
  FROM events e, (SELECT count(*) AS n FROM documents) n,
       (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) l
  WHERE l.doc_id = e.event_id % n.n),
search_events AS (
  SELECT event_id, ts, user_id, event_type, value,
         CASE event_type WHEN 'error' THEN '  ' WHEN 'signup' THEN repeat(line, 1 + 512 // greatest(length(line), 1))
           WHEN 'purchase' THEN translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE line END AS query
  FROM line_of),
accepted AS (
  SELECT * FROM search_events
  WHERE length({_wtrim("coalesce(query, '')")}) BETWEEN 1 AND 512)"""

_TYPED = """
typed_requests AS (
  SELECT user_id, CASE WHEN event_type = 'signup' THEN query ELSE substr(query, 1, 1 + event_id % 60) END AS typed,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'recent' ELSE 'count' END AS rank
  FROM {src})"""

_NOW_DAY = f"(SELECT {_tick('max(ts)', 86400)} FROM events)"
_NOW_FLUSH = f"(SELECT {_tick('max(ts)', 21600)} FROM events)"

_DELTAS = f"""
deltas AS (
  SELECT {_norm("query")} AS query, first({_wtrim("query")} ORDER BY ts, event_id) AS display,
         count(*) AS delta, sum(pow({_F}, {_NOW_DAY} - {_tick("ts", 86400)})) AS g
  FROM accepted WHERE {_norm("query")} <> '' GROUP BY 1)"""


def _upsert(base: str, deltas: str, name: str, score_delta: str = "delta") -> str:
    return f"""
{name} AS (
  SELECT coalesce(b.query, d.query) AS query, coalesce(b.display, d.display) AS display,
         CAST(coalesce(b.count, 0) + coalesce(d.delta, 0) AS BIGINT) AS count,
         coalesce(b.score, 0) + coalesce(d.{score_delta}, 0) AS score
  FROM {base} b FULL OUTER JOIN {deltas} d ON b.query = d.query)"""


_LIVE = [
    f"""
aged AS (
  SELECT query, display, count, score * pow({_F}, {_NOW_DAY}) AS score FROM freq)""",
    _upsert("aged", "deltas", "live", "g"),
]


def _index_long(freq: str, name: str, max_len: int = 40, keep_key: bool = False) -> str:
    key = ", query_norm" if keep_key else ""
    return f"""
{name}_cands AS (
  SELECT substr(f.query, 1, l.plen) AS prefix, r.rank, f.query AS query_norm, f.display AS query,
         f.count, f.score,
         CASE WHEN r.rank = 'recent' THEN f.score ELSE CAST(f.count AS DOUBLE) END AS metric
  FROM {freq} f, unnest(range(1, least(length(f.query), {max_len}) + 1)) AS l(plen),
       (VALUES ('count'), ('recent')) AS r(rank)
  WHERE length(f.query) >= 1),
{name} AS (
  SELECT prefix, rank, pos, query, count, score{key} FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY prefix, rank ORDER BY metric DESC, query) AS INTEGER) AS pos
    FROM {name}_cands WHERE NOT suffix(prefix, ' '))
  WHERE pos <= 10)"""


_KEYSTROKE_KEYS = f"""
keystrokes AS (
  SELECT e.event_id, e.user_id, e.ts, substr(e.query, 1, t.i) AS typed
  FROM accepted e, unnest(range(1, greatest(length(e.query), 1) + 1)) AS t(i)),
keys AS (
  SELECT {_norm("typed")} AS prefix, r.rank, count(*) AS n_requests
  FROM keystrokes, (VALUES ('count'), ('recent')) AS r(rank)
  WHERE length(typed) > 0 GROUP BY 1, 2)"""


def _direct_answers(freq: str, keys: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT prefix, rank, pos, query, count, score FROM (
    SELECT k.prefix, k.rank, f.display AS query, f.count, f.score,
      CAST(row_number() OVER (PARTITION BY k.prefix, k.rank ORDER BY
        CASE WHEN k.rank = 'recent' THEN f.score ELSE CAST(f.count AS DOUBLE) END DESC, f.display) AS INTEGER) AS pos
    FROM (SELECT DISTINCT prefix, rank FROM {keys} WHERE prefix <> '') k
    JOIN {freq} f ON starts_with(f.query, k.prefix))
  WHERE pos <= 10)"""


def _ring(nodes: tuple[str, ...], name: str) -> str:
    values = ", ".join(f"('{n}', {i})" for i, n in enumerate(nodes))
    return f"""
{name}_v AS (
  SELECT n.node, {_hash32("n.node || '#' || CAST(v.vnode AS VARCHAR)")} AS hash, n.ord * 150 + v.vnode AS ord
  FROM (VALUES {values}) AS n(node, ord), range(150) AS v(vnode)),
{name}_u AS (SELECT hash, arg_min(node, ord) AS node FROM {name}_v GROUP BY hash),
{name}_iv AS (
  SELECT node, hash AS hi, lag(hash) OVER (ORDER BY hash) AS lo, max(hash) OVER () AS last_hash FROM {name}_u),
{name} AS (
  SELECT node, coalesce(lo, -1) AS lo, hi FROM {name}_iv
  UNION ALL SELECT node, last_hash AS lo, 4294967295 AS hi FROM {name}_iv WHERE lo IS NULL)"""


def _owner(keys: str, key_col: str, ring: str, name: str, out: str = "node") -> str:
    return f"""
{name} AS (
  SELECT k.*, r.node AS {out}
  FROM (SELECT *, {_hash32(key_col)} AS _h FROM {keys}) k
  JOIN {ring} r ON k._h > r.lo AND k._h <= r.hi)"""


_NODES = ("redis-0", "redis-1", "redis-2")

_FLUSHED = f"""
flushed AS (
  SELECT *, CAST(floor(pos / 50) AS BIGINT) AS flush_no FROM (
    SELECT *, row_number() OVER (PARTITION BY tick ORDER BY ts, event_id) - 1 AS pos
    FROM (SELECT *, {_tick("ts", 21600)} AS tick FROM accepted WHERE {_norm("query")} <> '')))"""

_FLUSH_DELTAS = f"""
flush_deltas AS (
  SELECT tick, flush_no, {_norm("query")} AS query,
         first({_wtrim("query")} ORDER BY ts, event_id) AS display, count(*) AS delta
  FROM flushed GROUP BY 1, 2, 3)"""

_FLUSH_SUMMARY = """
flush_summary AS (
  SELECT w.tick, w.flush_no, w.events, w.db_writes, coalesce(i.invalidations, 0) AS invalidations
  FROM (SELECT tick, flush_no, CAST(sum(delta) AS BIGINT) AS events, count(*) AS db_writes
        FROM flush_deltas GROUP BY 1, 2) w
  LEFT JOIN (
    SELECT tick, flush_no, count(*) * 2 AS invalidations FROM (
      SELECT DISTINCT tick, flush_no, substr(query, 1, l.plen) AS prefix
      FROM flush_deltas, unnest(range(1, least(length(query), 40) + 1)) AS l(plen)
      WHERE length(query) >= 1)
    WHERE NOT suffix(prefix, ' ') GROUP BY 1, 2) i
  ON w.tick = i.tick AND w.flush_no = i.flush_no)"""

_SERVING = f"""
serving AS (
  SELECT ts, event_id, query AS q,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'recent' ELSE 'count' END AS rank,
    CASE event_type WHEN 'view' THEN 'hit' WHEN 'click' THEN 'hit' WHEN 'purchase' THEN 'miss'
      WHEN 'signup' THEN 'miss' WHEN 'error' THEN 'skip' END AS cache,
    value AS latency_ms
  FROM search_events),
serving_keyed AS (
  SELECT *, 'sug:' || rank || ':' || {_norm("q")} AS key FROM serving),"""

_HISTORY = f"""
hist AS (
  SELECT user_id, pos, q, ts FROM (
    SELECT user_id, q, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS pos
    FROM (
      SELECT user_id, arg_max(q, (ts, event_id)) AS q, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id
      FROM (SELECT user_id, {_wtrim("query")} AS q, ts, event_id FROM accepted)
      WHERE length(q) > 0
      GROUP BY user_id, lower(q)))
  WHERE pos <= 50)"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    parts = _with(*_PARTS_FREQ)
    docs = _with(*_DOCS_FREQ)

    q["frequency_parts"] = parts + " SELECT query, display, count, score FROM freq"
    q["frequency_documents"] = docs + " SELECT query, display, count, score FROM freq"
    q["catalog_rejects_parts"] = (
        _with(_PART_CATALOG, _classified("part_catalog", "c"))
        + " SELECT coalesce(reject_reason, 'ok') AS reason, count(*) AS n_rows FROM c GROUP BY 1"
    )
    q["load_profile_parts"] = parts + """
      SELECT (SELECT count(*) FROM part_classified) AS rows_read,
             (SELECT count(*) FROM part_classified WHERE reject_reason IS NULL) AS qualifying,
             (SELECT count(*) FROM part_classified WHERE reject_reason IS NULL) AS kept,
             (SELECT count(*) FROM freq) AS unique_queries,
             (SELECT min(count) FROM freq) AS min_count,
             (SELECT max(count) FROM freq) AS max_count,
             (SELECT count(*) FROM freq) < 100000 AS below_minimum"""
    q["dataset_size_documents"] = docs + " SELECT count(*) AS dataset_size FROM freq"
    q["sample_every_parts"] = _with(
        _PART_CATALOG,
        _classified("part_catalog", "c0"),
        """
sampled AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (ORDER BY ordinal) AS rn FROM c0 WHERE reject_reason IS NULL)
  WHERE rn % 3 = 0)""",
        _freq("sampled", "freq"),
    ) + " SELECT query, display, count, score FROM freq"
    q["prefix_index_parts"] = _with(*_PARTS_FREQ, _index_long("freq", "idx")) + " SELECT * FROM idx"
    q["prefix_index_documents"] = _with(*_DOCS_FREQ, _index_long("freq", "idx")) + " SELECT * FROM idx"
    q["suggest_prefix_parts"] = parts + """
      SELECT CAST(row_number() OVER (ORDER BY count DESC, display) AS INTEGER) AS pos, display AS query, count, score
      FROM (SELECT * FROM freq WHERE starts_with(query, 'hot') ORDER BY count DESC, display LIMIT 10)"""

    q["catalog_rejects_lines"] = (
        _with(_LINES, _classified("line_catalog", "c"))
        + " SELECT coalesce(reject_reason, 'ok') AS reason, count(*) AS n_rows FROM c GROUP BY 1"
    )
    q["search_validation_lines"] = _with(_LINE_EVENTS) + f"""
      SELECT event_id, CASE WHEN length({_wtrim("coalesce(query, '')")}) = 0 THEN 'required'
                            WHEN length({_wtrim("coalesce(query, '')")}) > 512 THEN 'exceeds 512 chars' END AS error
      FROM search_events"""
    line_deltas = f"""
deltas AS (
  SELECT {_norm("query")} AS query, first({_wtrim("query")} ORDER BY ts, event_id) AS display, count(*) AS delta
  FROM accepted WHERE {_norm("query")} <> '' GROUP BY 1)"""
    q["upsert_lines"] = _with(*_LINES_FREQ, _LINE_EVENTS, line_deltas, _upsert("freq", "deltas", "upserted")) + """
      SELECT query, display, count, score FROM upserted"""
    line_keys = f"""
keys AS (
  SELECT {_norm("typed")} AS prefix, rank, CASE WHEN length(typed) > 512 THEN 'exceeds 512 chars' END AS reason,
         count(*) AS n_requests
  FROM typed_requests GROUP BY 1, 2, 3),
asked AS (SELECT *, 'sug:' || rank || ':' || prefix AS key FROM keys WHERE prefix <> '' AND reason IS NULL)"""
    line_lookup = _with(
        *_LINES_FREQ, _LINE_EVENTS, _TYPED.format(src="search_events"), line_keys, _direct_answers("freq", "asked", "ans"),
        _ring(_NODES, "ring"), _owner("asked", "key", "ring", "owned"),
        """
lists AS (SELECT prefix, rank, count(*) AS n, arg_min(query, pos) AS first FROM ans GROUP BY 1, 2),
indexed AS (SELECT *, length(prefix) <= 40 AND length(prefix) % 5 <> 0 AS fresh FROM lists)""",
    )
    served = """
      SELECT k.prefix, k.rank, k.n_requests,
             CASE WHEN k.reason IS NOT NULL THEN 'error' WHEN k.prefix = '' THEN 'skip' {hit} ELSE 'miss' END AS status,
             k.reason, o.node, CAST(coalesce(i.n, 0) AS INTEGER) AS n, i.first AS first
      FROM keys k LEFT JOIN owned o ON o.prefix = k.prefix AND o.rank = k.rank AND k.reason IS NULL
      LEFT JOIN indexed i ON i.prefix = k.prefix AND i.rank = k.rank AND k.reason IS NULL"""
    q["lookup_lines"] = line_lookup + served.format(hit="WHEN i.fresh THEN 'hit'")
    q["lookup_twice_lines"] = line_lookup + served.format(hit="WHEN true THEN 'hit'")
    q["routing_lines"] = line_lookup + """
      SELECT o.prefix, o.rank, o.key, o.node, CASE WHEN i.fresh THEN 'HIT' ELSE 'MISS' END AS status
      FROM owned o LEFT JOIN indexed i ON i.prefix = o.prefix AND i.rank = o.rank"""

    answers_tail = """
      SELECT k.prefix, k.rank, k.n_requests,
             CASE WHEN k.prefix = '' THEN 'skip' ELSE {status} END AS status,
             a.pos, a.query, a.count, a.score
      FROM keys k LEFT JOIN ans a ON a.prefix = k.prefix AND a.rank = k.rank"""
    q["bulk_suggest_keystrokes"] = _with(
        *_PARTS_FREQ, _EVENTS, _KEYSTROKE_KEYS, _direct_answers("freq", "keys", "ans")
    ) + answers_tail.format(status="'miss'")
    q["index_lookup_keystrokes"] = _with(
        *_PARTS_FREQ, _EVENTS, _KEYSTROKE_KEYS, _direct_answers("freq", "keys", "ans")
    ) + answers_tail.format(
        status="CASE WHEN length(k.prefix) <= 40 AND EXISTS "
        "(SELECT 1 FROM freq f WHERE starts_with(f.query, k.prefix)) THEN 'hit' ELSE 'miss' END"
    )

    live = _with(*_PARTS_FREQ, _EVENTS, _DELTAS, *_LIVE)
    q["trending_count"] = live + """
      SELECT CAST(row_number() OVER (ORDER BY count DESC, display) - 1 AS INTEGER) AS pos, display AS query,
             count, round(score, 6) AS score
      FROM (SELECT * FROM live ORDER BY count DESC, display LIMIT 50)"""
    q["trending_recent"] = live + """
      SELECT CAST(row_number() OVER (ORDER BY score DESC, display) - 1 AS INTEGER) AS pos, display AS query,
             count, round(score, 6) AS score
      FROM (SELECT * FROM live ORDER BY score DESC, display LIMIT 6)"""
    q["rank_movement"] = live + """,
rec AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, display) - 1 AS INTEGER) AS pos, display AS query, count, score
        FROM (SELECT * FROM live ORDER BY score DESC, display LIMIT 6)),
cnt AS (SELECT CAST(row_number() OVER (ORDER BY count DESC, display) - 1 AS INTEGER) AS pos_count, display AS query
        FROM (SELECT * FROM live ORDER BY count DESC, display LIMIT 50))
      SELECT r.pos, r.query, r.count, round(r.score, 6) AS score, c.pos_count, c.pos_count - r.pos AS delta,
        CASE WHEN c.pos_count - r.pos > 0 THEN '▲' || CAST(c.pos_count - r.pos AS VARCHAR)
             WHEN c.pos_count - r.pos < 0 THEN '▼' || CAST(r.pos - c.pos_count AS VARCHAR)
             ELSE '—' END AS arrow,
        CAST(round(greatest(8.0, r.score / greatest((SELECT max(score) FROM rec), 1.0) * 100)) AS BIGINT) AS bar_pct
      FROM rec r LEFT JOIN cnt c ON r.query = c.query"""
    q["suggestion_movement"] = _with(*_PARTS_FREQ, _EVENTS, _DELTAS, *_LIVE, _index_long("live", "idx")) + """
      SELECT r.prefix, r.query, r.pos AS pos_recent, c.pos AS pos_count,
             CASE WHEN c.pos - r.pos > 0 THEN '▲' || CAST(c.pos - r.pos AS VARCHAR) END AS arrow
      FROM (SELECT * FROM idx WHERE rank = 'recent') r
      LEFT JOIN (SELECT * FROM idx WHERE rank = 'count') c ON r.prefix = c.prefix AND r.query = c.query"""

    seps = [" - ", " – ", " — ", " | ", ", "]
    cut = "coalesce(least(" + ", ".join(
        f"CASE WHEN instr(display, '{s}') > 1 THEN instr(display, '{s}') - 1 END" for s in seps
    ) + "), length(display))"
    name = _wtrim(f"substr(display, 1, {cut})")
    q["short_names_documents"] = docs + f""",
named AS (SELECT query, {name} AS nm FROM freq)
      SELECT query, CASE WHEN length(nm) > 52 THEN {_wtrim("substr(nm, 1, 52)")} || '…' ELSE nm END AS short_name
      FROM named"""

    ev = _with(*_PARTS_FREQ, _EVENTS)
    q["search_validation"] = ev + f"""
      SELECT event_id, CASE WHEN length({_wtrim("coalesce(query, '')")}) = 0 THEN 'required'
                            WHEN length({_wtrim("coalesce(query, '')")}) > 512 THEN 'exceeds 512 chars' END AS error
      FROM search_events"""
    fl = _with(*_PARTS_FREQ, _EVENTS, _FLUSHED)
    q["flush_assignment"] = fl + " SELECT event_id, tick, flush_no FROM flushed"
    fs = _with(*_PARTS_FREQ, _EVENTS, _FLUSHED, _FLUSH_DELTAS, _FLUSH_SUMMARY)
    q["flush_summary"] = fs + " SELECT * FROM flush_summary"
    q["batch_stats"] = fs + """
      SELECT count(*) AS flushes, CAST(coalesce(sum(events), 0) AS BIGINT) AS total_events,
             CAST(coalesce(sum(db_writes), 0) AS BIGINT) AS total_db_writes,
             CAST(coalesce(sum(invalidations), 0) AS BIGINT) AS total_invalidations,
             CASE WHEN coalesce(sum(events), 0) > 0
                  THEN CAST(round((1 - sum(db_writes) / sum(events)) * 100) AS BIGINT) ELSE 0 END AS writes_saved_pct,
             50 AS batch_size, 21600 AS flush_interval_sec
      FROM flush_summary"""
    q["event_deltas"] = _with(*_PARTS_FREQ, _EVENTS, _FLUSHED, _FLUSH_DELTAS) + " SELECT * FROM flush_deltas"
    q["pending_view"] = _with(*_PARTS_FREQ, _EVENTS, _FLUSHED) + f""",
cur AS (SELECT * FROM flushed WHERE tick = {_NOW_FLUSH}),
last_chunk AS (SELECT tick, flush_no FROM cur GROUP BY 1, 2 HAVING count(*) < 50),
pend AS (
  SELECT {_norm("query")} AS q, count(*) AS n
  FROM cur c WHERE EXISTS (SELECT 1 FROM last_chunk l WHERE l.tick = c.tick AND l.flush_no = c.flush_no)
  GROUP BY 1)
      SELECT q, n, CAST(sum(n) OVER () AS BIGINT) AS pending_events, count(*) OVER () AS pending_queries FROM pend"""
    upd = _with(*_PARTS_FREQ, _EVENTS, _DELTAS, _upsert("freq", "deltas", "upserted"))
    q["upsert_events"] = upd + " SELECT query, display, count, score FROM upserted"
    q["affected_prefixes"] = _with(*_PARTS_FREQ, _EVENTS, _DELTAS) + """
      SELECT prefix, r.rank, 'sug:' || r.rank || ':' || prefix AS key FROM (
        SELECT DISTINCT substr(query, 1, l.plen) AS prefix
        FROM deltas, unnest(range(1, least(length(query), 40) + 1)) AS l(plen)
        WHERE length(query) >= 1) p, (VALUES ('count'), ('recent')) AS r(rank)
      WHERE NOT suffix(prefix, ' ')"""
    q["incremental_index"] = _with(
        *_PARTS_FREQ, _EVENTS, _DELTAS, _upsert("freq", "deltas", "upserted"), _index_long("upserted", "idx")
    ) + " SELECT * FROM idx"
    q["decay_step"] = parts + " SELECT query, count, round(score * 0.9, 6) AS score FROM freq"
    q["recency_scores"] = _with(*_PARTS_FREQ, _EVENTS) + f"""
      SELECT {_norm("query")} AS query, count(*) AS events,
             round(sum(pow({_F}, -{_tick("ts", 86400)})) * pow({_F}, {_NOW_DAY}), 6) AS score
      FROM accepted WHERE {_norm("query")} <> '' GROUP BY 1"""

    doc_keys = "doc_keys AS (SELECT 'sug:count:' || query AS key FROM freq)"
    q["key_owner_documents"] = _with(
        *_DOCS_FREQ, doc_keys, _ring(_NODES, "ring"), _owner("doc_keys", "key", "ring", "owned")
    ) + " SELECT key, node FROM owned"
    q["node_balance_documents"] = _with(
        *_DOCS_FREQ, doc_keys, _ring(_NODES, "ring"), _owner("doc_keys", "key", "ring", "owned")
    ) + """
      SELECT node, count(*) AS keys, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS share_pct
      FROM owned GROUP BY node"""
    q["remap_add_node_documents"] = _with(
        *_DOCS_FREQ,
        doc_keys,
        _ring(_NODES, "ring_a"),
        _ring((*_NODES, "redis-3"), "ring_b"),
        _owner("doc_keys", "key", "ring_a", "own_a", "old"),
        _owner("own_a", "key", "ring_b", "own_b", "new"),
    ) + """
      SELECT count(*) AS keys, count(*) FILTER (WHERE old <> new) AS moved,
             count(*) FILTER (WHERE old <> new AND new <> 'redis-3') AS moved_elsewhere,
             round(count(*) FILTER (WHERE old <> new) * 100.0 / count(*), 2) AS moved_pct
      FROM own_b"""
    q["remap_remove_node_documents"] = _with(
        *_DOCS_FREQ,
        doc_keys,
        _ring((*_NODES, "redis-3"), "ring_a"),
        _ring(_NODES, "ring_b"),
        _owner("doc_keys", "key", "ring_a", "own_a", "old"),
        _owner("own_a", "key", "ring_b", "own_b", "new"),
    ) + """
      SELECT count(*) AS keys, count(*) FILTER (WHERE old <> new) AS moved,
             count(*) FILTER (WHERE old <> new AND old <> 'redis-3') AS moved_elsewhere,
             round(count(*) FILTER (WHERE old <> new) * 100.0 / count(*), 2) AS moved_pct
      FROM own_b"""
    q["delete_batches_documents"] = _with(
        *_DOCS_FREQ,
        """
dkeys AS (
  SELECT DISTINCT 'sug:' || r.rank || ':' || prefix AS key FROM (
    SELECT DISTINCT substr(query, 1, l.plen) AS prefix
    FROM freq, unnest(range(1, least(length(query), 40) + 1)) AS l(plen) WHERE length(query) >= 1) p,
    (VALUES ('count'), ('recent')) AS r(rank)
  WHERE NOT suffix(prefix, ' '))""",
        _ring(_NODES, "ring"),
        _owner("dkeys", "key", "ring", "owned"),
    ) + f""",
nb AS (SELECT node, CAST(ceil(count(*) / 1000) AS BIGINT) AS nb FROM owned GROUP BY node)
      SELECT o.node, ({_hash32("o.key")} % nb.nb) AS batch, count(*) AS n_keys,
             min(o.key) AS first_key, max(o.key) AS last_key
      FROM owned o JOIN nb ON o.node = nb.node GROUP BY 1, 2"""
    q["routing_keystrokes"] = _with(
        *_PARTS_FREQ,
        _EVENTS,
        _KEYSTROKE_KEYS,
        """
rkeys AS (SELECT prefix, rank, 'sug:' || rank || ':' || prefix AS key FROM keys WHERE prefix <> '')""",
        _ring(_NODES, "ring"),
        _owner("rkeys", "key", "ring", "owned"),
    ) + """
      SELECT prefix, rank, key, node,
             CASE WHEN length(prefix) <= 40 AND EXISTS (SELECT 1 FROM freq f WHERE starts_with(f.query, prefix))
                  THEN 'HIT' ELSE 'MISS' END AS status
      FROM owned"""
    serving = _with(*_PARTS_FREQ, _EVENTS, _SERVING.rstrip(","), _ring(_NODES, "ring"),
                    _owner("serving_keyed", "key", "ring", "owned")) + """,
logged AS (SELECT *, CASE WHEN cache = 'skip' THEN '' ELSE node END AS node2 FROM owned)"""
    q["hit_rate_by_node"] = serving + """
      SELECT node2 AS node, count(*) FILTER (WHERE cache = 'hit') AS hits,
             count(*) FILTER (WHERE cache = 'miss') AS misses, count(*) FILTER (WHERE cache = 'skip') AS skips,
             CASE WHEN count(*) FILTER (WHERE cache IN ('hit', 'miss')) > 0
                  THEN CAST(round(count(*) FILTER (WHERE cache = 'hit') * 100.0
                                  / count(*) FILTER (WHERE cache IN ('hit', 'miss'))) AS BIGINT)
                  ELSE 0 END AS hit_rate
      FROM logged GROUP BY node2"""
    q["rolling_latency"] = serving + """,
win AS (
  SELECT node2 AS node, event_id, latency_ms AS last,
         list_sort(list(latency_ms) OVER (PARTITION BY node2 ORDER BY ts, event_id
                                          ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)) AS s
  FROM logged)
      SELECT node, event_id, last,
             s[CAST(least(len(s) - 1, floor(0.5 * len(s))) AS INTEGER) + 1] AS p50,
             s[CAST(least(len(s) - 1, floor(0.95 * len(s))) AS INTEGER) + 1] AS p95,
             CAST(len(s) AS INTEGER) AS samples
      FROM win"""
    q["user_history"] = _with(*_PARTS_FREQ, _EVENTS, _HISTORY) + " SELECT * FROM hist"
    q["personalized_merge"] = _with(
        *_PARTS_FREQ,
        _EVENTS,
        _HISTORY,
        f"""
req AS (
  SELECT DISTINCT e.user_id, substr(e.query, 1, t.i) AS typed
  FROM accepted e, unnest(range(1, greatest(length(e.query), 1) + 1)) AS t(i)
  WHERE length(substr(e.query, 1, t.i)) > 0),
req2 AS (
  SELECT user_id, typed, lower({_wtrim("typed")}) AS p, {_norm("typed")} AS prefix FROM req
  WHERE lower({_wtrim("typed")}) <> ''),
gkeys AS (SELECT DISTINCT prefix, 'count' AS rank FROM req2 WHERE prefix <> '')""",
        _direct_answers("freq", "gkeys", "gsug"),
        """
hm AS (
  SELECT r.user_id, r.typed, lower(h.q) AS k, 0 AS src, h.pos AS ord, coalesce(g.query, h.q) AS query,
         g.count, g.score, true AS personalized
  FROM req2 r JOIN hist h ON h.user_id = r.user_id
  LEFT JOIN gsug g ON g.prefix = r.prefix AND lower(g.query) = lower(h.q)
  WHERE starts_with(lower(h.q), r.p)),
gm AS (
  SELECT r.user_id, r.typed, lower(g.query) AS k, 1 AS src, g.pos AS ord, g.query, g.count, g.score,
         false AS personalized
  FROM req2 r JOIN gsug g ON g.prefix = r.prefix
  WHERE NOT EXISTS (SELECT 1 FROM hm WHERE hm.user_id = r.user_id AND hm.typed = r.typed
                    AND hm.k = lower(g.query)))""",
    ) + """
      SELECT user_id, typed, pos, query, count, score, personalized FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY user_id, typed ORDER BY src, ord) AS INTEGER) AS pos
        FROM (SELECT * FROM hm UNION ALL SELECT * FROM gm))
      WHERE pos <= 10"""
    keystrokes_asked = """
req AS (
  SELECT DISTINCT e.user_id, substr(e.query, 1, t.i) AS typed
  FROM accepted e, unnest(range(1, greatest(length(e.query), 1) + 1)) AS t(i)
  WHERE length(substr(e.query, 1, t.i)) > 0),"""
    lines = ",".join([*_LINES_FREQ, _LINE_EVENTS, _TYPED.format(src="accepted")])
    q["personalized_merge_lines"] = (
        q["personalized_merge"]
        .replace(",".join([*_PARTS_FREQ, _EVENTS]), lines)
        .replace(keystrokes_asked, "req AS (SELECT DISTINCT user_id, typed FROM typed_requests),")
    )
    q["stream_frequency"] = live + """
      SELECT query, display, count, round(score, 6) AS score FROM live"""
    q["payloads_parts"] = _with(*_PARTS_FREQ, _index_long("freq", "idx")) + """
      SELECT prefix, rank, 'sug:' || rank || ':' || prefix AS key,
             CAST(to_json(list(struct_pack(query := query, count := count, score := score) ORDER BY pos)) AS VARCHAR)
               AS payload,
             CAST(count(*) AS INTEGER) AS n
      FROM idx GROUP BY prefix, rank"""
    q["stream_index"] = _with(*_PARTS_FREQ, _EVENTS, _DELTAS, *_LIVE, _index_long("live", "idx")) + """
      SELECT prefix, rank, pos, query, count, round(score, 6) AS score FROM idx"""
    now_minute = f"(SELECT {_tick('max(ts)', 60)} FROM events)"
    q["recency_scores_minutes"] = _with(*_PARTS_FREQ, _EVENTS) + f"""
      SELECT {_norm("query")} AS query, count(*) AS events,
             round(sum(pow({_F}, {now_minute} - {_tick("ts", 60)})), 6) AS score
      FROM accepted WHERE {_norm("query")} <> '' GROUP BY 1"""
    minutes = f"""
deltas AS (
  SELECT {_norm("query")} AS query, first({_wtrim("query")} ORDER BY ts, event_id) AS display,
         count(*) AS delta, sum(pow({_F}, {now_minute} - {_tick("ts", 60)})) AS g
  FROM accepted WHERE {_norm("query")} <> '' GROUP BY 1),
aged AS (SELECT query, display, count, score * pow({_F}, {now_minute}) AS score FROM freq)"""
    q["stream_index_minutes"] = _with(
        *_PARTS_FREQ, _EVENTS, minutes, _upsert("aged", "deltas", "live", "g"), _index_long("live", "idx")
    ) + " SELECT prefix, rank, pos, query, count, round(score, 6) AS score FROM idx"
    q["pending_stream"] = _with(*_PARTS_FREQ, _EVENTS) + f"""
      SELECT {_norm("query")} AS q, count(*) AS n FROM accepted
      WHERE {_norm("query")} <> '' AND {_tick("ts", 21600)} = {_NOW_FLUSH} GROUP BY 1"""
    q["hit_rate_daily_stream"] = serving + f""",
daily AS (SELECT *, {_tick("ts", 86400)} AS day FROM logged)
      SELECT day, node2 AS node, count(*) FILTER (WHERE cache = 'hit') AS hits,
             count(*) FILTER (WHERE cache = 'miss') AS misses, count(*) FILTER (WHERE cache = 'skip') AS skips,
             CASE WHEN count(*) FILTER (WHERE cache IN ('hit', 'miss')) > 0
                  THEN CAST(round(count(*) FILTER (WHERE cache = 'hit') * 100.0
                                  / count(*) FILTER (WHERE cache IN ('hit', 'miss'))) AS BIGINT)
                  ELSE 0 END AS hit_rate
      FROM daily GROUP BY day, node2"""
    q["hit_rate_by_rank"] = _with(*_PARTS_FREQ, _EVENTS, _SERVING.rstrip(",")) + """
      SELECT rank, count(*) FILTER (WHERE cache = 'hit') AS hits,
             count(*) FILTER (WHERE cache = 'miss') AS misses, count(*) FILTER (WHERE cache = 'skip') AS skips,
             CASE WHEN count(*) FILTER (WHERE cache IN ('hit', 'miss')) > 0
                  THEN CAST(round(count(*) FILTER (WHERE cache = 'hit') * 100.0
                                  / count(*) FILTER (WHERE cache IN ('hit', 'miss'))) AS BIGINT)
                  ELSE 0 END AS hit_rate
      FROM serving GROUP BY rank"""
    q["recency_stream"] = q["recency_scores"]
    q["prefix_index_documents_split"] = q["prefix_index_documents"]
    q["lookup_overlay_lines"] = q["lookup_twice_lines"]
    q["upsert_store_lines"] = q["upsert_lines"]
    q["index_store_lines"] = _with(
        *_LINES_FREQ, _LINE_EVENTS, line_deltas, _upsert("freq", "deltas", "upserted"), _index_long("upserted", "idx")
    ) + " SELECT * FROM idx"
    q["bulk_suggest_lines"] = _with(
        *_LINES_FREQ, _LINE_EVENTS, _TYPED.format(src="search_events"), line_keys, _direct_answers("freq", "asked", "ans")
    ) + """
      SELECT k.prefix, k.rank, k.n_requests,
             CASE WHEN k.reason IS NOT NULL THEN 'error' WHEN k.prefix = '' THEN 'skip' ELSE 'miss' END AS status,
             a.pos, a.query, a.count, a.score
      FROM keys k LEFT JOIN ans a ON a.prefix = k.prefix AND a.rank = k.rank AND k.reason IS NULL"""
    asked = ", ".join(f"('{p}', {_norm(repr(p))})" for p in registry.STORED_PREFIXES)
    q["suggest_stored_lines"] = _with(*_LINES_FREQ) + f"""
      SELECT prefix, pos, query, count, score FROM (
        SELECT p.prefix, f.display AS query, f.count, f.score,
               CAST(row_number() OVER (PARTITION BY p.prefix ORDER BY f.count DESC, f.display) AS INTEGER) AS pos
        FROM (VALUES {asked}) AS p(prefix, norm) JOIN freq f ON starts_with(f.query, p.norm))
      WHERE pos <= 10"""
    q["prefix_index_radix"] = q["prefix_index_documents"]
    q["radix_nodes_documents"] = _with(*_DOCS_FREQ) + """
      SELECT n_queries, count(*) AS n_nodes, CAST(sum(label_chars) AS BIGINT) AS label_chars FROM (
        SELECT n_queries, first_query, max(length(prefix)) AS label_chars FROM (
          SELECT substr(f.query, 1, l.plen) AS prefix, count(*) AS n_queries, min(f.query) AS first_query
          FROM freq f, unnest(range(1, least(length(f.query), 40) + 1)) AS l(plen)
          WHERE NOT suffix(substr(f.query, 1, l.plen), ' ') GROUP BY 1)
        GROUP BY n_queries, first_query)
      GROUP BY n_queries"""
    q["radix_lookup_lines"] = _with(
        *_LINES_FREQ, _LINE_EVENTS, _TYPED.format(src="search_events"), line_keys, _direct_answers("freq", "asked", "ans")
    ) + " SELECT prefix, rank, pos, query, count, score FROM ans WHERE length(prefix) <= 40"
    q["rebalance_documents"] = q["remap_add_node_documents"]
    q["placement_documents"] = _with(
        *_DOCS_FREQ, doc_keys, _ring(("redis-1", "redis-2", "redis-3"), "ring"), _owner("doc_keys", "key", "ring", "owned")
    ) + " SELECT key, node FROM owned"
    q["flush_stream"] = q["flush_assignment"]
    q["pending_flush_stream"] = q["pending_view"]
    q["history_stream"] = q["user_history"]
    q["trending_stream"] = q["trending_count"]
    q["ingest_csv_parts"] = q["frequency_parts"]
    q["ingest_profile_parts"] = q["load_profile_parts"]
    if llm_oracle is not None:
        q |= llm_oracle.ORACLE_SQL
        if corpus_pipeline.ORACLE_SQL is not None:
            q["pipeline"] = corpus_pipeline.ORACLE_SQL
    q["window_activity_stream"] = _with(*_PARTS_FREQ, _EVENTS) + f"""
      SELECT tick AS window_tick, count(*) AS events, count(DISTINCT nq) AS distinct_queries
      FROM (SELECT {_tick("ts", 21600)} AS tick, {_norm("query")} AS nq FROM accepted WHERE {_norm("query")} <> '')
      GROUP BY tick"""
    return q
