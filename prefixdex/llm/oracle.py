"""The queries that SQL can express, as DuckDB SQL over the table ``documents``."""

from __future__ import annotations

from prefixdex.llm import quality

ORACLE_SQL: dict[str, str] = {}

_EDGE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE_SQL["op1_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, {_EDGE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT d.*, r.k IS NOT NULL AND d.doc_id <> r.holder AS gone FROM keyed d LEFT JOIN repeated r USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

ORACLE_SQL["op5_substring_dedup"] = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
first AS (SELECT win, min(doc_id) AS low FROM windows GROUP BY win HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS pos FROM windows JOIN first USING (win) WHERE low < doc_id),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
left_ AS (
  SELECT e.doc_id, count(*) AS n_words, count(g.pos) AS n_removed,
         string_agg(word, ' ' ORDER BY e.pos) FILTER (WHERE g.pos IS NULL) AS kept
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos GROUP BY e.doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_ USING (doc_id)"""

ORACLE_SQL["op8_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)"""


def _quality() -> str:
    q, rates = quality, quality.RATES
    rate = {r: f"{factor} * {top} // greatest({bottom}, 1)" for r, (top, factor, bottom, _, _) in rates.items()}
    pairs = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {e} AS v FROM good" for r, e in rate.items())
    quant = ", ".join(f"min(bin) FILTER (WHERE 100 * upto >= {p} * size) AS {c}" for c, p in q.QUANTILES.items()) + ", max(size) AS size"

    def level(by: str) -> str:
        keys = f"{by}, rate" if by else "rate"
        return f"""SELECT {keys}, {quant} FROM (
          SELECT {keys}, bin, sum(count(*)) OVER (PARTITION BY {keys} ORDER BY bin) AS upto,
                 sum(count(*)) OVER (PARTITION BY {keys}) AS size FROM binned GROUP BY {keys}, bin) GROUP BY {keys}"""

    limits, tests = [], []
    for r, (_, _, _, least, below) in rates.items():
        limits.append(f"max(mid + {q.SPREAD} * greatest(high - mid, mid // {q.PART}, {least})) FILTER (WHERE rate = '{r}') AS {r}_max")
        tests.append(f"coalesce({rate[r]} > {r}_max, false)")
        if below:
            limits.append(f"max(mid - {q.SPREAD} * greatest(mid - low, mid // {q.PART}, {least})) FILTER (WHERE rate = '{r}') AS {r}_min")
            tests.append(f"coalesce({rate[r]} < {r}_min, false)")
    pick = ", ".join(f"CASE WHEN o.size >= {q.MIN_DOCS} THEN o.{c} WHEN l.size >= {q.MIN_DOCS} THEN l.{c} ELSE a.{c} END AS {c}" for c in q.QUANTILES)
    return rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + {q.WINDOW - 1}], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {q.WINDOW - 2})) AS i FROM w WHERE len(words) >= {q.WINDOW})),
twice AS (
  SELECT doc_id, i FROM windows
  JOIN (SELECT doc_id, win FROM windows GROUP BY doc_id, win HAVING count(*) > 1) USING (doc_id, win)),
repeats AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, i + unnest(range(0, {q.WINDOW})) AS at FROM twice) GROUP BY doc_id),
tl AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, {_EDGE}) <> '') AS lines FROM w),
m AS (
  SELECT w.doc_id, lang, source, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_text_lines
  FROM w JOIN tl USING (doc_id) LEFT JOIN repeats USING (doc_id)),
b AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT} * n_words AS base_failed FROM m),
good AS (SELECT * FROM b WHERE NOT base_failed),
rates AS ({pairs}),
binned AS (SELECT *, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bin FROM rates),
own AS ({level("lang, source")}), bylang AS ({level("lang")}), overall AS ({level("")}),
chosen AS (
  SELECT o.lang, o.source, o.rate, {pick}
  FROM own o JOIN bylang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rate = l.rate JOIN overall a ON a.rate = o.rate),
limits AS (SELECT lang, source, {", ".join(limits)} FROM chosen GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(tests)}) AS kept
FROM b LEFT JOIN limits f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source"""


ORACLE_SQL["op10_quality_rules"] = _quality()


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = (
    f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
)
_STEP = "CASE WHEN {0} % 2 = 1 THEN xor({0} // 2, 3988292384) ELSE {0} // 2 END"

#: crc32 of each distinct word: a table of byte remainders from the polynomial, then
#: one step for each byte.
ORACLE_SQL["op12_importance_resampling"] = f"""
WITH RECURSIVE steps AS (
  SELECT i, i AS v, 0 AS k FROM (SELECT unnest(range(0, 256)) AS i)
  UNION ALL SELECT i, {_STEP.format("v")} AS v, k + 1 AS k FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
f AS (
  SELECT doc_id, true AS is_doc, unnest({_TERMS}) AS word FROM documents
  UNION ALL SELECT NULL, false, unnest({_TERMS}) FROM benchmark),
kinds AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM f)),
bucketed AS (
  SELECT word, xor(list_reduce(
    list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM kinds, crc),
n AS (SELECT doc_id, is_doc, bucket, count(*) AS n FROM f JOIN bucketed USING (word) GROUP BY ALL),
counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE is_doc), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT is_doc), 0) AS t FROM n GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts),
weights AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS whole
  FROM n JOIN gains USING (bucket) WHERE is_doc GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features,
         coalesce(CAST(floor(whole::DOUBLE / n_features) AS BIGINT), 0) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM documents LEFT JOIN weights USING (doc_id)),
placed AS (
  SELECT *, weight + noise AS score, n_features >= 20 AS enough FROM scored),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY enough) AS size FROM placed)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= size * 10 // 100 THEN place END AS rank FROM numbered"""

ORACLE_SQL["op13_lexical_search"] = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
whole AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM d),
items AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM items) GROUP BY doc_id, term),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM whole) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf GROUP BY term),
sizes AS (SELECT doc_id, 100 - 90 + (90 * len(terms) * n) // l AS m FROM d, whole),
gain AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS gain
  FROM tf JOIN weight USING (term) JOIN sizes USING (doc_id)),
scores AS (
  SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM items JOIN gain USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10"""
