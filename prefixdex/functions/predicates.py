"""Predicates (O11 prefix match, O15a freshness, O21 request validation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefixdex.functions.text import has_text, ws_trim

# Fixed value: longest accepted request text.
MAX_QUERY_LEN = 512


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_prefix(c: Column | str, prefix: str | Column) -> Column:
    """Starts-with match. With a literal prefix on a stored column this is
    pushed to the Parquet reader as ``StringStartsWith``."""
    return _col(c).startswith(prefix)


def is_fresh(computed_at: Column | str, ttl_seconds: int, now: Column | None = None) -> Column:
    """TTL ≤ 0 never expires; otherwise an entry expires strictly after
    ``computed_at + ttl``."""
    if ttl_seconds <= 0:
        return F.lit(True)
    now = F.current_timestamp() if now is None else now
    expire_at = _col(computed_at) + F.make_interval(secs=F.lit(ttl_seconds))
    return ~(expire_at < now)


def validate(c: Column | str, mode: str = "trimmed", max_len: int = MAX_QUERY_LEN) -> Column:
    """Reason a request text is rejected, or null when it is accepted.

    ``raw``: only the length of the raw text is checked (suggest requests,
    where blank input is answered with ``skip``). ``trimmed``: the trimmed text
    is required and length-checked (search events, routing debug)."""
    s = _col(c)
    if mode == "raw":
        return F.when(F.coalesce(F.length(s), F.lit(0)) > max_len, F.lit(f"exceeds {max_len} chars"))
    if mode != "trimmed":
        raise ValueError(f"unknown validation mode {mode!r}")
    s = F.coalesce(s, F.lit(""))
    long = (F.length(s) > max_len) & (F.length(ws_trim(s)) > max_len)  # most texts need no trim
    return F.when(~has_text(s), F.lit("required")).when(long, F.lit(f"exceeds {max_len} chars"))
