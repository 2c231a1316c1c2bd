"""Key, hash and rank expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two rankings and the cache-key layout ``sug:<rank>:<prefix>``.
RANKS = ("count", "recent")
KEY_PREFIX = "sug:"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_rank(c: Column | str) -> Column:
    """Anything but the exact string ``recent`` (including null) is ``count``."""
    return F.when(_col(c) == F.lit("recent"), F.lit("recent")).otherwise(F.lit("count"))


def rank_metric(rank: Column | str, count: Column | str = "count", score: Column | str = "score") -> Column:
    """The ordering value of a row under a rank, as DOUBLE."""
    return F.when(_col(rank) == F.lit("recent"), _col(score).cast("double")).otherwise(
        _col(count).cast("double")
    )


def cache_key(prefix: Column | str, rank: Column | str) -> Column:
    return F.concat(F.lit(KEY_PREFIX), _col(rank), F.lit(":"), _col(prefix))


def hash32(c: Column | str) -> Column:
    """First four bytes of md5(UTF-8 text), read big-endian, as BIGINT."""
    return F.conv(F.substring(F.md5(_col(c)), 1, 8), 16, 10).cast("bigint")


def to_payload(suggestions: Column | str) -> Column:
    """Serialized suggestion list (the cached value)."""
    return F.to_json(_col(suggestions))


def from_payload(payload: Column | str) -> Column:
    return F.from_json(
        _col(payload), "array<struct<query:string,count:bigint,score:double>>"
    )
