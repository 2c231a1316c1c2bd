"""Column expressions: every function here takes and returns ``Column``s."""

from prefixdex.functions.text import (
    WHITESPACE_CLASS,
    history_key,
    normalize,
    normalize_literal,
    short_name,
    ws_trim,
)
from prefixdex.functions.keys import cache_key, from_payload, hash32, parse_rank, rank_metric, to_payload
from prefixdex.functions.predicates import has_prefix, is_fresh, validate

__all__ = [
    "WHITESPACE_CLASS",
    "cache_key",
    "from_payload",
    "has_prefix",
    "hash32",
    "history_key",
    "is_fresh",
    "normalize",
    "normalize_literal",
    "parse_rank",
    "rank_metric",
    "short_name",
    "to_payload",
    "validate",
    "ws_trim",
]
