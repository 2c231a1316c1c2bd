"""Text expressions (O4 normalize, O19 short display name, M28 history key).

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; nothing here runs Python per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a JavaScript ``\s`` / ``String.prototype.trim``
# treat as white space (tab, LF, VT, FF, CR, space, NBSP, OGHAM SPACE MARK,
# U+2000..U+200A, LINE SEPARATOR, PARAGRAPH SEPARATOR, NNBSP, MMSP,
# IDEOGRAPHIC SPACE, BOM). Written once as a Java-regex class.
WHITESPACE_CLASS = (
    r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
)

# The same characters one by one, and texts that have no other white space than the space.
_WHITESPACE = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_SPACES_ONLY = r"^[\x20-\x7e\u00a1-\u167f]*+\z"

# Separators that end the short display name, in the order the
# dashboard checks them: " - ", " – ", " — ", " | ", ", ".
SHORT_NAME_SEPARATORS = (" - ", " – ", " — ", " | ", ", ")
SHORT_NAME_MAX = 52
SHORT_NAME_ELLIPSIS = "…"

_PY_WS = re.compile(
    "[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_trim(c: Column | str) -> Column:
    """Strip leading/trailing white space of the full class (Spark ``trim``
    only strips U+0020)."""
    s = _col(c)
    by_regex = ~F.is_valid_utf8(s) | s.endswith("\u0085")  # a line's end, before which ``$`` matches too
    return F.when(by_regex, F.regexp_replace(s, f"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$", "")).otherwise(F.btrim(s, F.lit(_WHITESPACE)))


def has_text(c: Column | str) -> Column:
    """True when a text has a character that is not white space (null for null)."""
    return _col(c).rlike("[^" + WHITESPACE_CLASS[1:])


def normalize(c: Column | str) -> Column:
    """lower → collapse every white-space run to one space → trim. The full class is only
    looked for in texts that may have it (a search for each character is slow)."""
    low = F.lower(_col(c))
    one = F.when(low.rlike(_SPACES_ONLY), F.regexp_replace(low, "  +", " ")).otherwise(F.regexp_replace(low, WHITESPACE_CLASS + "+", " "))
    return F.trim(one)


def normalize_literal(s: str | None) -> str:
    """Driver-side twin of :func:`normalize` for scalar parameters, so a
    normalized prefix can be pushed to the Parquet scan as a literal."""
    if s is None:
        return ""
    return _PY_WS.sub(" ", s.lower()).strip(" ")


def history_key(c: Column | str) -> Column:
    """Case-insensitive history identity: lower + trim, no collapse."""
    return F.lower(ws_trim(c))


def short_name(c: Column | str) -> Column:
    """Dashboard display name: cut at the earliest separator found at an index
    > 0, trim, and shorten to 52 characters plus an ellipsis."""
    s = _col(c)
    cuts = [
        F.when(F.instr(s, sep) > 1, F.instr(s, sep) - 1) for sep in SHORT_NAME_SEPARATORS
    ]
    cut = F.coalesce(F.least(*cuts), F.length(s))
    name = ws_trim(s.substr(F.lit(1), cut))
    return F.when(
        F.length(name) > SHORT_NAME_MAX,
        F.concat(ws_trim(name.substr(1, SHORT_NAME_MAX)), F.lit(SHORT_NAME_ELLIPSIS)),
    ).otherwise(name)
