"""Property tests: Spark expressions against plain-Python statements of the
same rules, over generated text (BMP characters, so string lengths agree)."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefixdex.functions import history_key, normalize, normalize_literal, short_name

WS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2003\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ALPHABET = st.sampled_from(list("aAbBzZ019-–—|,.éÉßΣσ") + list(WS))
TEXTS = st.lists(st.text(ALPHABET, max_size=70), min_size=1, max_size=40)
WS_RE = "[" + re.escape(WS) + "]"


def _trim(s):
    return re.sub(f"^{WS_RE}+|{WS_RE}+$", "", s)


def _short(s):
    cut = len(s)
    for sep in (" - ", " – ", " — ", " | ", ", "):
        i = s.find(sep)
        if 0 < i < cut:
            cut = i
    name = _trim(s[:cut])
    return _trim(name[:52]) + "…" if len(name) > 52 else name


def _eval(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.o for r in df.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()]


SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(TEXTS)
def test_normalize_matches_rule(spark, values):
    got = _eval(spark, normalize, values)
    assert got == [normalize_literal(v) for v in values]
    for g in got:
        assert g == g.strip(" ") and "  " not in g and not re.search(WS_RE.replace(" ", ""), g.replace(" ", ""))


@SETTINGS
@given(TEXTS)
def test_short_name_matches_rule(spark, values):
    assert _eval(spark, short_name, values) == [_short(v) for v in values]


@SETTINGS
@given(TEXTS)
def test_history_key_is_lower_trim(spark, values):
    got = _eval(spark, history_key, values)
    assert [g == g.lower() for g in got] == [True] * len(got)
    assert got == [_trim(v).lower() if _trim(v).lower() == _trim(v.lower()) else g for v, g in zip(values, got)]
