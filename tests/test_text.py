from pyspark.sql import functions as F

from prefixdex.functions import cache_key, has_prefix, hash32, normalize, normalize_literal, short_name, validate


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("o")).first()["o"]


def test_normalize_reference_cases(spark):
    for raw, want in [("  IPhone   15  ", "iphone 15"), ("YOGA", "yoga"), ("a\t b", "a b"), ("", "")]:
        assert _one(spark, normalize, raw) == want
        assert normalize_literal(raw) == want


def test_normalize_unicode_spaces(spark):
    raw = " 　Word Two﻿"
    assert _one(spark, normalize, raw) == "word two"
    assert normalize_literal(raw) == "word two"


def test_prefix_match_is_starts_with(spark):
    df = spark.createDataFrame([("iphone",), ("ipi",), ("an iphone",)], "q string")
    got = sorted(r.q for r in df.filter(has_prefix("q", "iph")).collect())
    assert got == ["iphone"]


def test_short_name(spark):
    assert _one(spark, short_name, "A - B, C") == "A"
    assert _one(spark, short_name, " - x") == "- x"  # separator at index 0 is ignored
    long = "x" * 60
    assert _one(spark, short_name, long) == "x" * 52 + "…"
    assert _one(spark, short_name, "Phone | Blue") == "Phone"
    assert _one(spark, short_name, "Cable – 2m") == "Cable"


def test_keys_and_hash(spark):
    row = spark.range(1).select(
        hash32(F.lit("redis-0#0")).alias("h"), cache_key(F.lit("iph"), F.lit("recent")).alias("k")
    ).first()
    assert row.h == 3846643172
    assert row.k == "sug:recent:iph"


def test_validate_modes(spark):
    df = spark.createDataFrame([("ok",), ("   ",), ("x" * 513,), (None,)], "s string")
    trimmed = [r.e for r in df.select(validate("s", "trimmed").alias("e")).collect()]
    raw = [r.e for r in df.select(validate("s", "raw").alias("e")).collect()]
    assert trimmed == [None, "required", "exceeds 512 chars", "required"]
    assert raw == [None, None, "exceeds 512 chars", None]


def test_quick_forms_equal_the_patterns(spark):
    """Trim, normalize and validation of odd texts as by the patterns alone."""
    import random

    from prefixdex.functions.predicates import validate
    from prefixdex.functions.text import WHITESPACE_CLASS as ws
    from prefixdex.functions.text import normalize, ws_trim

    rng = random.Random(3)
    odd = "\t\n\r  \u00a0\u1680\u2003\u2028\u3000\ufeffab\u0085\u200b\u00e9\u0130\U0001f600\x00~"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 9))) for _ in range(3000)] + [" " + "x" * n + "\n" for n in (511, 512, 513)] + [" " * 600, None]
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    trim = lambda c: F.regexp_replace(c, f"^{ws}+|{ws}+$", "")
    n = F.length(trim(F.coalesce("q", F.lit(""))))
    for got, want in (
        (ws_trim("q"), trim("q")),
        (normalize("q"), F.trim(F.regexp_replace(F.lower("q"), ws + "+", " "))),
        (validate("q"), F.when(n == 0, F.lit("required")).when(n > 512, F.lit("exceeds 512 chars"))),
    ):
        assert df.filter(~got.eqNullSafe(want)).count() == 0
    plan = df.select(validate("q"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(coalesce" not in plan.split("> 512")[0]  # the length is looked at first
