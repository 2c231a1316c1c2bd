import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from prefixdex.plans.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=4, app="prefixdex-tests")
    yield s


def seed_freq(spark, rows):
    """Frequency table from ``(q, count[, score])`` like the reference's test
    helper: query = normalize(q), display = q, score defaults to count."""
    from prefixdex.functions.text import normalize_literal

    data = [(normalize_literal(r[0]), r[0], int(r[1]), float(r[2] if len(r) > 2 else r[1])) for r in rows]
    return spark.createDataFrame(data, "query string, display string, count bigint, score double")
