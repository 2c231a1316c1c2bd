import datetime as dt


from prefixdex.operators import history


def test_history_cap_newest_first_case_insensitive(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(55):
        q = f"Query {i % 52}" if i % 2 else f"query {i % 52}"
        rows.append((i, t0 + dt.timedelta(minutes=i), 9, ("  " + q + " ") if i == 54 else q))
    ev = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, query string")
    h = history.user_history(ev).orderBy("pos").collect()
    assert len(h) == 50
    assert [r.q for r in h[:3]] == ["query 2", "Query 1", "query 0"]  # newest spelling, trimmed
    assert len({r.q.lower() for r in h}) == 50
    assert [r.pos for r in h] == list(range(1, 51))
    assert len(history.recent_view(history.user_history(ev)).collect()) == 6


def test_personalized_merge(spark):
    hist = spark.createDataFrame(
        [(1, 1, "Red Pen"), (1, 2, "red cup"), (1, 3, "blue"), (2, 1, "Red Pen")], "user_id bigint, pos int, q string"
    )
    glob = spark.createDataFrame(
        [("red", i + 1, q, 10 - i, float(10 - i)) for i, q in enumerate(["red pen", "red hat", "red box", "red a", "red b", "red c", "red d", "red e", "red f", "red g"])],
        "prefix string, pos int, query string, count bigint, score double",
    )
    req = spark.createDataFrame([(1, "Red "), (2, "zzz"), (1, "   ")], "user_id bigint, typed string")
    got = history.personalized_merge(req, hist, glob).orderBy("user_id", "typed", "pos").collect()
    u1 = [(r.query, r.personalized, r["count"]) for r in got if r.user_id == 1]
    assert u1[:2] == [("red pen", True, 10), ("red cup", True, None)]
    assert [q for q, p, _ in u1[2:]] == ["red hat", "red box", "red a", "red b", "red c", "red d", "red e", "red f"]
    assert len(u1) == 10
    assert [r for r in got if r.user_id == 2] == []


def test_history_is_narrowed_before_the_global_list_is_joined(spark):
    """A request is not shuffled with its global list and all of the user's entries."""
    req = spark.createDataFrame([(1, "ab"), (2, "x")], "user_id long, typed string")
    own = spark.createDataFrame([(1, 1, "Abba"), (1, 2, "zeta")], "user_id long, pos int, q string")
    glob = spark.createDataFrame([("ab", 1, "abacus", 5, 5.0), ("ab", 2, "abba", 3, 3.0)], "prefix string, pos int, query string, count long, score double")
    out = history.personalized_merge(req, own, glob)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    by_prefix, by_user = plan.index("Join LeftOuter, (prefix"), plan.index("Join LeftOuter, (user_id")
    assert "filter(_h#" in plan[by_prefix:by_user]
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(1, "ab", 1, "abba", 3, 3.0, True), (1, "ab", 2, "abacus", 5, 5.0, False)]


def test_texts_are_lower_cased_once_for_a_user_and_a_prefix(spark):
    """Not in the functions that go over a request's entries and suggestions."""
    req = spark.createDataFrame([(1, "A"), (1, "ab"), (2, "x"), (3, "q")], "user_id long, typed string")
    own = spark.createDataFrame([(1, n, f"ABc{n}") for n in range(1, 13)] + [(3, 1, "Q")], "user_id long, pos int, q string")
    glob = spark.createDataFrame(
        [("ab", 1, "abC3", 5, 5.0), ("ab", 2, "abd", 3, 3.0), ("x", 1, "X1", 2, 2.0), ("q", 1, None, 1, 1.0)],
        "prefix string, pos int, query string, count long, score double",
    )
    out = history.personalized_merge(req, own, glob)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction(lower(" not in plan and "lower(lambda" not in plan
    got = sorted((tuple(r) for r in out.collect()), key=str)
    abc = [(1, "ab", n, "abC3" if n == 3 else f"ABc{n}", 5 if n == 3 else None, 5.0 if n == 3 else None, True) for n in range(1, 11)]
    a = [(1, "A", n, f"ABc{n}", None, None, True) for n in range(1, 11)]
    assert got == sorted([*abc, *a, (2, "x", 1, "X1", 2, 2.0, False), (3, "q", 1, "Q", None, None, True)], key=str)
