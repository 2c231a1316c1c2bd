import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["prefix", "rank", "pos", "query", "count", "score"]
    assert df.limit(5).count() == 5


def test_every_query_has_an_oracle():
    from prefixdex.plans import registry

    assert set(registry.QUERIES) <= set(E.queries())
    assert set(registry.QUERIES) <= set(E.oracle_sql())
