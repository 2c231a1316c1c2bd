from prefixdex.operators import frequency
from prefixdex.sources import catalog, store

CSV = '''asin,title,imgUrl,productURL,stars,reviews,price,listPrice,category_id,isBestSeller,boughtInLastMonth
A1,"Plate ""XL"" Red",,,4,12,,,,,
A2,"Two
Lines",,,4, 12 ,,,,,
A3,Short Row,,,4
A4,Long Row,,,4,5,,,,,,extra,fields
A5,,,,4,9,,,,,
A6,Zero,,,4,0,,,,,
A7,Neg,,,4,-3,,,,,
A8,NotANumber,,,4,NaN,,,,,
A9,Inf,,,4,Infinity,,,,,
A10,Hex,,,4,0x10,,,,,
A11,Suffix,,,4,1d,,,,,
A12,Exp,,,4,1e3,,,,,
A13,Comma,,,4,"1,000",,,,,
A14,Frac,,,4,2.5,,,,,
'''


def test_csv_and_qualify(spark, tmp_path):
    p = tmp_path / "catalog.csv"
    p.write_text(CSV)
    raw = catalog.read_catalog(spark, str(p))
    assert raw.count() == 14
    good, bad = catalog.qualify(raw)
    kept = {r.asin: r.reviews_num for r in good.collect()}
    assert kept == {"A1": 12.0, "A2": 12.0, "A4": 5.0, "A12": 1000.0}
    titles = {r.asin: r.title for r in good.collect()}
    assert titles["A1"] == 'Plate "XL" Red' and titles["A2"] == "Two\nLines"
    reasons = {r.asin: r.reject_reason for r in bad.collect()}
    assert reasons["A5"] == "blank title" and reasons["A14"] == "reviews not integral"
    assert all(reasons[a] for a in ("A3", "A6", "A7", "A8", "A9", "A10", "A11", "A13"))


def test_sample_every(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 11)], "ordinal long")
    assert [r.ordinal for r in catalog.sample_every(df, 3, ["ordinal"]).orderBy("ordinal").collect()] == [3, 6, 9]
    assert catalog.sample_every(df, 1, ["ordinal"]).count() == 10


def test_first_display_wins(spark):
    cat = spark.createDataFrame([("Red Plate", "5", 1), ("red  plate", "7", 2)], "title string, reviews string, ordinal long")
    r = frequency.frequency_from_catalog(cat).collect()
    assert [(x.query, x.display, x["count"], x.score) for x in r] == [("red plate", "Red Plate", 12, 12.0)]


def test_load_profile(spark):
    cat = spark.createDataFrame([("a", "5", 1), ("A", "7", 2), ("b", "0", 3)], "title string, reviews string, ordinal long")
    good, _ = catalog.qualify(cat)
    p = frequency.load_profile(cat, good, frequency.frequency_from_catalog(cat)).first()
    assert (p.rows_read, p.qualifying, p.kept, p.unique_queries, p.min_count, p.max_count, p.below_minimum) == (3, 2, 2, 1, 12, 12, True)


def test_versioned_store(spark, tmp_path):
    root = str(tmp_path / "freq")
    df = spark.createDataFrame([("b", 1), ("a", 2)], "query string, n int")
    store.write_version(df, root, 0)
    store.write_version(df.limit(1), root, 3)
    assert store.committed_versions(spark, root) == [0, 3]
    assert store.read_version(spark, root).count() == 1
    assert store.read_version(spark, root, 0).count() == 2
    assert store.dataset_size(df).first().dataset_size == 2


def test_ingest_job_samples_in_file_order(spark, tmp_path):
    from prefixdex.plans.ingest import ingest_catalog

    header = "asin,title,imgUrl,productURL,stars,reviews,price,listPrice,category_id,isBestSeller,boughtInLastMonth\n"
    rows = [f"A{i},Item {i % 4},,,4,{i},,,,,\n" for i in range(1, 11)] + ["B1,,,,4,5,,,,,\n"]
    p = tmp_path / "c.csv"
    p.write_text(header + "".join(rows))
    freq, profile = ingest_catalog(spark, str(p), str(tmp_path / "freq"), sample_every=3)
    got = {r.query: r["count"] for r in freq.collect()}
    assert got == {"item 3": 3, "item 2": 6, "item 1": 9}  # rows 3, 6, 9 of the qualifying ones
    pr = profile.first()
    assert (pr.rows_read, pr.qualifying, pr.kept, pr.unique_queries) == (11, 10, 3, 3)


def test_sample_interval_must_be_positive_integer(spark):
    import pytest

    df = spark.createDataFrame([(1,)], "ordinal long")
    for bad in (0, -1, 2.5, True):
        with pytest.raises(ValueError):
            catalog.sample_every(df, bad, ["ordinal"])
