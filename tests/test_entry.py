import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


def test_flagship(spark):
    got = {r.Source: r for r in entry.entry(spark).collect()}
    assert got["Total"].Distinct_Records == 189 and len(got) == 21
