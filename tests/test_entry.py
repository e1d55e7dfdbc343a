import __spark_entry__ as entry


def test_entry_has_queries_and_sql_for_them():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["lang", "type", "n"]
