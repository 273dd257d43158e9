import __spark_entry__ as entry


def test_every_sql_has_its_query_and_the_flagship_runs(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
    assert entry.entry(spark).columns == ["id", "filename", "folder", "score"]
