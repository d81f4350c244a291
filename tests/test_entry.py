"""Driver contract: entry runs, every oracle has a query, names are unique."""
import __spark_entry__ as entry


def test_oracles_have_queries():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 40


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) >= 0
    assert "severity" in df.columns
