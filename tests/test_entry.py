import pytest

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["url", "relevance"] and df.count() >= 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["click_counts", "history_top20", "term_not", "phrase_gap", "alias_resolve"])
def test_core_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for f in os.listdir(d):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{d}/{f}'")
    sql = con.sql(entry.oracle_sql()[name])
    cols = sorted(sql.columns)
    expected = sorted(repr([dict(zip(sql.columns, r))[c] for c in cols]) for r in sql.fetchall())
    df = entry.queries()[name](spark, d)
    assert sorted(df.columns) == cols
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == expected
