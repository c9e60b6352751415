import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 2 and set(df.columns) >= {"column", "mean", "median", "total_outliers"}


def test_registry_keys_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_dispatch_unknown_tool(spark):
    import pytest
    from tabsight.plans.dispatch import ToolNotFound, analyze
    with pytest.raises(ToolNotFound):
        analyze(spark.range(3), "no_such_tool")
