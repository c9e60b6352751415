import pytest

from tabsight.plans.dispatch import TOOLS, analyze


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, float(i % 13) * 1.5, float((i * 7) % 11), ["a", "b", "c"][i % 3], i % 2 == 0)
            for i in range(120)]
    return spark.createDataFrame(rows, "k long, x double, y double, g string, f boolean")


CALLS = {
    "plot_histogram": dict(column="x", bins=10),
    "plot_scatter": dict(x="x", y="y", color_by="k"),
    "plot_heatmap": dict(method="spearman"),
    "plot_boxplot": dict(columns="x, y, nope"),
    "plot_line": dict(x="k", y="x"),
    "plot_bar": dict(column="g", top_n=2),
    "summarize_column": dict(column="g"),
    "correlation": dict(col1="x", col2="y", method="kendall"),
    "detect_outliers": dict(column="x"),
    "query_data": dict(query="x > 3 and g = 'a'", order_by="k"),
    "get_data_info": dict(),
    "compare_groups": dict(group_column="g", value_column="x"),
    "missing_value_analysis": dict(),
    "distribution_test": dict(column="x", order_by="k"),
}


def test_every_tool_runs(data):
    assert set(CALLS) == set(TOOLS)
    for name, args in CALLS.items():
        out = analyze(data, name, **args).collect()
        assert out is not None, name


def test_tool_answers(data):
    bar = analyze(data, "plot_bar", column="g", top_n=2).collect()
    assert len(bar) == 2 and all(r["count"] == 40 for r in bar)
    q = analyze(data, "query_data", query="x > 3 and g = 'a'", order_by="k").collect()
    assert q and q[0]["total"] == 120 and len(q) <= 10
    cg = analyze(data, "compare_groups", group_column="g", value_column="x").collect()
    assert len(cg) == 3 and "f_statistic" in cg[0].asDict()
