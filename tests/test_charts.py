import numpy as np
import pandas as pd
import pytest

from tabsight.operators import charts


@pytest.fixture(scope="module")
def vals(spark):
    rng = np.random.default_rng(5)
    v = rng.gamma(2.0, 3.0, 1000)
    return v, spark.createDataFrame(pd.DataFrame({"v": v, "w": v * 2 + 1, "k": range(1000)}))


def test_histogram_counts_and_edges(vals):
    v, df = vals
    h = charts.histogram(df, "v", 30).orderBy("bin").collect()
    assert len(h) == 30 and sum(r["count"] for r in h) == len(v)
    counts, _ = np.histogram(v, bins=30)
    assert [r["count"] for r in h] == counts.tolist()


def test_constant_column_one_bin(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": [2.0] * 5}))
    h = charts.histogram_auto(df, "v").collect()
    assert len(h) == 1 and h[0]["count"] == 5


def test_auto_bins_rule(vals):
    v, df = vals
    h = charts.histogram_auto(df, "v").collect()
    assert len(h) == len(np.histogram_bin_edges(v, bins="auto")) - 1


def test_boxplot_whiskers(vals):
    v, df = vals
    b = charts.boxplot(df, ["v"]).first()
    q1, q3 = np.quantile(v, [0.25, 0.75])
    hi = q3 + 1.5 * (q3 - q1)
    assert b["whisker_high"] == pytest.approx(v[v <= hi].max())
    assert b["fliers"] == int(((v < q1 - 1.5 * (q3 - q1)) | (v > hi)).sum())


def test_trend_line_exact(vals):
    _, df = vals
    t = charts.trend_line(df, "v", "w").first()
    assert t["slope"] == pytest.approx(2.0) and t["intercept"] == pytest.approx(1.0)


def test_kde_integrates_to_one(vals):
    _, df = vals
    k = charts.kde(df, "v").orderBy("point").collect()
    xs = np.array([r["x"] for r in k])
    ys = np.array([r["density"] for r in k])
    assert np.trapezoid(ys, xs) == pytest.approx(1.0, abs=0.02)


def test_scatter_grid_totals(vals):
    _, df = vals
    g = charts.scatter_grid(df, "v", "w", 10).collect()
    assert sum(r["count"] for r in g) == 1000
