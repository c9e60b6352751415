import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.functions.special import betainc, f_sf
from tabsight.operators import correlation, hypothesis
from tabsight.operators.kendall import weighted_s


def _brute_tau_b(x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    s = (np.sign(x[:, None] - x[None, :]) * np.sign(y[:, None] - y[None, :])).sum() / 2
    n0 = n * (n - 1) / 2
    n1 = sum(c * (c - 1) / 2 for c in pd.Series(x).value_counts())
    n2 = sum(c * (c - 1) / 2 for c in pd.Series(y).value_counts())
    return s / math.sqrt((n0 - n1) * (n0 - n2))


def test_weighted_s_matches_brute_force():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 6, 300).astype(float)
    b = rng.integers(0, 4, 300).astype(float)
    w = np.ones(300)
    brute = sum(np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i, j in combinations(range(300), 2))
    assert weighted_s(a, b, w) == pytest.approx(brute)


@pytest.fixture(scope="module")
def numeric(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=400)
    pdf = pd.DataFrame({"x": x, "y": 2 * x + rng.normal(size=400), "t": rng.integers(0, 5, 400) * 1.0,
                        "c": np.full(400, 3.0)})
    pdf.loc[::9, "y"] = np.nan
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_matrix_matches_pandas_pairwise(numeric, method):
    pdf, df = numeric
    cols = ["x", "y", "t"]
    got = {(r["column1"], r["column2"]): r["correlation"]
           for r in correlation.correlation_long(df, cols, method).collect()}
    for a, b in combinations(cols, 2):
        both = pdf[[a, b]].dropna()
        if method == "kendall":
            ref = _brute_tau_b(both[a].to_numpy(), both[b].to_numpy())
        else:
            ref = pdf[[a, b]].corr(method=method).loc[a, b]
        assert got[(a, b)] == pytest.approx(ref, abs=1e-9)


def test_constant_column_gives_null_not_error(numeric):
    _, df = numeric
    rows = correlation.correlation_long(df, ["x", "c"], "pearson").collect()
    off = [r for r in rows if r["i"] != r["j"]][0]
    assert off["correlation"] is None
    diag = {r["column1"]: r["correlation"] for r in rows if r["i"] == r["j"]}
    assert diag["x"] == 1.0 and diag["c"] is None


def test_kendall_grid_path_with_ties(spark):
    rng = np.random.default_rng(11)
    n = 1200
    x = rng.integers(0, 40, n).astype(float)
    x[:400] = 7.0                                    # a hot value: a third of the rows
    y = (x + rng.integers(0, 30, n)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    from tabsight.operators.kendall import kendall_pair
    got = kendall_pair(df, "x", "y", target_group=100, buckets=4).first()["tau"]
    assert got == pytest.approx(_brute_tau_b(x, y), abs=1e-12)


def test_symmetric_matrix_with_unit_diagonal(numeric):
    _, df = numeric
    m = {(r["column1"], r["column2"]): r["correlation"]
         for r in correlation.correlation_matrix(df, ["x", "y", "t"]).collect()}
    for (a, b), v in m.items():
        assert v == pytest.approx(m[(b, a)])
        if a == b:
            assert v == pytest.approx(1.0)


def test_strong_pairs_and_wording(numeric):
    _, df = numeric
    sp = correlation.strong_pairs(correlation.correlation_long(df, ["x", "y", "t"])).collect()
    assert [(r["feature1"], r["feature2"], r["strength"]) for r in sp] == [("x", "y", "strong")]
    pc = correlation.pair_correlation(df, "x", "t", "no-such-method").first()
    assert pc["method"] == "pearson" and pc["strength"] in ("very weak", "weak")


def test_f_distribution_tail_closed_form():
    for f, d2 in [(0.5, 7), (3.2, 40), (10.0, 3)]:
        assert f_sf(f, 2, d2) == pytest.approx((1 + 2 * f / d2) ** (-d2 / 2), rel=1e-10)
    assert betainc(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-4)


def test_anova_matches_definition(spark):
    groups = {"a": [1.0, 2.0, 3.0], "b": [2.0, 4.0, 6.0, 8.0], "c": [10.0, 11.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    r = hypothesis.anova_oneway(df, "g", "v").first()
    allv = [v for vs in groups.values() for v in vs]
    gm = np.mean(allv)
    ssb = sum(len(vs) * (np.mean(vs) - gm) ** 2 for vs in groups.values())
    ssw = sum(((np.array(vs) - np.mean(vs)) ** 2).sum() for vs in groups.values())
    f = (ssb / 2) / (ssw / (len(allv) - 3))
    assert r["f_statistic"] == pytest.approx(f)
    assert r["p_value"] == pytest.approx(f_sf(f, 2, len(allv) - 3))


def test_shapiro_properties(spark):
    from statistics import NormalDist
    nd = NormalDist()
    normal_like = [nd.inv_cdf((i + 0.5) / 200) for i in range(200)]
    skewed = [math.exp(v) for v in normal_like]
    w1, p1 = hypothesis.shapiro_wilk(np.array(normal_like))
    w2, p2 = hypothesis.shapiro_wilk(np.array(skewed))
    assert w1 > 0.99 and p1 > 0.5
    assert w2 < w1 and p2 < 1e-6
    w3, p3 = hypothesis.shapiro_wilk(np.array([1.0, 2.0, 4.0]))
    assert p3 == pytest.approx(6 / math.pi * (math.asin(math.sqrt(w3)) - math.asin(math.sqrt(0.75))))
    assert hypothesis.shapiro_wilk(np.array([1.0, 1.0])) == (None, None)


def test_shapiro_job_equals_the_in_memory_form(spark):
    rng = np.random.default_rng(4)
    groups = {"tiny": [1.0, 2.0, 4.0], "four": [1.0, 2.0, 4.0, 8.0], "ten": rng.normal(size=10), "same": [2.0] * 5,
              "one": [1.0], "many": rng.normal(size=9000), "ties": rng.integers(0, 7, 3000).astype(float)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("ten", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {r["g"]: r for r in hypothesis.shapiro(df, ["v"], by=["g"]).collect()}
    assert set(out) == set(groups)
    for g, vs in groups.items():
        w, p = hypothesis.shapiro_wilk(np.array(vs))
        assert out[g]["sample_size"] == len(vs) and out[g]["p_extrapolated"] == (len(vs) > 5000)
        if w is None:
            assert out[g]["statistic"] is None and out[g]["p_value"] is None
        else:
            assert abs(out[g]["statistic"] - w) < 1e-9 and abs(out[g]["p_value"] - p) < 1e-6


def test_shapiro_plan_has_no_single_task_over_rows(spark):
    """Only sums that are already one row a task go to a single one."""
    df = spark.range(1000).select((F.col("id") * 1.5).alias("v"))
    lines = hypothesis.shapiro(df, ["v"])._jdf.queryExecution().executedPlan().toString().split("\n")
    below = [lines[k + 1] for k, x in enumerate(lines) if "SinglePartition" in x]
    assert all("partial_" in x for x in below) and not any("row_number" in x for x in lines)


@pytest.mark.parametrize("holes", [False, True])
def test_spearman_brings_rows_together_once(spark, monkeypatch, holes):
    """Ranks of columns with many values come from buckets: no join of the rows a column."""
    from pyspark.sql import DataFrame

    from tabsight.operators import rank_products
    rng = np.random.default_rng(3)
    n = 2000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 9, n).astype(float), "d": np.ones(n),
                        "c": np.where(rng.random(n) < 0.4, 0.25, rng.normal(size=n)).round(2)})  # a hot value, ties
    pdf["e"] = pdf.a * 3 + rng.normal(size=n)
    pdf.loc[:2, "a"], pdf.loc[5, "e"], pdf.loc[6:9, "c"] = [-np.inf, -0.0, 0.0], np.inf, [-0.0, 0.0, -0.0, 0.0]
    monkeypatch.setattr(rank_products, "RUN", 60)
    monkeypatch.setattr(rank_products, "BLOCK", 128)
    monkeypatch.setattr(rank_products, "VALUES", 1500)
    df = spark.createDataFrame(pdf).repartition(3)
    if holes:
        pdf.loc[::7, "a"], pdf.loc[rng.random(n) < 0.6, "c"], pdf["f"] = np.nan, np.nan, np.nan
        df = spark.createDataFrame(pdf).repartition(3)
    spark.conf.set("tabsight.broadcastBytes", "320")
    try:
        with monkeypatch.context() as m:
            m.setattr(DataFrame, "join", lambda *a, **k: pytest.fail("rows are joined"))
            got = correlation.correlation_long(df, list(pdf.columns), "spearman").collect()
    finally:
        spark.conf.unset("tabsight.broadcastBytes")
    assert len(got) == (21 if holes else 15)
    for r in got:
        both = pdf[[r["column1"], r["column2"]]].dropna()
        assert r["n"] == len(both)
        if {"d", "f"} & {r["column1"], r["column2"]}:
            assert r["correlation"] is None
        else:
            assert r["correlation"] == pytest.approx(both.rank().corr().iloc[0, 1], abs=1e-12)
