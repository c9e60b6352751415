import numpy as np
import pandas as pd
import pytest

from tabsight.operators.quantiles import quantiles


def _frame(spark, values, group=None):
    pdf = pd.DataFrame({"x": values})
    if group is not None:
        pdf["g"] = group
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("gather,probs", [(200_000, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]),
                                          (50, [0.1, 0.5, 0.9]), (7, [0.0, 0.33, 1.0])])
def test_exact_against_numpy(spark, gather, probs):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.integers(0, 5, 500)])
    df = _frame(spark, vals.astype(float))
    got = {r["p"]: r["value"] for r in quantiles(df, ["x"], probs, gather_limit=gather).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(vals, p), abs=1e-12)


def test_grouped_nulls_and_edge_cases(spark):
    pdf = pd.DataFrame({"g": ["a"] * 5 + ["b"] * 3 + ["c"] * 2 + ["d"],
                        "x": [1.0, 2.0, 3.0, 4.0, 100.0, 7.0, 7.0, 7.0, None, None, 5.0]})
    df = spark.createDataFrame(pdf)
    out = {(r["g"], r["p"]): r["value"]
           for r in quantiles(df, ["x"], [0.25, 0.5], by=["g"]).collect()}
    assert out[("a", 0.5)] == 3.0 and out[("a", 0.25)] == 2.0
    assert out[("b", 0.5)] == 7.0                     # constant group
    assert ("c", 0.5) not in out                      # all-null group: no value
    assert out[("d", 0.25)] == 5.0                    # single row


def test_nan_is_missing(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [1.0, float("nan"), 3.0]}))
    r = quantiles(df, ["x"], [0.5]).collect()[0]
    assert r["value"] == 2.0


def test_partition_count_invariance(spark):
    rng = np.random.default_rng(3)
    vals = rng.exponential(size=2000)
    df = _frame(spark, vals)
    a = quantiles(df.repartition(1), ["x"], [0.37]).collect()[0]["value"]
    b = quantiles(df.repartition(7), ["x"], [0.37]).collect()[0]["value"]
    assert a == b == pytest.approx(np.quantile(vals, 0.37))


def test_approximate_mode_within_rank_error(spark):
    rng = np.random.default_rng(4)
    vals = rng.normal(size=5000)
    df = _frame(spark, vals)
    r = quantiles(df, ["x"], [0.5], exact=False, accuracy=1000).collect()[0]["value"]
    rank = (vals < r).sum()
    assert abs(rank - 2500) <= 5000 / 1000 + 1


def test_discrete_columns_need_no_refinement(spark, monkeypatch):
    """A hot value cannot shrink: few distinct values must end the passes at once."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame
    calls = []
    real = Frame.checkpoint
    monkeypatch.setattr(Frame, "checkpoint", lambda self, eager=True: calls.append(1) or real(self, eager))
    df = spark.range(20000).selectExpr("cast(id % 5 as double) as x")
    got = {r["p"]: r["value"] for r in quantiles(df, ["x"], [0.1, 0.5, 0.99], gather_limit=64).collect()}
    assert got == {0.1: 0.0, 0.5: 2.0, 0.99: 4.0} and len(calls) == 1


def test_hot_value_between_continuous_ones(spark):
    rng = np.random.default_rng(5)
    vals = np.concatenate([np.zeros(30000), rng.normal(size=4000), rng.normal(size=2000) * 1e-6])
    df = _frame(spark, vals)
    probs = [0.01, 0.04, 0.08, 0.5, 0.93, 0.999]
    got = {r["p"]: r["value"] for r in quantiles(df, ["x"], probs, gather_limit=64, accuracy=1000).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(vals, p), abs=1e-12)
