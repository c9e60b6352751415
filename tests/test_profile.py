import math

import pandas as pd
import pytest

from tabsight.operators import filters, outliers, profile


@pytest.fixture(scope="module")
def people(spark):
    rows = [("Ann", 34, "Oslo", 52000), ("Bob", 45, "Rome", 61000), ("Cid", None, "Oslo", 48000),
            ("Dee", 29, None, 75000), ("Eve", 45, "Rome", 61000), ("Bob", 45, "Rome", 61000)]
    return spark.createDataFrame(rows, "name string, age long, city string, salary long")


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(1, 1.0, 5.0, None), (2, 2.0, 5.0, None), (3, float("nan"), 5.0, None),
            (4, 4.0, 5.0, None)]
    return spark.createDataFrame(rows, "id long, x double, c double, n double")


def test_overview_and_duplicates(people):
    ov = profile.overview(people).first()
    assert ov["rows"] == 6 and ov["columns"] == 4
    assert ov["missing_cells"] == 2
    assert ov["missing_percentage"] == pytest.approx(2 * 100 / 24)
    assert ov["duplicate_rows"] == 1


def test_column_profile_counts_distinct_without_nulls(people):
    prof = {r["column"]: r for r in profile.column_profile(people).collect()}
    assert prof["city"]["unique"] == 2 and prof["city"]["missing"] == 1
    assert prof["age"]["unique"] == 3
    assert prof["name"]["unique_percentage"] == pytest.approx(5 * 100 / 6)


def test_numeric_profile_nan_constant_and_all_null(edge):
    prof = {r["column"]: r for r in profile.numeric_profile(edge, ["x", "c", "n"]).collect()}
    assert prof["x"]["count"] == 3 and prof["x"]["missing"] == 1       # NaN is missing
    assert prof["x"]["median"] == 2.0
    assert prof["c"]["std"] == 0.0
    assert prof["n"]["mean"] is None and prof["n"]["median"] is None    # all-null -> NULL


def test_mode_ties_take_smallest(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": [3.0, 1.0, 3.0, 1.0, 2.0]}))
    assert profile.mode(df, ["v"]).first()["mode"] == 1.0


def test_top_values_ties_by_value_and_bool_is_categorical(spark):
    df = spark.createDataFrame([(1, "b", True), (2, "a", False), (3, "b", None), (4, "a", True)],
                               "id long, c string, f boolean")
    top = profile.top_values(df, None, 1).collect()
    got = {r["column"]: (r["value"], r["count"]) for r in top}
    assert got["c"] == ("a", 2)
    assert got["f"] == ("true", 2)


def test_distribution_numeric_sample_moments(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 9.0]
    df = spark.createDataFrame(pd.DataFrame({"v": vals}))
    r = profile.distribution_numeric(df, "v").first()
    s = pd.Series(vals)
    assert r["skewness"] == pytest.approx(s.skew())
    assert r["kurtosis"] == pytest.approx(s.kurt())
    assert r["mode"] == 2.0 and r["variance"] == pytest.approx(s.var())


def test_problem_type_rules(spark):
    ints20 = spark.createDataFrame([(i % 20,) for i in range(200)], "y long")
    d = profile.detect_problem_type(ints20, "y").first()
    assert d["problem_type"] == "classification" and d["unique_values"] == 20
    with pytest.raises(profile.ProblemTypeError):
        profile.check_problem_type(ints20, "y", "regression")
    floats = spark.createDataFrame([(i * 0.37,) for i in range(100)], "y double")
    assert profile.check_problem_type(floats, "y") == "regression"
    with pytest.raises(profile.ProblemTypeError):
        profile.check_problem_type(floats, "y", "classification")
    text = spark.createDataFrame([("a",), ("b",), (None,)], "y string")
    d = profile.detect_problem_type(text, "y").first()
    assert d["problem_type"] == "classification" and d["unique_values"] == 3  # NULL counts once


def test_outliers_strict_and_denominators(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0, None]
    df = spark.createDataFrame(pd.DataFrame({"k": range(6), "v": vals}))
    all_ = outliers.outlier_report(df, ["v"]).first()
    valid = outliers.outlier_report(df, ["v"], denominator="valid").first()
    assert all_["total_outliers"] == 1
    assert all_["percentage"] == pytest.approx(100 / 6)
    assert valid["percentage"] == pytest.approx(100 / 5)
    assert [r["k"] for r in outliers.outlier_keys(df, "v", "k").collect()] == [4]


def test_filters(people):
    s = filters.filter_summary(people, "age > 30 and city = 'Rome'").first()
    assert (s["matched"], s["total"]) == (3, 6)
    assert filters.complete_row_count(people).first()["complete_rows"] == 4
    assert filters.column_subset(people, "age, nope, city, salary") == ["age", "salary"]


def test_missing_summary(people):
    m = profile.missing_summary(people).first()
    assert m["total_missing_cells"] == 2 and m["total_cells"] == 24
    assert m["complete_rows_percentage"] == pytest.approx(400 / 6)
    cols = [r["column"] for r in profile.missing_columns(people).collect()]
    assert sorted(cols) == ["age", "city"]


def test_percentages_bounded(people):
    for r in profile.column_profile(people).collect():
        assert 0 <= r["missing_percentage"] <= 100 and 0 <= r["unique_percentage"] <= 100
    assert not math.isnan(profile.overview(people).first()["missing_percentage"])


def test_approximate_distinct_counts(people):
    exact = {r["column"]: r["unique"] for r in profile.distinct_counts(people).collect()}
    approx = {r["column"]: r["unique"] for r in profile.distinct_counts(people, approx=True).collect()}
    assert exact == approx                       # tiny cardinalities are exact in HLL++
