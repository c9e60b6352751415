"""Named analysis tools, found by name, with typed arguments.

``analyze(df, tool, **args)`` runs one of the 14 tools of the reference's
chat agent on a DataFrame and returns a DataFrame; an unknown name raises
``ToolNotFound`` carrying the reference's message."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_numeric
from ..operators import charts, correlation, expressions, filters, hypothesis, outliers, profile


class ToolNotFound(KeyError):
    pass


def _scatter(df, x, y, color_by=None):
    grid = charts.scatter_grid(df, x, y, color_by=color_by if color_by in df.columns else None)
    return profile.with_scalars(grid, charts.trend_line(df, x, y))


def _summarize(df, column):
    if is_numeric(df.schema[column].dataType):
        return profile.summarize_numeric(df, column)
    return profile.summarize_categorical(df, column)


def _query(df, query, order_by=None, n=10):
    """Takes a query expression; text that its grammar doesn't allow (a single ``=``, say)
    is a Spark SQL predicate."""
    try:
        predicate = expressions.expression(df, query)
    except expressions.NotAnExpression:
        predicate = query
    summ = filters.filter_summary(df, predicate)
    rows = filters.filter_rows(df, predicate)
    rows = rows.orderBy(*([order_by] if order_by else df.columns)).limit(n)
    return profile.with_scalars(rows, summ)


def _compare(df, group_column, value_column):
    groups = profile.compare_groups(df, group_column, value_column)
    n_groups = df.where(F.col(group_column).isNotNull()).select(group_column).distinct().count()
    if n_groups > 2:
        an = hypothesis.anova_oneway(df, group_column, value_column).select(
            "f_statistic", "p_value", "significant")
        return profile.with_scalars(groups, an)
    return groups


def _correlation(df, col1, col2, method="pearson"):
    """Unlike the endpoint, the tool does not take an unknown method for Pearson."""
    if method not in correlation.METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(correlation.METHODS)}")
    return correlation.pair_correlation(df, col1, col2, method)


def _missing(df):
    return profile.with_scalars(profile.missing_columns(df), profile.missing_summary(df))


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "plot_histogram": lambda df, column, bins=30: charts.histogram(df, column, int(bins)),
    "plot_scatter": _scatter,
    "plot_heatmap": lambda df, method="pearson": correlation.correlation_matrix(df, None, method),
    "plot_boxplot": lambda df, columns: charts.boxplot(df, columns),
    "plot_line": lambda df, x, y: charts.line_series(df, x, y),
    "plot_bar": lambda df, column, top_n=10: charts.top_n(df, column, int(top_n)),
    "summarize_column": _summarize,
    "correlation": _correlation,
    "detect_outliers": outliers.outlier_tool,
    "query_data": _query,
    "get_data_info": profile.data_info,
    "compare_groups": _compare,
    "missing_value_analysis": _missing,
    "distribution_test": lambda df, column, order_by=None:
        hypothesis.shapiro(df, [column]),
}


def analyze(df: DataFrame, tool: str, **args) -> DataFrame:
    fn = TOOLS.get(tool)
    if fn is None:
        raise ToolNotFound(f"Tool '{tool}' not found.")
    return fn(df, **args)
