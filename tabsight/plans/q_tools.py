"""Every named tool as a query. Where a tool gives what an operator's query
gives, that query's SQL is the oracle."""

from __future__ import annotations

from .data import events_with_nulls, lineitem_numeric, table
from .dispatch import analyze
from .q_profile import _EXPRESSION, _PRED
from .registry import ORACLE, query


def _tool(name: str, source, sql: str | None, **args) -> None:
    def run(spark, sf):
        return analyze(source(spark, sf), name, **args)
    run.__doc__ = f"U1: the {name} tool found by name."
    query(f"tool_{name}", sql)(run)


def _of(name: str):
    return lambda spark, sf: table(spark, sf, name)


_SCATTER = f"""SELECT g.*, n, slope, intercept, r2 FROM ({ORACLE['scatter_grid']}) g, ({ORACLE['trend_line']}) t"""
_QUERY = f"""SELECT o.*, s.matched, s.total FROM ({ORACLE['filter_preview']}) o, ({ORACLE['filter_summary']}) s"""
_MISSING = f"""SELECT m.*, s.* FROM ({ORACLE['missing_columns']}) m, ({ORACLE['missing_summary']}) s"""
_OUTLIERS = f"""SELECT o.*, (SELECT list(value ORDER BY event_id) FROM (SELECT e.event_id, e.value FROM events e,
  (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {{src}}) b
  WHERE e.event_id % 7 <> 0 AND (e.value < q1 - 1.5 * (q3 - q1) OR e.value > q3 + 1.5 * (q3 - q1))
  ORDER BY e.event_id LIMIT 10)) AS outlier_values
FROM ({ORACLE['outliers_valid']}) o"""

_tool("plot_histogram", _of("events"), ORACLE["histogram"], column="value", bins=30)
_tool("plot_scatter", _of("lineitem"), _SCATTER, x="l_quantity", y="l_extendedprice", color_by="l_discount")
_tool("plot_heatmap", lineitem_numeric, ORACLE["corr_heatmap"])
_tool("plot_boxplot", _of("events"), ORACLE["boxplot"], columns="value, user_id")
_tool("plot_line", _of("events"), ORACLE["line_series_points"], x="event_id", y="value")
_tool("plot_bar", _of("events"), ORACLE["top_n"], column="user_id", top_n=10)
_tool("summarize_column", events_with_nulls, ORACLE["summarize_categorical"], column="event_type")
_tool("correlation", lineitem_numeric, ORACLE["pair_correlation"], col1="l_extendedprice", col2="l_net", method="spearman")
_tool("detect_outliers", events_with_nulls,
      _OUTLIERS.format(src="(SELECT * FROM events WHERE event_id % 7 <> 0)"), column="value", key="event_id")
_tool("query_data", _of("orders"), _QUERY, query=_PRED, order_by="o_orderkey")
query("tool_query_data_expression", f"""SELECT o.*, s.matched, s.total FROM ({ORACLE['filter_expression_preview']}) o,
  ({ORACLE['filter_expression_summary']}) s""")(lambda spark, sf: analyze(table(spark, sf, "orders"), "query_data", query=_EXPRESSION, order_by="o_orderkey"))
_tool("get_data_info", events_with_nulls, ORACLE["data_info"])
_tool("missing_value_analysis", events_with_nulls, _MISSING)
_tool("distribution_test", _of("documents"), None, column="n_chars")
