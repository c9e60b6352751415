"""Profiling, data-quality, filter and outlier plans (A*, P*, T3-T5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expressions, filters, outliers, profile
from .data import EVENTS_NULLS_SQL, events_with_nulls, table
from .registry import query


def _long_sql(src: str, cols: list[str], by: list[str] = ()) -> str:
    keys = "".join(f"{b}, " for b in by)
    return " UNION ALL ".join(
        f"SELECT {keys}'{c}' AS \"column\", {i} AS ordinal, CAST({c} AS DOUBLE) AS v FROM {src}"
        for i, c in enumerate(cols))


# ---------------------------------------------------------------- A4 (minimum slice)

@query("profile_numeric", f"""
WITH l AS ({_long_sql('events', ['event_id', 'user_id', 'value'], ['event_type'])})
SELECT event_type, "column", ordinal, count(*) AS rows, count(v) AS count,
  count(*) - count(v) AS missing,
  round((count(*) - count(v)) * 100.0 / count(*), 6) AS missing_percentage,
  round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median,
  round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
  CAST(count_if(v = 0) AS BIGINT) AS zeros,
  round(count_if(v = 0) * 100.0 / count(*), 6) AS zeros_percentage
FROM l GROUP BY event_type, "column", ordinal""")
def q_profile_numeric(spark, sf):
    """A4 on every numeric column of events by event_type."""
    return profile.numeric_profile(table(spark, sf, "events"), ["event_id", "user_id", "value"],
                                   by=["event_type"])


def _outlier_sql(src: str, cols: list[str], denominator: str = "rows") -> str:
    return f"""
WITH l AS ({_long_sql(src, cols)}),
b AS (SELECT "column", ordinal, count(*) AS rows, count(v) AS valid,
        quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY ALL),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b),
c AS (SELECT f."column", CAST(count_if(l.v < f.lo OR l.v > f.hi) AS BIGINT) AS total_outliers
      FROM f JOIN l ON l."column" = f."column" GROUP BY f."column")
SELECT f."column", ordinal, rows, valid, round(q1, 6) AS q1, round(q3, 6) AS q3,
  round(iqr, 6) AS iqr, round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound,
  total_outliers, round(total_outliers * 100.0 / {denominator}, 6) AS percentage
FROM f JOIN c ON f."column" = c."column" """


@query("outliers_all", _outlier_sql("events", ["event_id", "user_id", "value"]))
def q_outliers_all(spark, sf):
    """IQR outliers of every numeric events column, % of all rows."""
    return outliers.outlier_report(table(spark, sf, "events"))


@query("outliers_subset", _outlier_sql("events", ["value", "user_id"]))
def q_outliers_subset(spark, sf):
    """P4 + T3: a comma list with unknown and text names; those are skipped."""
    return outliers.outlier_report(table(spark, sf, "events"),
                                   "value, no_such_column, event_type, user_id")


@query("outliers_valid", _outlier_sql(EVENTS_NULLS_SQL, ["value"], "valid"))
def q_outliers_valid(spark, sf):
    """T4: agent form, % of the non-null values."""
    return outliers.outlier_report(events_with_nulls(spark, sf), ["value"],
                                   denominator="valid")


@query("outliers_documents", _outlier_sql("documents", ["n_chars"]))
def q_outliers_documents(spark, sf):
    """T3 on documents.n_chars (the other column with IQR outliers)."""
    return outliers.outlier_report(table(spark, sf, "documents"), ["n_chars"])


@query("outlier_summary", f"""
WITH o AS ({_outlier_sql('events', ['event_id', 'user_id', 'value'])})
SELECT count(*) AS total_columns_analyzed,
  CAST(count_if(total_outliers > 0) AS BIGINT) AS columns_with_outliers FROM o""")
def q_outlier_summary(spark, sf):
    """T5."""
    return outliers.outlier_summary(outliers.outlier_report(table(spark, sf, "events")))


_EV_BOUNDS = """(SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75)
  - quantile_cont(value, 0.25)) AS lo, quantile_cont(value, 0.75) + 1.5 *
  (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM events)"""


@query("outlier_rows", f"""
SELECT e.* FROM events e, {_EV_BOUNDS} b WHERE e.value < b.lo OR e.value > b.hi""")
def q_outlier_rows(spark, sf):
    """Rows strictly outside the fences of events.value."""
    return outliers.outlier_rows(table(spark, sf, "events"), "value")


@query("outlier_keys", f"""
SELECT e.event_id FROM events e, {_EV_BOUNDS} b WHERE e.value < b.lo OR e.value > b.hi""")
def q_outlier_keys(spark, sf):
    """T3 index list: all outlier keys."""
    return outliers.outlier_keys(table(spark, sf, "events"), "value", "event_id")


# ---------------------------------------------------------------- A1 / A3 / A2

_EV_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
_EV_TYPES = ["bigint", "timestamp_ntz", "bigint", "string", "double", "string"]


@query("profile_overview", f"""
SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns,
  CAST({' + '.join(f'count_if({c} IS NULL)' for c in _EV_COLS)} AS BIGINT) AS missing_cells,
  round(({' + '.join(f'count_if({c} IS NULL)' for c in _EV_COLS)}) * 100.0 / (count(*) * 6), 6)
    AS missing_percentage,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {EVENTS_NULLS_SQL})) AS duplicate_rows
FROM {EVENTS_NULLS_SQL}""")
def q_profile_overview(spark, sf):
    """A1 on events with NULLs."""
    return profile.overview(events_with_nulls(spark, sf))


_LI_DUP = "(SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber <= 3)"


@query("duplicate_rows", f"""
SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM {_LI_DUP})) AS distinct_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_LI_DUP})) AS duplicate_rows
FROM {_LI_DUP}""")
def q_duplicate_rows(spark, sf):
    """A3 over all columns of lineitem and a second copy of part of its rows."""
    li = table(spark, sf, "lineitem")
    return profile.duplicate_rows(li.unionByName(li.where("l_linenumber <= 3")))


def _profile_columns_sql(src, cols, types):
    parts = [f"""SELECT '{c}' AS "column", {i} AS ordinal, '{t}' AS dtype,
      CAST(count_if({c} IS NULL) AS BIGINT) AS missing,
      round(count_if({c} IS NULL) * 100.0 / count(*), 6) AS missing_percentage,
      count(DISTINCT {c}) AS unique, round(count(DISTINCT {c}) * 100.0 / count(*), 6)
      AS unique_percentage FROM {src}""" for i, (c, t) in enumerate(zip(cols, types))]
    return " UNION ALL ".join(parts)


@query("profile_columns", _profile_columns_sql(EVENTS_NULLS_SQL, _EV_COLS, _EV_TYPES))
def q_profile_columns(spark, sf):
    """A2: per-column missing and distinct counts (events with NULLs)."""
    return profile.column_profile(events_with_nulls(spark, sf))


@query("profile_top_values", """
WITH l AS (SELECT 'lang' AS "column", lang AS value FROM documents
  UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'text', text FROM documents),
c AS (SELECT "column", value, count(*) AS count FROM l WHERE value IS NOT NULL GROUP BY ALL)
SELECT "column", rank, value, count FROM (SELECT *, row_number() OVER (PARTITION BY "column"
  ORDER BY count DESC, value ASC) AS rank FROM c) WHERE rank <= 10""")
def q_profile_top_values(spark, sf):
    """A5: top-10 values of every text column of documents, the text body included."""
    doc = table(spark, sf, "documents")
    return profile.top_values(doc, ["lang", "source", "text"], 10)


@query("profile_top_values_events", """
WITH l AS (SELECT 'event_type' AS "column", event_type AS value FROM events
  UNION ALL SELECT 'props', props FROM events),
c AS (SELECT "column", value, count(*) AS count FROM l WHERE value IS NOT NULL GROUP BY ALL)
SELECT "column", rank, value, count FROM (SELECT *, row_number() OVER (PARTITION BY "column"
  ORDER BY count DESC, value ASC) AS rank FROM c) WHERE rank <= 10""")
def q_profile_top_values_events(spark, sf):
    """A5 with many ties (props has ~100 values): tie-break by value."""
    return profile.top_values(table(spark, sf, "events"), None, 10)


# ---------------------------------------------------------------- A6 / A8 / T1 / T2

@query("describe", f"""
WITH l AS ({_long_sql('events', ['event_id', 'user_id', 'value'])})
SELECT "column", ordinal, CASE WHEN "column" = 'value' THEN 'double' ELSE 'bigint' END AS dtype,
  count(v) AS count, count(*) - count(v) AS missing, round(avg(v), 6) AS mean,
  round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min,
  round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
  round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS max
FROM l GROUP BY "column", ordinal""")
def q_describe(spark, sf):
    """A6 on the numeric events columns (exact percentiles)."""
    return profile.describe(table(spark, sf, "events"))


@query("distribution_numeric", """
SELECT 'n_chars' AS "column", count(n_chars) AS count, round(avg(n_chars), 6) AS mean,
  round(quantile_cont(n_chars, 0.5), 6) AS median,
  CAST((SELECT n_chars FROM documents GROUP BY n_chars ORDER BY count(*) DESC, n_chars
         LIMIT 1) AS DOUBLE) AS mode,
  round(stddev_samp(n_chars), 6) AS std, round(var_samp(n_chars), 4) AS variance,
  CAST(min(n_chars) AS DOUBLE) AS min, CAST(max(n_chars) AS DOUBLE) AS max,
  CAST(max(n_chars) - min(n_chars) AS DOUBLE) AS range,
  round(quantile_cont(n_chars, 0.25), 6) AS q1, round(quantile_cont(n_chars, 0.5), 6) AS q2,
  round(quantile_cont(n_chars, 0.75), 6) AS q3,
  round(quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25), 6) AS iqr,
  round(skewness(n_chars), 6) AS skewness, round(kurtosis(n_chars), 6) AS kurtosis
FROM documents""", digits={"*": 6, "variance": 4})
def q_distribution_numeric(spark, sf):
    """T1 on documents.n_chars."""
    return profile.distribution_numeric(table(spark, sf, "documents"), "n_chars")


@query("distribution_categorical", """
WITH c AS (SELECT lang AS value, count(*) AS cnt FROM documents WHERE lang IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, value) AS rank FROM c),
t AS (SELECT sum(cnt) AS nn, count(*) AS u FROM c)
SELECT 'lang' AS "column", CAST(t.nn AS BIGINT) AS count, t.u AS unique,
  (SELECT value FROM r WHERE rank = 1) AS top_value,
  (SELECT cnt FROM r WHERE rank = 1) AS top_frequency,
  round((SELECT cnt FROM r WHERE rank = 1) * 100.0 / t.nn, 6) AS top_percentage,
  r.rank, r.value, r.cnt AS value_count
FROM r, t WHERE r.rank <= 20""")
def q_distribution_categorical(spark, sf):
    """T2 on documents.lang (% of non-null rows)."""
    return profile.distribution_categorical(table(spark, sf, "documents"), "lang")


@query("summarize_numeric", f"""
SELECT 'value' AS "column", count(*) AS total, count(*) - count(value) AS missing,
  round((count(*) - count(value)) * 100.0 / count(*), 6) AS missing_percentage,
  count(DISTINCT value) AS unique, round(avg(value), 6) AS mean,
  round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS std,
  round(min(value), 6) AS min, round(max(value), 6) AS max,
  round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3,
  round(skewness(value), 6) AS skewness, round(kurtosis(value), 6) AS kurtosis
FROM {EVENTS_NULLS_SQL}""")
def q_summarize_numeric(spark, sf):
    """A8 numeric column summary (events.value with NULLs)."""
    return profile.summarize_numeric(events_with_nulls(spark, sf), "value")


@query("summarize_categorical", f"""
WITH t AS (SELECT count(*) AS total, CAST(count_if(event_type IS NULL) AS BIGINT) AS missing,
             count(DISTINCT event_type) AS u FROM {EVENTS_NULLS_SQL}),
c AS (SELECT event_type AS value, count(*) AS count FROM {EVENTS_NULLS_SQL}
      WHERE event_type IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY count DESC, value) AS rank FROM c)
SELECT 'event_type' AS "column", total, missing, round(missing * 100.0 / total, 6)
  AS missing_percentage, u AS unique, rank, value, count,
  round(count * 100.0 / total, 6) AS percentage
FROM r, t WHERE rank <= 5""")
def q_summarize_categorical(spark, sf):
    """A8 text summary: top 5 with % of ALL rows."""
    return profile.summarize_categorical(events_with_nulls(spark, sf), "event_type")


@query("data_info", f"""
WITH p AS ({_profile_columns_sql(EVENTS_NULLS_SQL, _EV_COLS, _EV_TYPES)}),
t AS (SELECT count(*) AS rows,
  CAST({' + '.join(f'count_if({c} IS NULL)' for c in _EV_COLS)} AS BIGINT) AS total_missing
  FROM {EVENTS_NULLS_SQL})
SELECT "column", ordinal, dtype,
  CASE WHEN dtype IN ('bigint', 'double') THEN 'numeric'
       WHEN dtype = 'string' THEN 'categorical' ELSE 'other' END AS kind,
  missing, "unique", rows, CAST(6 AS BIGINT) AS columns, total_missing,
  rows - (SELECT count(*) FROM (SELECT DISTINCT * FROM {EVENTS_NULLS_SQL})) AS duplicate_rows
FROM p, t""")
def q_data_info(spark, sf):
    """Schema, per-column missing/unique and dataset totals."""
    return profile.data_info(events_with_nulls(spark, sf))


# ---------------------------------------------------------------- A9 / P9 / P7

@query("missing_summary", f"""
SELECT CAST({' + '.join(f'count_if({c} IS NULL)' for c in _EV_COLS)} AS BIGINT)
    AS total_missing_cells, count(*) * 6 AS total_cells,
  round(({' + '.join(f'count_if({c} IS NULL)' for c in _EV_COLS)}) * 100.0 / (count(*) * 6), 6)
    AS overall_missing_percentage,
  CAST(count_if({' AND '.join(f'{c} IS NOT NULL' for c in _EV_COLS)}) AS BIGINT) AS complete_rows,
  round(count_if({' AND '.join(f'{c} IS NOT NULL' for c in _EV_COLS)}) * 100.0 / count(*), 6)
    AS complete_rows_percentage
FROM {EVENTS_NULLS_SQL}""")
def q_missing_summary(spark, sf):
    """A9 totals."""
    return profile.missing_summary(events_with_nulls(spark, sf))


@query("missing_columns", f"""
SELECT * FROM ({' UNION ALL '.join(
    f"SELECT '{c}' AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS missing_count, "
    f"round(count_if({c} IS NULL) * 100.0 / count(*), 6) AS missing_percentage, "
    f"'{t}' AS dtype FROM {EVENTS_NULLS_SQL}" for c, t in zip(_EV_COLS, _EV_TYPES))})
WHERE missing_count > 0""")
def q_missing_columns(spark, sf):
    """P9 / A9 per column (only columns with missing values)."""
    return profile.missing_columns(events_with_nulls(spark, sf))


@query("complete_rows", f"""
SELECT CAST(count_if({' AND '.join(f'{c} IS NOT NULL' for c in _EV_COLS)}) AS BIGINT)
  AS complete_rows, count(*) AS rows FROM {EVENTS_NULLS_SQL}""")
def q_complete_rows(spark, sf):
    """P7 counts."""
    return filters.complete_row_count(events_with_nulls(spark, sf))


# ---------------------------------------------------------------- A10 / A11

@query("class_balance", f"""
SELECT event_type AS value, count(*) AS count,
  round(count(*) * 100.0 / (SELECT count(*) FROM {EVENTS_NULLS_SQL}), 6) AS percentage
FROM {EVENTS_NULLS_SQL} WHERE event_type IS NOT NULL GROUP BY event_type""")
def q_class_balance(spark, sf):
    """A10 value counts with % of all rows."""
    return profile.class_balance(events_with_nulls(spark, sf), "event_type")


@query("compare_groups", """
SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean,
  round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS std,
  round(min(value), 6) AS min, round(max(value), 6) AS max
FROM events WHERE event_type IS NOT NULL GROUP BY event_type""")
def q_compare_groups(spark, sf):
    """A11 on events.value by event_type."""
    return profile.compare_groups(table(spark, sf, "events"), "event_type", "value")


@query("compare_groups_lineitem", """
SELECT l_returnflag, count(l_extendedprice) AS count, round(avg(l_extendedprice), 6) AS mean,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
  round(stddev_samp(l_extendedprice), 6) AS std, round(min(l_extendedprice), 6) AS min,
  round(max(l_extendedprice), 6) AS max
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def q_compare_groups_lineitem(spark, sf):
    """A11 on lineitem.l_extendedprice by l_returnflag."""
    return profile.compare_groups(table(spark, sf, "lineitem"), "l_returnflag",
                                  "l_extendedprice")


# ---------------------------------------------------------------- A12

_TARGETS = [("part", "p_size", "int", "integer"), ("part", "p_retailprice", "double", "float"),
            ("lineitem", "l_discount", "double", "float"),
            ("lineitem", "l_quantity", "double", "float"),
            ("lineitem", "l_returnflag", "string", "text")]


def _detect_sql(tbl, col, dtype, kind):
    n = f"(count(DISTINCT {col}) + CASE WHEN count_if({col} IS NULL) > 0 THEN 1 ELSE 0 END)"
    text = "TRUE" if kind == "text" else "FALSE"
    flt = "TRUE" if kind == "float" else "FALSE"
    return f"""SELECT '{tbl}.{col}' AS target,
  CASE WHEN {text} THEN 'classification' WHEN {n} < 20 THEN 'classification'
       WHEN {n} > 50 THEN 'regression' WHEN {flt} THEN 'regression' ELSE 'classification' END
    AS problem_type,
  CASE WHEN {text} THEN 'text or boolean target: values are classes'
       WHEN {n} < 20 THEN printf('%d distinct values: few enough to be classes', {n})
       WHEN {n} > 50 THEN printf('%d distinct values: too many to be classes', {n})
       WHEN {flt} THEN printf('%d distinct fractional values', {n})
       ELSE printf('%d distinct whole numbers', {n}) END AS reason,
  {n} AS unique_values, '{dtype}' AS target_dtype, ({flt} AND {n} > 50) AS is_continuous
FROM {tbl}"""


@query("detect_problem_type", " UNION ALL ".join(_detect_sql(*t) for t in _TARGETS))
def q_detect_problem_type(spark, sf):
    """A12 on five targets that reach every branch of the rule."""
    out = None
    for tbl, col, _, _ in _TARGETS:
        d = (profile.detect_problem_type(table(spark, sf, tbl), col)
             .select(F.lit(f"{tbl}.{col}").alias("target"), "*"))
        out = d if out is None else out.unionByName(d)
    return out


# ---------------------------------------------------------------- P5

_PRED = "o_totalprice > 100000 and o_orderstatus = 'F'"


@query("filter_rows", f"SELECT * FROM orders WHERE {_PRED}")
def q_filter_rows(spark, sf):
    """P5 predicate filter."""
    return filters.filter_rows(table(spark, sf, "orders"), _PRED)


@query("filter_summary", f"""
SELECT CAST(count_if({_PRED}) AS BIGINT) AS matched, count(*) AS total FROM orders""")
def q_filter_summary(spark, sf):
    """P5 matched / total in one pass."""
    return filters.filter_summary(table(spark, sf, "orders"), _PRED)


@query("filter_preview", f"SELECT * FROM orders WHERE {_PRED} ORDER BY o_orderkey LIMIT 10")
def q_filter_preview(spark, sf):
    """P5 first 10 matches by key."""
    return filters.filter_preview(table(spark, sf, "orders"), _PRED, "o_orderkey")


_EXPRESSION = "100000 < o_totalprice <= 250000 and o_orderstatus in ['F', 'P'] and not (o_orderpriority == '5-LOW' or o_orderdate < '1996-06-01')"
_EXPRESSION_SQL = """o_totalprice > 100000 AND o_totalprice <= 250000 AND o_orderstatus IN ('F', 'P')
  AND o_orderpriority <> '5-LOW' AND o_orderdate >= TIMESTAMP '1996-06-01'"""


@query("filter_expression", f"SELECT * FROM orders WHERE {_EXPRESSION_SQL}")
def q_filter_expression(spark, sf):
    """P5: a query expression with a chained comparison, a list and a negation."""
    return expressions.filter_expression(table(spark, sf, "orders"), _EXPRESSION)


@query("filter_expression_summary", f"""
SELECT CAST(count_if({_EXPRESSION_SQL}) AS BIGINT) AS matched, count(*) AS total FROM orders""")
def q_filter_expression_summary(spark, sf):
    """P5: matched and total of a query expression in one pass."""
    return expressions.expression_summary(table(spark, sf, "orders"), _EXPRESSION)


@query("filter_expression_preview", f"SELECT * FROM orders WHERE {_EXPRESSION_SQL} ORDER BY o_orderkey LIMIT 10")
def q_filter_expression_preview(spark, sf):
    """P5: the first 10 matches of a query expression by key."""
    return expressions.expression_preview(table(spark, sf, "orders"), _EXPRESSION, "o_orderkey")


@query("filter_expression_missing", f"""
SELECT event_id, event_type, value FROM {EVENTS_NULLS_SQL}
WHERE (value IS NULL OR value <= 20 OR value >= 60) AND (event_type IS NULL OR event_type NOT IN ('view', 'click'))
  OR value IS NOT NULL AND (event_type <> 'purchase' OR event_type IS NULL) AND value / 3 > 40 AND event_id % 5 = 1""")
def q_filter_expression_missing(spark, sf):
    """P5: negations and != on columns with missing values, and arithmetic."""
    text = "not 20 < value < 60 and event_type not in ['view', 'click'] or event_type != 'purchase' and value / 3 > 40 and event_id % 5 == 1"
    return expressions.filter_expression(events_with_nulls(spark, sf), text).select("event_id", "event_type", "value")


@query("filter_expression_text", """
SELECT c_custkey, c_name AS "customer name", c_mktsegment, c_acctbal FROM customer
WHERE (lower(c_mktsegment) LIKE 'auto%' OR regexp_matches(c_name, '[13579]$')) AND length(c_name) = 18 AND abs(c_acctbal) > 1000""")
def q_filter_expression_text(spark, sf):
    """P5: text methods, a function and a quoted column name."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("customer name"), "c_mktsegment", "c_acctbal")
    return expressions.filter_expression(c, "(c_mktsegment.str.lower().str.startswith('auto') | `customer name`.str.contains('[13579]$'))"
                                            " & `customer name`.str.len() == 18 & abs(c_acctbal) > 1000")


@query("tool_dispatch", f"""
WITH l AS ({_long_sql('events', ['value'], ['event_type'])})
SELECT event_type, count(v) AS count, round(avg(v), 6) AS mean,
  round(quantile_cont(v, 0.5), 6) AS median, round(stddev_samp(v), 6) AS std,
  round(min(v), 6) AS min, round(max(v), 6) AS max,
  round((SELECT (sum(n * (m - gm) ^ 2) / (count(*) - 1)) / (sum((n - 1) * s2) / (sum(n) - count(*)))
   FROM (SELECT count(*) AS n, avg(value) AS m, var_samp(value) AS s2,
           (SELECT avg(value) FROM events) AS gm FROM events GROUP BY event_type)), 6) AS f_statistic
FROM l GROUP BY event_type""")
def q_tool_dispatch(spark, sf):
    """The compare_groups tool found by name (group stats + ANOVA F)."""
    from .dispatch import analyze
    out = analyze(table(spark, sf, "events"), "compare_groups", group_column="event_type",
                  value_column="value")
    return out.drop("p_value", "significant")
