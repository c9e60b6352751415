"""Statistics plans: correlations (T6-T11, C11), ANOVA (T12), Shapiro-Wilk
(T13), quick insights (T14)."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from ..operators import correlation, hypothesis, outliers
from .data import EVENTS_NULLS_SQL, LINEITEM_NUMERIC_SQL, events_with_nulls, lineitem_numeric, table
from .registry import query

_LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_net", "l_unitprice"]
_CUST = ["c_acctbal", "c_nationkey", "c_custkey"]
_CUST_SQL = "(SELECT CAST(c_acctbal AS DOUBLE) AS c_acctbal, CAST(c_nationkey AS DOUBLE) AS " \
            "c_nationkey, CAST(c_custkey AS DOUBLE) AS c_custkey FROM customer)"


def _corr_case(expr: str) -> str:
    return f"round(CASE WHEN isnan({expr}) THEN NULL ELSE {expr} END, 6)"


def _pearson_sql(src: str, cols: list[str]) -> str:
    parts = []
    for i, j in combinations_with_replacement(range(len(cols)), 2):
        a, b = cols[i], cols[j]
        parts.append(f"""SELECT '{a}' AS column1, '{b}' AS column2, {i} AS i, {j} AS j,
          CAST(count_if({a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT) AS n,
          {_corr_case(f'corr({a}, {b})')} AS correlation FROM {src}""")
    return " UNION ALL ".join(parts)


def _ranked_sql(src: str, cols: list[str]) -> str:
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"
        for c in cols)
    return f"(SELECT {ranks} FROM {src})"


def _kendall_sql(src: str, cols: list[str]) -> str:
    parts = []
    for i, j in combinations_with_replacement(range(len(cols)), 2):
        a, b = cols[i], cols[j]
        if i == j:
            parts.append(f"""SELECT '{a}' AS column1, '{a}' AS column2, {i} AS i, {i} AS j,
              count({a}) AS n, CASE WHEN count(DISTINCT {a}) > 1 THEN 1.0 END AS correlation
              FROM {src}""")
            continue
        parts.append(f"""SELECT '{a}' AS column1, '{b}' AS column2, {i} AS i, {j} AS j, n,
          round(s / sqrt((n * (n - 1) / 2.0 - n1) * (n * (n - 1) / 2.0 - n2)), 6) AS correlation
          FROM (SELECT sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b})) / 2.0 AS s FROM {src} p, {src} q) s,
               (SELECT count(*) AS n FROM {src}) c,
               (SELECT sum(t * (t - 1) / 2.0) AS n1 FROM (SELECT count(*) AS t FROM {src} GROUP BY {a})) x,
               (SELECT sum(t * (t - 1) / 2.0) AS n2 FROM (SELECT count(*) AS t FROM {src} GROUP BY {b})) y""")
    return " UNION ALL ".join(parts)


@query("corr_pearson", _pearson_sql(LINEITEM_NUMERIC_SQL, _LI))
def q_corr_pearson(spark, sf):
    """T6 upper triangle (with diagonal) on lineitem numerics + derived columns."""
    return correlation.correlation_long(lineitem_numeric(spark, sf), _LI, "pearson")


@query("corr_spearman", _pearson_sql(_ranked_sql(LINEITEM_NUMERIC_SQL, _LI), _LI))
def q_corr_spearman(spark, sf):
    """Pearson of average ranks (distributed ranking)."""
    return correlation.correlation_long(lineitem_numeric(spark, sf), _LI, "spearman")


#: lineitem columns with NULLs in different rows
_HOLES = ["l_quantity", "l_discount", "l_extendedprice", "l_tax"]
_HOLES_SQL = """(SELECT CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_partkey % 5 < 2 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice, l_tax FROM lineitem)"""


def _spearman_pairs_sql(source: str, columns: list[str]) -> str:
    """Each pair ranked on its own complete rows."""
    parts = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns[i:], i):
            r = [f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0 AS {n}" for v, n in (("x", "rx"), ("y", "ry"))]
            parts.append(f"""SELECT '{a}' AS column1, '{b}' AS column2, {i} AS i, {j} AS j, count(*) AS n,
              {'1.0' if i == j else 'round(corr(rx, ry), 6)'} AS correlation FROM (SELECT {', '.join(r)}
              FROM (SELECT {a} AS x, {b} AS y FROM {source}) WHERE x IS NOT NULL AND y IS NOT NULL)""")
    return " UNION ALL ".join(parts)


@query("corr_spearman_nulls", _spearman_pairs_sql(_HOLES_SQL, _HOLES))
def q_corr_spearman_nulls(spark, sf):
    """Spearman of columns with NULLs in different rows, all pairs in one job."""
    li = table(spark, sf, "lineitem")
    hole = lambda c, when: F.when(~when, F.col(c)).alias(c)
    df = li.select(hole("l_quantity", F.col("l_orderkey") % 7 == 0), hole("l_discount", F.col("l_partkey") % 5 < 2),
                   hole("l_extendedprice", F.col("l_suppkey") % 3 == 0), "l_tax")
    return correlation.correlation_long(df, _HOLES, "spearman")


@query("corr_kendall", _kendall_sql(_CUST_SQL, _CUST))
def q_corr_kendall(spark, sf):
    """T8 tau-b on customer (acctbal, nationkey, custkey)."""
    return correlation.correlation_long(table(spark, sf, "customer"), _CUST, "kendall")


_POINTS = """(SELECT l_quantity AS x, l_discount AS y, CAST(count(*) AS DOUBLE) AS w FROM lineitem
  WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL GROUP BY 1, 2)"""


def _kendall_points_sql() -> str:
    """tau-b from weighted points: few enough for a self-join at any scale."""
    off = f"""SELECT 'l_quantity' AS column1, 'l_discount' AS column2, 0 AS i, 1 AS j, CAST(n AS BIGINT) AS n,
      round(s / sqrt((n * (n - 1) / 2 - n1) * (n * (n - 1) / 2 - n2)), 6) AS correlation
      FROM (SELECT sum(p.w * q.w * sign(p.x - q.x) * sign(p.y - q.y)) / 2 AS s FROM {_POINTS} p, {_POINTS} q),
           (SELECT sum(w) AS n FROM {_POINTS}),
           (SELECT sum(t * (t - 1) / 2) AS n1 FROM (SELECT sum(w) AS t FROM {_POINTS} GROUP BY x)),
           (SELECT sum(t * (t - 1) / 2) AS n2 FROM (SELECT sum(w) AS t FROM {_POINTS} GROUP BY y))"""
    own = [f"""SELECT '{c}', '{c}', {k}, {k}, count({c}), CASE WHEN count(DISTINCT {c}) > 1 THEN 1.0 END
      FROM lineitem""" for k, c in enumerate(("l_quantity", "l_discount"))]
    return " UNION ALL ".join([off, *own])


@query("corr_kendall_lineitem", _kendall_points_sql())
def q_corr_kendall_lineitem(spark, sf):
    """T8 on lineitem (quantity vs discount: heavy ties)."""
    return correlation.correlation_long(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "kendall")


@query("corr_kendall_decomposed")
def q_corr_kendall_decomposed(spark, sf):
    """T8 on lineitem, a continuous column included: the recursive path. The
    self-join oracle is quadratic here; the tests hold it against brute force."""
    li = table(spark, sf, "lineitem")
    return correlation.correlation_long(li, ["l_quantity", "l_discount", "l_extendedprice"], "kendall")


@query("corr_heatmap", f"""
WITH u AS ({_pearson_sql(LINEITEM_NUMERIC_SQL, _LI)})
SELECT * FROM u UNION ALL
SELECT column2 AS column1, column1 AS column2, j AS i, i AS j, n, correlation FROM u WHERE i <> j""")
def q_corr_heatmap(spark, sf):
    """C11: full mirrored matrix in long form."""
    return correlation.correlation_matrix(lineitem_numeric(spark, sf), _LI, "pearson")


@query("strong_pairs", f"""
SELECT column1 AS feature1, column2 AS feature2, correlation,
  CASE WHEN abs(correlation) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength,
  abs(correlation) AS abs_correlation
FROM ({_pearson_sql(LINEITEM_NUMERIC_SQL, _LI)}) WHERE i < j AND abs(correlation) > 0.5""")
def q_strong_pairs(spark, sf):
    """|r| > 0.5 pairs, strong above 0.7."""
    return correlation.strong_pairs(
        correlation.correlation_long(lineitem_numeric(spark, sf), _LI, "pearson"))


@query("strong_pairs_summary", f"""
WITH u AS ({_pearson_sql(LINEITEM_NUMERIC_SQL, _LI)})
SELECT (SELECT count(DISTINCT column1) FROM u) AS total_features,
  CAST(count_if(abs(correlation) > 0.7) AS BIGINT) AS strong_correlations_count,
  CAST(count_if(abs(correlation) <= 0.7) AS BIGINT) AS moderate_correlations_count
FROM u WHERE i < j AND abs(correlation) > 0.5""")
def q_strong_pairs_summary(spark, sf):
    """T10 counts."""
    return correlation.strong_pairs_summary(
        correlation.correlation_long(lineitem_numeric(spark, sf), _LI, "pearson"))


@query("pair_correlation", f"""
SELECT 'l_extendedprice' AS col1, 'l_net' AS col2, 'spearman' AS method, correlation,
  CASE WHEN abs(correlation) > 0.7 THEN 'strong' WHEN abs(correlation) > 0.4 THEN 'moderate'
       WHEN abs(correlation) > 0.2 THEN 'weak' ELSE 'very weak' END AS strength,
  CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM ({_pearson_sql(_ranked_sql(LINEITEM_NUMERIC_SQL, ['l_extendedprice', 'l_net']),
                    ['l_extendedprice', 'l_net'])}) WHERE i = 0 AND j = 1""")
def q_pair_correlation(spark, sf):
    """One pair with wording."""
    return correlation.pair_correlation(lineitem_numeric(spark, sf), "l_extendedprice", "l_net",
                                        "spearman")


@query("pair_correlation_weak", f"""
SELECT 'l_quantity' AS col1, 'l_tax' AS col2, 'pearson' AS method, correlation,
  CASE WHEN abs(correlation) > 0.7 THEN 'strong' WHEN abs(correlation) > 0.4 THEN 'moderate'
       WHEN abs(correlation) > 0.2 THEN 'weak' ELSE 'very weak' END AS strength,
  CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM ({_pearson_sql(LINEITEM_NUMERIC_SQL, ['l_quantity', 'l_tax'])}) WHERE i = 0 AND j = 1""")
def q_pair_correlation_weak(spark, sf):
    """T11 with an unknown method name (falls back to pearson)."""
    return correlation.pair_correlation(lineitem_numeric(spark, sf), "l_quantity", "l_tax",
                                        "not-a-method")


_ANOVA_SQL = """
WITH g AS (SELECT {g} AS grp, count(*) AS n, avg({v}) AS m, var_samp({v}) AS s2 FROM {t}
           WHERE {g} IS NOT NULL AND {v} IS NOT NULL GROUP BY 1),
t AS (SELECT sum(n) AS N, count(*) AS k, sum(n * m) / sum(n) AS gm FROM g),
p AS (SELECT sum(g.n * (g.m - t.gm) ^ 2) AS ssb, sum(coalesce((g.n - 1) * g.s2, 0)) AS ssw
      FROM g, t)
SELECT k AS groups, CAST(N AS BIGINT) AS n, k - 1 AS df_between, CAST(N - k AS BIGINT) AS df_within, round(ssb, {d}) AS ssb,
  round(ssw, {d}) AS ssw, round((ssb / (k - 1)) / (ssw / (N - k)), 6) AS f_statistic
FROM t, p"""


@query("anova_f", _ANOVA_SQL.format(g="event_type", v="value", t="events", d=4),
       digits={"*": 6, "ssb": 4, "ssw": 4})
def q_anova_f(spark, sf):
    """T12 F statistic on events.value by event_type (p-value: unit tests)."""
    return hypothesis.anova_oneway(table(spark, sf, "events"), "event_type", "value") \
        .drop("p_value", "significant")


@query("anova_lineitem", _ANOVA_SQL.format(g="l_returnflag", v="l_extendedprice", t="lineitem",
                                           d=0), digits={"*": 6, "ssb": 0, "ssw": 0})
def q_anova_lineitem(spark, sf):
    """T12 on lineitem.l_extendedprice by l_returnflag (3 groups)."""
    return hypothesis.anova_oneway(table(spark, sf, "lineitem"), "l_returnflag",
                                   "l_extendedprice").drop("p_value", "significant")


# upper tail of F(4, d2): x^a (1 + a (1 - x)) with a = d2 / 2, x = d2 / (d2 + 4 F)
_ANOVA_P_SQL = f"""
WITH f AS ({_ANOVA_SQL.format(g="event_type", v="value", t="events", d=4).replace("AS f_statistic", "AS f_rounded, (ssb / (k - 1)) / (ssw / (N - k)) AS f")}),
t AS (SELECT *, pow(df_within / (df_within + 4 * f), df_within / 2.0)
        * (1 + df_within / 2.0 * (1 - df_within / (df_within + 4 * f))) AS p FROM f)
SELECT groups, n, df_between, df_within, ssb, ssw, f_rounded AS f_statistic, round(p, 6) AS p_value, p < 0.05 AS significant FROM t"""


@query("anova_test", _ANOVA_P_SQL, digits={"*": 6, "ssb": 4, "ssw": 4})
def q_anova_test(spark, sf):
    """T12 with p-value and significance, five groups: closed form of F(4, d2)."""
    return hypothesis.anova_oneway(table(spark, sf, "events"), "event_type", "value")


_SHAPIRO_SQL = """
SELECT {g} CAST(count({v}) AS BIGINT) AS sample_size, count({v}) > 5000 AS p_extrapolated
FROM {t} WHERE {v} IS NOT NULL {w}"""


@query("shapiro_sizes", _SHAPIRO_SQL.format(
    g="event_type, 'value' AS \"column\",", v="value", t=EVENTS_NULLS_SQL,
    w="AND event_type IS NOT NULL GROUP BY event_type"))
def q_shapiro_sizes(spark, sf):
    """Every non-null value of every group counts."""
    return q_shapiro(spark, sf).select("event_type", "column", "sample_size", "p_extrapolated")


@query("shapiro")
def q_shapiro(spark, sf):
    """Shapiro-Wilk over all non-null values per event type; W has no SQL form
    (the tests hold it against the in-memory function)."""
    ev = events_with_nulls(spark, sf).where(F.col("event_type").isNotNull())
    return hypothesis.shapiro(ev, ["value"], by=["event_type"])


@query("shapiro_documents")
def q_shapiro_documents(spark, sf):
    """T13 on documents.n_chars (strongly non-normal)."""
    return hypothesis.shapiro(table(spark, sf, "documents"), ["n_chars"])


@query("quick_insights", f"""
SELECT column1 AS feature1, column2 AS feature2, correlation
FROM ({_pearson_sql(LINEITEM_NUMERIC_SQL, _LI)}) WHERE i < j AND abs(correlation) > 0.7
ORDER BY i, j LIMIT 3""")
def q_quick_insights(spark, sf):
    """T14 first 3 highly correlated pairs in column order."""
    return correlation.quick_insight_pairs(
        correlation.correlation_long(lineitem_numeric(spark, sf), _LI, "pearson"))


@query("quick_insights_outliers", """
WITH l AS (SELECT 'event_id' AS "column", 0 AS ordinal, CAST(event_id AS DOUBLE) AS v FROM events
  UNION ALL SELECT 'user_id', 1, CAST(user_id AS DOUBLE) FROM events
  UNION ALL SELECT 'value', 2, value FROM events),
b AS (SELECT "column", ordinal, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
      FROM l GROUP BY ALL)
SELECT b."column", CAST(count_if(l.v < q1 - 1.5 * (q3 - q1) OR l.v > q3 + 1.5 * (q3 - q1))
  AS BIGINT) AS total_outliers
FROM b JOIN l ON l."column" = b."column" GROUP BY b."column", b.ordinal
HAVING count_if(l.v < q1 - 1.5 * (q3 - q1) OR l.v > q3 + 1.5 * (q3 - q1)) > 0""")
def q_quick_insights_outliers(spark, sf):
    """T14 outlier counts of the first 3 numeric columns, only if > 0."""
    ev = table(spark, sf, "events")
    from ..functions.columns import numeric_columns
    first3 = numeric_columns(ev)[:3]
    rep = outliers.outlier_report(ev, first3)
    return rep.where(F.col("total_outliers") > 0).select("column", "total_outliers")
