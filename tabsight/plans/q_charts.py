"""Chart-data plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts, profile
from .data import EVENTS_NULLS_SQL, table
from .registry import query


def _hist_sql(src: str, col: str, bins: str | None = None, stats_extra: bool = True) -> str:
    """Equal-width histogram; ``bins`` None means the automatic rule."""
    if bins is None:
        binexpr = """greatest(1, CAST(ceil((hi - lo) / CASE WHEN 2.0 * iqr * pow(n, -1.0 / 3.0) > 0
            THEN least(2.0 * iqr * pow(n, -1.0 / 3.0), (hi - lo) / (log2(n) + 1.0))
            ELSE (hi - lo) / (log2(n) + 1.0) END) AS BIGINT))"""
        binexpr = f"CASE WHEN n <= 0 OR hi <= lo THEN 1 ELSE {binexpr} END"
    else:
        binexpr = bins
    extra_sel = ", round(mean, 6) AS mean, round(median, 6) AS median" if stats_extra else ""
    return f"""
WITH s AS (SELECT count({col}) AS n, min({col}) AS lo, max({col}) AS hi, avg({col}) AS mean,
             quantile_cont({col}, 0.5) AS median,
             quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25) AS iqr FROM {src}),
p AS (SELECT *, CAST({binexpr} AS BIGINT) AS bins FROM s),
q AS (SELECT *, (hi - lo) / bins AS width FROM p),
b AS (SELECT CASE WHEN width > 0 THEN least(CAST(floor((t.{col} - lo) / width) AS BIGINT), bins - 1)
            ELSE 0 END AS bin FROM {src} t, q WHERE t.{col} IS NOT NULL),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin),
g AS (SELECT unnest(range(0, (SELECT greatest(bins, 1) FROM q))) AS bin)
SELECT g.bin, round(lo + g.bin * width, 6) AS lower, round(lo + (g.bin + 1) * width, 6) AS upper,
  coalesce(cnt, 0) AS count{extra_sel}
FROM g CROSS JOIN q LEFT JOIN c ON c.bin = g.bin"""


@query("histogram", _hist_sql("events", "value", "30"))
def q_histogram(spark, sf):
    """30 equal bins of events.value with mean and median."""
    return charts.histogram(table(spark, sf, "events"), "value", 30)


@query("histogram_auto", _hist_sql("documents", "n_chars", None, stats_extra=False))
def q_histogram_auto(spark, sf):
    """C2 bins by min(Freedman-Diaconis, Sturges) on documents.n_chars."""
    return charts.histogram_auto(table(spark, sf, "documents"), "n_chars")


def _kde_sql(src: str, col: str, grid: int = 200, cut: float = 3.0, fine: int = 1024, digits: int = 9) -> str:
    return f"""
WITH s AS (SELECT count({col}) AS n, min({col}) AS lo, max({col}) AS hi, stddev_samp({col}) AS sd
           FROM {src}),
p AS (SELECT *, sd * pow(n, -0.2) AS h, (hi - lo) / {fine} AS fw FROM s),
b AS (SELECT CASE WHEN fw > 0 THEN least(CAST(floor((t.{col} - lo) / fw) AS BIGINT), {fine - 1})
             ELSE 0 END AS b FROM {src} t, p WHERE t.{col} IS NOT NULL),
c AS (SELECT b, count(*) AS c FROM b GROUP BY b),
x AS (SELECT lo + (c.b + 0.5) * fw AS xc, c.c FROM c, p),
g AS (SELECT unnest(range(0, {grid})) AS g)
SELECT g.g AS point, round(lo - {cut} * h + g.g * ((hi - lo + 2 * {cut} * h) / {grid - 1}), 6) AS x,
  round(sum(x.c * exp(-0.5 * ((lo - {cut} * h + g.g * ((hi - lo + 2 * {cut} * h) / {grid - 1})
      - x.xc) / h) ^ 2) / (n * h * sqrt(2 * pi()))), {digits}) AS density
FROM g, x, p WHERE h > 0 GROUP BY g.g, lo, hi, h, n"""


@query("kde", _kde_sql("events", "value"), digits={"*": 6, "density": 9})
def q_kde(spark, sf):
    """C2 density: binned Gaussian KDE (Scott) on 200 points."""
    return charts.kde(table(spark, sf, "events"), "value")


def _box_sql(src: str, cols: list[str], by: str | None = None) -> str:
    keys = f"{by}, " if by else ""
    long = " UNION ALL ".join(
        f"SELECT {keys}'{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM {src}"
        + (f" WHERE {by} IS NOT NULL" if False else "") for c in cols)
    gb = f"{by}, " if by else ""
    join = (f"l.\"column\" = b.\"column\" AND l.{by} = b.{by}" if by else "l.\"column\" = b.\"column\"")
    return f"""
WITH l AS (SELECT * FROM ({long}) WHERE v IS NOT NULL),
b AS (SELECT {gb}"column", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
        quantile_cont(v, 0.75) AS q3 FROM l GROUP BY {gb}"column"),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b)
SELECT {', '.join(f'f.{k}' for k in ([by] if by else []))}{', ' if by else ''}f."column",
  count(*) AS count, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(iqr, 6) AS iqr, round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound,
  round(min(CASE WHEN v >= lo AND v <= hi THEN v END), 6) AS whisker_low,
  round(max(CASE WHEN v >= lo AND v <= hi THEN v END), 6) AS whisker_high,
  CAST(count_if(NOT (v >= lo AND v <= hi)) AS BIGINT) AS fliers
FROM f JOIN l b2 ON TRUE JOIN (SELECT 1) z ON TRUE
""".replace("FROM f JOIN l b2 ON TRUE JOIN (SELECT 1) z ON TRUE",
            f"FROM f JOIN l ON {join.replace('b.', 'f.')} GROUP BY ALL")


@query("boxplot", _box_sql("events", ["value", "user_id"]))
def q_boxplot(spark, sf):
    """C3 box statistics for two columns."""
    return charts.boxplot(table(spark, sf, "events"), "value, user_id")


@query("boxplot_by_group", _box_sql("lineitem", ["l_extendedprice", "l_quantity"], "l_returnflag"))
def q_boxplot_by_group(spark, sf):
    """C4 box statistics of numeric columns by a categorical target."""
    li = table(spark, sf, "lineitem")
    return charts.boxplot(li, ["l_extendedprice", "l_quantity"], by=["l_returnflag"])


@query("count_plot", """
SELECT event_type AS value, count(*) AS count FROM events WHERE event_type IS NOT NULL
GROUP BY event_type""")
def q_count_plot(spark, sf):
    """C5 counts per value."""
    return charts.count_plot(table(spark, sf, "events"), "event_type")


@query("top_n", """
SELECT rank, value, count FROM (SELECT value, count, row_number() OVER (ORDER BY count DESC,
  value) AS rank FROM (SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS count FROM events
  GROUP BY 1)) WHERE rank <= 10""")
def q_top_n(spark, sf):
    """C6 top-10 user ids (many ties)."""
    return charts.top_n(table(spark, sf, "events"), "user_id", 10)


@query("trend_line", """
SELECT CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n,
  round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
  round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")
def q_trend_line(spark, sf):
    """C7 least-squares line of extendedprice on quantity."""
    return charts.trend_line(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


def _grid_sql(src: str, x: str, y: str, bins: int, color: str | None = None) -> str:
    col = f", round(avg({color}), 6) AS mean_color" if color else ""
    return f"""
WITH s AS (SELECT min({x}) AS xlo, max({x}) AS xhi, min({y}) AS ylo, max({y}) AS yhi FROM {src}
           WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
t AS (SELECT t.*, CASE WHEN (xhi - xlo) / {bins} > 0 THEN least(CAST(floor((t.{x} - xlo) /
        ((xhi - xlo) / {bins})) AS BIGINT), {bins - 1}) ELSE 0 END AS x_bin,
      CASE WHEN (yhi - ylo) / {bins} > 0 THEN least(CAST(floor((t.{y} - ylo) /
        ((yhi - ylo) / {bins})) AS BIGINT), {bins - 1}) ELSE 0 END AS y_bin
      FROM {src} t, s WHERE t.{x} IS NOT NULL AND t.{y} IS NOT NULL)
SELECT x_bin, y_bin, count(*) AS count{col} FROM t GROUP BY x_bin, y_bin"""


@query("scatter_grid", _grid_sql("lineitem", "l_quantity", "l_extendedprice", 50, "l_discount"))
def q_scatter_grid(spark, sf):
    """C7 points as 50x50 bin counts, coloured by mean discount."""
    return charts.scatter_grid(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice",
                               50, color_by="l_discount")


_PG = ["o_totalprice", "o_custkey", "o_orderkey"]


def _pair_sql(src: str, cols: list[str], bins: int = 20) -> str:
    """Grids of all pairs, and the occupied bins of each column on the diagonal."""
    return " UNION ALL ".join(
        [f"SELECT '{a}' AS x_col, '{b}' AS y_col, x_bin, y_bin, count FROM ({_grid_sql(src, a, b, bins)})"
         for i, a in enumerate(cols) for b in cols[i + 1:]]
        + [f"SELECT '{a}' AS x_col, '{a}' AS y_col, bin AS x_bin, CAST(NULL AS BIGINT) AS y_bin, count "
           f"FROM ({_hist_sql(src, a, str(bins), stats_extra=False)}) WHERE count > 0" for a in cols])


@query("pair_grid", _pair_sql("orders", _PG))
def q_pair_grid(spark, sf):
    """C8 every numeric pair of orders as 20x20 bin counts and the diagonals, one job."""
    return charts.pair_grid(table(spark, sf, "orders"), _PG, 20)


@query("line_series", """
WITH s AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders),
t AS (SELECT CASE WHEN (hi - lo) / 100 > 0 THEN least(CAST(floor((o_orderkey - lo) /
        ((hi - lo) / 100)) AS BIGINT), 99) ELSE 0 END AS bucket, o_orderkey, o_totalprice
      FROM orders, s)
SELECT bucket, round(avg(o_orderkey), 6) AS x, round(avg(o_totalprice), 6) AS y, count(*) AS count
FROM t GROUP BY bucket""")
def q_line_series(spark, sf):
    """C9 y over x, bucketed into 100 x ranges (bounded series)."""
    return charts.line_series(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", 100)


@query("line_series_points", """
SELECT event_id AS x, value AS y FROM events""")
def q_line_series_points(spark, sf):
    """C9 full series ordered by x."""
    return charts.line_series(table(spark, sf, "events"), "event_id", "value")


_BOX_STATS = ["whisker_low", "q1", "median", "q3", "whisker_high", "fliers"]


def _violin_sql(src: str, col: str) -> str:
    box = _box_sql(src, [col])
    return " UNION ALL ".join(
        [f"""SELECT 'box' AS part, CAST({i} AS BIGINT) AS position, '{n}' AS label, CAST(NULL AS DOUBLE) AS x,
          CAST({n} AS DOUBLE) AS value FROM ({box})""" for i, n in enumerate(_BOX_STATS)]
        + [f"""SELECT 'outline', point, NULL, x, density FROM ({_kde_sql(src, col, digits=6)})"""])


@query("violin", _violin_sql("events", "value"))
def q_violin(spark, sf):
    """C10 box statistics and density outline in one result."""
    return charts.violin(table(spark, sf, "events"), "value")


_SUP_NUM = ["s_suppkey", "s_nationkey", "s_acctbal"]


def _auto_sql() -> str:
    from .q_stats import _pearson_sql
    null = "CAST(NULL AS DOUBLE)"
    parts = []
    for c in _SUP_NUM:
        parts.append(f"""SELECT 'hist_{c}' AS chart, '{c}' AS "column", bin AS position,
          CAST(NULL AS VARCHAR) AS label, lower, upper, CAST(count AS DOUBLE) AS value
          FROM ({_hist_sql('supplier', c, None, stats_extra=False)})""")
        parts.append(f"""SELECT 'kde_{c}', '{c}', point, NULL, x, x, density
          FROM ({_kde_sql('supplier', c, digits=6)})""")
    box = _box_sql("supplier", _SUP_NUM)
    for i, s in enumerate(_BOX_STATS):
        parts.append(f"""SELECT 'box_' || "column", "column", CAST({i} AS BIGINT), '{s}', {null}, {null},
          CAST({s} AS DOUBLE) FROM ({box})""")
    group = _box_sql("supplier", _SUP_NUM, "s_name")
    for i, s in enumerate(_BOX_STATS):
        parts.append(f"""SELECT 'boxby_' || "column", "column", CAST({i} AS BIGINT), s_name || ': {s}', {null}, {null},
          CAST({s} AS DOUBLE) FROM ({group})""")
    parts.append(f"""SELECT 'pair', x_col, x_bin, y_col, CAST(y_bin AS DOUBLE), {null}, CAST(count AS DOUBLE)
      FROM ({_pair_sql('supplier', _SUP_NUM)})""")
    pearson = _pearson_sql("supplier", _SUP_NUM)
    parts.append(f"""SELECT 'heatmap', column1, CAST(j AS BIGINT), column2, {null}, {null}, correlation
      FROM (SELECT * FROM ({pearson}) UNION ALL
            SELECT column2, column1, j, i, n, correlation FROM ({pearson}) WHERE i <> j)""")
    parts.append(f"""SELECT 'count_s_name', 's_name', CAST(NULL AS BIGINT), s_name, {null}, {null},
      CAST(count(*) AS DOUBLE) FROM supplier WHERE s_name IS NOT NULL GROUP BY s_name""")
    return " UNION ALL ".join(parts)


@query("auto_charts", _auto_sql())
def q_auto_charts(spark, sf):
    """C13 all automatic charts of supplier in one long table, boxes by name included."""
    return charts.auto_charts(table(spark, sf, "supplier"), target="s_name")


_EVN_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query("missing_bars", " UNION ALL ".join(
    f"""SELECT '{c}' AS label, CAST(count_if({c} IS NULL) AS BIGINT) AS count FROM {EVENTS_NULLS_SQL}
    HAVING count_if({c} IS NULL) > 0""" for c in _EVN_COLS))
def q_missing_bars(spark, sf):
    """One bar for each column with missing values."""
    from .data import events_with_nulls
    return profile.missing_columns(events_with_nulls(spark, sf)).select(
        F.col("column").alias("label"), F.col("missing_count").alias("count"))


@query("numeric_card", """
SELECT 'o_totalprice' AS "column", round(avg(o_totalprice), 6) AS mean,
  round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(stddev_samp(o_totalprice), 6) AS std,
  round(skewness(o_totalprice), 6) AS skewness, round(min(o_totalprice), 6) AS min,
  round(max(o_totalprice), 6) AS max FROM orders""")
def q_numeric_card(spark, sf):
    """Statistics card of one column."""
    return charts.numeric_card(table(spark, sf, "orders"), "o_totalprice")
