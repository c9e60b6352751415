"""IQR outliers: bounds from exact quartiles, counts in one pass.

Bounds are one row per (group, column) -- a table whose size is fixed by the
number of columns (and groups), never by the data -- so it is broadcast to
the scan. Strict comparisons: an outlier is ``< Q1 - 1.5 IQR`` or
``> Q3 + 1.5 IQR``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_double, numeric_columns, subset
from ..session import broadcast_row_limit, checkpoint_dir
from .profile import _pct, with_scalars
from .quantiles import iqr_bounds, long_values


def _outside(v, lo, hi):
    return (v < lo) | (v > hi)


def outlier_report(df: DataFrame, columns: str | Sequence[str] | None = None,
                   by: Sequence[str] = (), denominator: str = "all",
                   factor: float = 1.5) -> DataFrame:
    """Per (group, column): q1, q3, iqr, bounds, total_outliers, percentage.

    ``denominator='all'`` divides by all rows (profiling endpoint), ``'valid'``
    by the non-null rows of the column (agent tool)."""
    if denominator not in ("all", "valid"):
        raise ValueError("denominator must be 'all' or 'valid'")
    by = list(by)
    cols = subset(columns, numeric_columns(df, tuple(by)))
    # bounds: one row per (group, column); materialised once because both the
    # counting pass and the output use them
    checkpoint_dir(df.sparkSession)
    bounds = iqr_bounds(df, cols, by, factor).checkpoint(eager=True)
    long = long_values(df, cols, by)
    keys = by + ["column"]
    # one row per column (ungrouped): size fixed by the schema -> broadcast
    b = F.broadcast(bounds) if not by else _maybe_broadcast(bounds, df)
    counts = (long.join(b.select(*keys, "lower_bound", "upper_bound"), keys)
              .groupBy(*keys)
              .agg(F.count_if(_outside(F.col("v"), F.col("lower_bound"), F.col("upper_bound")))
                   .alias("total_outliers")))
    rows = (df.groupBy(*by) if by else df).agg(F.count(F.lit(1)).alias("rows"))
    valid = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("valid"))
    out = bounds.join(counts, keys, "left").join(valid, keys, "left")
    out = out.join(rows, by) if by else with_scalars(out, rows)
    out = out.withColumn("total_outliers", F.coalesce("total_outliers", F.lit(0)).cast("bigint")) \
             .withColumn("valid", F.coalesce("valid", F.lit(0)).cast("bigint"))
    den = F.col("rows") if denominator == "all" else F.col("valid")
    order = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    return out.select(*by, "column", order[F.col("column")].alias("ordinal"), "rows", "valid",
                      "q1", "q3", "iqr", "lower_bound", "upper_bound", "total_outliers",
                      _pct(F.col("total_outliers"), den).alias("percentage"))


def _maybe_broadcast(small: DataFrame, df: DataFrame) -> DataFrame:
    n = small.count()
    return F.broadcast(small) if n <= broadcast_row_limit(df.sparkSession) else small


def outlier_summary(report: DataFrame) -> DataFrame:
    """T5: columns analysed and columns with at least one outlier."""
    return report.agg(F.count(F.lit(1)).alias("total_columns_analyzed"),
                      F.count_if(F.col("total_outliers") > 0).alias("columns_with_outliers"))


def outlier_rows(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """The rows of ``df`` whose ``column`` lies strictly outside the IQR fences."""
    b = iqr_bounds(df, [column], factor=factor).select("lower_bound", "upper_bound")
    v = clean_double(column)
    return (with_scalars(df, b)
            .where(_outside(v, F.col("lower_bound"), F.col("upper_bound")))
            .drop("lower_bound", "upper_bound"))


def outlier_keys(df: DataFrame, column: str, key: str, limit: int | None = None) -> DataFrame:
    """T3 index list: the keys of outlier rows; with ``limit`` the first ones."""
    keys = outlier_rows(df, column).select(key)
    return keys if limit is None else keys.orderBy(key).limit(limit)


def outlier_values(df: DataFrame, column: str, key: str, limit: int | None = None) -> DataFrame:
    """T4 value list: (key, value) of outlier rows; with ``limit`` the first ones."""
    rows = outlier_rows(df, column).select(key, clean_double(column).alias("value"))
    return rows if limit is None else rows.orderBy(key).limit(limit)


def outlier_tool(df: DataFrame, column: str, key: str | None = None, limit: int = 10) -> DataFrame:
    """T4 in full: the report over non-null rows, and ``outlier_values``: the first
    ``limit`` outliers by ``key`` (without one, the smallest)."""
    report = outlier_report(df, [column], denominator="valid")
    first = outlier_values(df, column, key, limit) if key else \
        outlier_rows(df, column).select(clean_double(column).alias("value")).orderBy("value").limit(limit)
    order = F.col(key) if key else F.col("value")
    some = first.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("value").alias("v")))).alias("s")) \
        .select(F.transform("s", lambda x: x["v"]).alias("outlier_values"))
    return with_scalars(report, some)
