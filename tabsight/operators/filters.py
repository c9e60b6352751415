"""Projections and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import categorical_columns, is_missing, numeric_columns, subset


def numeric_projection(df: DataFrame) -> DataFrame:
    """Numeric columns only (booleans excluded)."""
    return df.select(*numeric_columns(df))


def categorical_projection(df: DataFrame) -> DataFrame:
    """Text and boolean columns."""
    return df.select(*categorical_columns(df))


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(features, target) projections."""
    return df.drop(target), df.select(target)


def column_subset(df: DataFrame, requested: str | list[str] | None) -> list[str]:
    """Requested names that exist and are numeric; others skipped silently."""
    return subset(requested, numeric_columns(df))


def predicate(p: str | Column) -> Column:
    return F.expr(p) if isinstance(p, str) else p


def filter_rows(df: DataFrame, p: str | Column) -> DataFrame:
    """P5: rows matching a Spark SQL predicate (e.g. ``"o_totalprice > 1e5 and
    o_orderstatus = 'F'"``); NULL comparisons do not match."""
    return df.where(predicate(p))


def filter_summary(df: DataFrame, p: str | Column) -> DataFrame:
    """P5 counts in one pass: matched, total."""
    return df.agg(F.count_if(F.coalesce(predicate(p), F.lit(False))).alias("matched"),
                  F.count(F.lit(1)).alias("total"))


def filter_preview(df: DataFrame, p: str | Column, order_by: str, n: int = 10) -> DataFrame:
    """P5 first ``n`` matches by a key (file order is not defined in Spark)."""
    return filter_rows(df, p).orderBy(order_by).limit(n)


def drop_null(df: DataFrame, column: str) -> DataFrame:
    """P6."""
    return df.where(~is_missing(df, column))


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows with no NULL/NaN in any column."""
    return df.na.drop(how="any")


def complete_row_count(df: DataFrame) -> DataFrame:
    cond = F.lit(True)
    for c in df.columns:
        cond = cond & ~is_missing(df, c)
    return df.agg(F.count_if(cond).alias("complete_rows"), F.count(F.lit(1)).alias("rows"))
