"""Profiling and data-quality aggregates (dataset overview, per-column nulls,
distinct counts, numeric profiles, top values, describe, missing analysis,
group comparison, target-type detection).

Design: scalar statistics of many columns come from ONE wide aggregate (no
row multiplication); anything keyed by value (distinct counts, top-k, mode)
comes from ONE unpivot -> ``groupBy(column, value).count()`` job, which
pre-aggregates hot values map-side. Top-k uses ``row_number() <= k``, which
Spark plans as a partial WindowGroupLimit before the shuffle, so no task sees
more than k rows per column from each partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (categorical_columns, clean_double, is_missing, kind_of,
                                 numeric_columns)
from ..functions.moments import sample_kurtosis, sample_skewness
from .quantiles import quantiles


def _pct(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double") * 100.0, den.cast("double"))


def _explode_structs(df: DataFrame, keep: Sequence[str], structs: list[Column]) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*structs)).alias("__s")).select(*keep, "__s.*")


# ---------------------------------------------------------------- moments

def numeric_moments(df: DataFrame, columns: Sequence[str] | None = None,
                    by: Sequence[str] = ()) -> DataFrame:
    """One wide aggregate -> long (by..., column, rows, count, missing, mean, std,
    var, min, max, sum, zeros, skewness, kurtosis) with sample-corrected moments."""
    by = list(by)
    columns = list(columns) if columns is not None else numeric_columns(df, tuple(by))
    base = df.select(*by, *[clean_double(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, _ in enumerate(columns):
        c = F.col(f"__c{i}")
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"mean{i}"),
                 F.stddev_samp(c).alias(f"std{i}"), F.var_samp(c).alias(f"var{i}"),
                 F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}"), F.sum(c).alias(f"sum{i}"),
                 F.count_if(c == 0).alias(f"z{i}"),
                 F.skewness(c).alias(f"g1_{i}"), F.kurtosis(c).alias(f"g2_{i}")]
    agg = (base.groupBy(*by) if by else base).agg(*aggs)
    structs = []
    for i, name in enumerate(columns):
        n = F.col(f"n{i}")
        g1 = F.col(f"g1_{i}")
        g2 = F.col(f"g2_{i}")
        structs.append(F.struct(
            F.lit(name).alias("column"), F.lit(i).alias("ordinal"), F.col("__rows").alias("rows"),
            n.alias("count"), (F.col("__rows") - n).alias("missing"),
            F.col(f"mean{i}").alias("mean"), _nan_null(F.col(f"std{i}")).alias("std"),
            _nan_null(F.col(f"var{i}")).alias("var"),
            F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"),
            F.col(f"sum{i}").alias("sum"), F.col(f"z{i}").alias("zeros"),
            sample_skewness(n, g1).alias("skewness"), sample_kurtosis(n, g2).alias("kurtosis")))
    return _explode_structs(agg, by, structs)


def _nan_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


# ---------------------------------------------------------------- value counts

def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                 dropna: bool = True) -> DataFrame:
    """(by..., column, value STRING, count) for every distinct value of each column."""
    by = list(by)
    columns = list(columns)
    base = df.select(*by, *[_as_text(df, c).alias(f"__c{i}") for i, c in enumerate(columns)])
    if len(columns) == 1:
        long = base.select(*by, F.lit(columns[0]).alias("column"), F.col("__c0").alias("value"))
    else:
        long = base.unpivot(by, [f"__c{i}" for i in range(len(columns))], "column", "value")
        mapping = F.create_map(*[x for i, c in enumerate(columns)
                                 for x in (F.lit(f"__c{i}"), F.lit(c))])
        long = long.withColumn("column", mapping[F.col("column")])
    if dropna:
        long = long.where(F.col("value").isNotNull())
    return long.groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("count"))


def _as_text(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return (clean_double(c) + F.lit(0.0)).cast("string")  # -0.0 is 0.0
    return F.col(c).cast("string")


def top_k(counts: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Keep the k most frequent values per (by..., column); ties by value asc."""
    w = Window.partitionBy(*by, "column").orderBy(F.desc("count"), F.asc("value"))
    return (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("bigint")))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None,
                    approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """(column, unique) from the value-count job (NULL not counted).

    ``approx=True``: one aggregate of HyperLogLog++ sketches (relative error
    ``rsd``) instead of a shuffle of every distinct value - for very wide or
    very high-cardinality tables."""
    columns = list(columns) if columns is not None else df.columns
    if approx:
        agg = df.agg(*[F.approx_count_distinct(_as_text(df, c), rsd).alias(f"u{i}")
                       for i, c in enumerate(columns)])
        return _explode_structs(agg, [], [F.struct(F.lit(c).alias("column"),
                                                   F.col(f"u{i}").alias("unique"))
                                          for i, c in enumerate(columns)])
    # 128 bits of hash and the length stand for a value: long texts are not shuffled
    marks = df.select(*[F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit(1), v).alias("b"), F.length(v).alias("n"))
                        .alias(f"__c{i}") for i, v in enumerate(_as_text(df, c) for c in columns)])
    long = marks.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__c{i}").alias("m"))
                                            for i, c in enumerate(columns)])).alias("x")).select("x.column", "x.m.*")
    known = long.where(F.col("n").isNotNull()).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("unique"))
    return known


# ---------------------------------------------------------------- A1 / A3

def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, ordinal, dtype, rows, missing) from one aggregate."""
    columns = list(columns) if columns is not None else df.columns
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(columns)])
    structs = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"),
                        F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                        F.col("__rows").alias("rows"), F.col(f"m{i}").alias("missing"))
               for i, c in enumerate(columns)]
    return _explode_structs(agg, [], structs)


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a ONE-row aggregate to every row (broadcast of one row)."""
    return (df.withColumn("__k", F.lit(0))
            .join(F.broadcast(scalars.withColumn("__k", F.lit(0))), "__k").drop("__k"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """rows, distinct_rows, duplicate_rows (copies beyond the first; NULLs equal).

    Rows are grouped by 192 bits of content hash, null flags included, so that
    texts are not shuffled; hashes are combined map-side."""
    nulls = F.concat(F.lit(""), *[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns])
    cells = [F.col(f"`{c}`") for c in df.columns]
    groups = df.groupBy(*[F.xxhash64(F.lit(k), nulls, *cells).alias(f"__h{k}") for k in range(3)]) \
        .agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("rows"),
                      F.count(F.lit(1)).alias("distinct_rows")) \
        .withColumn("duplicate_rows", F.col("rows") - F.col("distinct_rows"))


def overview(df: DataFrame) -> DataFrame:
    """A1: rows, columns, missing_cells, missing_percentage, duplicate_rows."""
    ncols = len(df.columns)
    miss = sum((F.count_if(is_missing(df, c)) for c in df.columns), F.lit(0))
    scal = df.agg(F.count(F.lit(1)).alias("rows"), miss.alias("missing_cells"))
    dup = duplicate_rows(df).select("duplicate_rows")
    return (with_scalars(scal, dup)
            .select("rows", F.lit(ncols).cast("bigint").alias("columns"), "missing_cells",
                    _pct(F.col("missing_cells"), F.col("rows") * ncols).alias("missing_percentage"),
                    "duplicate_rows"))


# ---------------------------------------------------------------- A2

def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """A2: (column, ordinal, dtype, missing, missing_percentage, unique, unique_percentage)."""
    nulls = null_counts(df)
    uniq = distinct_counts(df, approx=approx)
    return (nulls.join(uniq, "column", "left")
            .withColumn("unique", F.coalesce(F.col("unique"), F.lit(0)).cast("bigint"))
            .select("column", "ordinal", "dtype", "missing",
                    _pct(F.col("missing"), F.col("rows")).alias("missing_percentage"), "unique",
                    _pct(F.col("unique"), F.col("rows")).alias("unique_percentage")))


# ---------------------------------------------------------------- A4 / A6 / T1

def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None,
                    by: Sequence[str] = ()) -> DataFrame:
    """A4: mean, median, std, min, max, zeros, zeros % of all rows per numeric column."""
    by = list(by)
    columns = list(columns) if columns is not None else numeric_columns(df, tuple(by))
    mom = numeric_moments(df, columns, by)
    med = quantiles(df, columns, [0.5], by, wide=True).withColumnRenamed("q_0", "median")
    return (mom.join(med, by + ["column"], "left")
            .select(*by, "column", "ordinal", "rows", "count", "missing",
                    _pct(F.col("missing"), F.col("rows")).alias("missing_percentage"),
                    "mean", "median", "std", "min", "max", "zeros",
                    _pct(F.col("zeros"), F.col("rows")).alias("zeros_percentage")))


def describe(df: DataFrame, columns: Sequence[str] | None = None,
             by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, std, min, 25%, 50%, 75%, max per numeric column (exact
    percentiles), with missing count and type name."""
    by = list(by)
    columns = list(columns) if columns is not None else numeric_columns(df, tuple(by))
    mom = numeric_moments(df, columns, by)
    q = quantiles(df, columns, [0.25, 0.5, 0.75], by, wide=True)
    types = {c: df.schema[c].dataType.simpleString() for c in columns}
    dtype = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c]))])
    return (mom.join(q, by + ["column"], "left")
            .select(*by, "column", "ordinal", dtype[F.col("column")].alias("dtype"), "count",
                    "missing", "mean", "std", "min", F.col("q_0").alias("q25"),
                    F.col("q_1").alias("q50"), F.col("q_2").alias("q75"), "max"))


def distribution_numeric(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, median, mode, std, variance, min, max, range, q1..q3, iqr,
    skewness, kurtosis of the non-null values."""
    by = list(by)
    mom = numeric_moments(df, [column], by)
    q = quantiles(df, [column], [0.25, 0.5, 0.75], by, wide=True)
    md = mode(df, [column], by)
    return (mom.join(q, by + ["column"], "left").join(md, by + ["column"], "left")
            .select(*by, "column", "count", "mean", F.col("q_1").alias("median"), "mode", "std",
                    F.col("var").alias("variance"), "min", "max",
                    (F.col("max") - F.col("min")).alias("range"),
                    F.col("q_0").alias("q1"), F.col("q_1").alias("q2"), F.col("q_2").alias("q3"),
                    (F.col("q_2") - F.col("q_0")).alias("iqr"), "skewness", "kurtosis"))


def mode(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Most frequent non-null numeric value per column; ties -> smallest.

    Distinct (value, count) pairs come from a partially aggregated groupBy; the
    pick is a second aggregate with ``min_by`` (no per-column task)."""
    by = list(by)
    long = df.select(*by, *[clean_double(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    parts = []
    for i, c in enumerate(columns):
        counts = (long.where(F.col(f"__c{i}").isNotNull())
                  .groupBy(*by, F.col(f"__c{i}").alias("v")).agg(F.count(F.lit(1)).alias("cnt")))
        parts.append((counts.groupBy(*by) if by else counts)
                     .agg(F.min_by("v", F.struct(-F.col("cnt"), F.col("v"))).alias("mode"))
                     .withColumn("column", F.lit(c)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- A5 / T2 / C5 / C6 / A10

def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10,
               by: Sequence[str] = ()) -> DataFrame:
    """A5: (column, rank, value, count) top-k per categorical column."""
    columns = list(columns) if columns is not None else categorical_columns(df, tuple(by))
    return top_k(value_counts(df, columns, by), k, by).select(
        *by, "column", "rank", "value", "count")


def distribution_categorical(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """Count, unique, top value/frequency/% (of non-null rows) and top-k counts."""
    counts = value_counts(df, [column])
    tot = counts.groupBy("column").agg(F.sum("count").alias("non_null"),
                                       F.count(F.lit(1)).alias("unique"))
    top = top_k(counts, k)
    first = top.where(F.col("rank") == 1).select("column", F.col("value").alias("top_value"),
                                                 F.col("count").alias("top_frequency"))
    return (top.join(tot, "column").join(first, "column")
            .select("column", F.col("non_null").alias("count"), "unique", "top_value",
                    "top_frequency",
                    _pct(F.col("top_frequency"), F.col("non_null")).alias("top_percentage"),
                    "rank", "value", F.col("count").alias("value_count")))


def class_balance(df: DataFrame, column: str) -> DataFrame:
    """A10: (value, count, percentage of all rows) for non-null values."""
    counts = value_counts(df, [column])
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return (with_scalars(counts, rows)
            .select("value", "count", _pct(F.col("count"), F.col("rows")).alias("percentage")))


# ---------------------------------------------------------------- A9 / P9

def missing_columns(df: DataFrame) -> DataFrame:
    """Columns with missing > 0: (column, missing_count, missing_percentage, dtype)."""
    return (null_counts(df).where(F.col("missing") > 0)
            .select("column", F.col("missing").alias("missing_count"),
                    _pct(F.col("missing"), F.col("rows")).alias("missing_percentage"), "dtype"))


def missing_summary(df: DataFrame) -> DataFrame:
    """One row: total_missing_cells, total_cells, overall %, complete rows, %."""
    ncols = len(df.columns)
    miss = sum((F.count_if(is_missing(df, c)) for c in df.columns), F.lit(0))
    complete = F.count_if(~_any_missing(df))
    return (df.agg(F.count(F.lit(1)).alias("rows"), miss.alias("total_missing_cells"),
                   complete.alias("complete_rows"))
            .select("total_missing_cells",
                    (F.col("rows") * ncols).alias("total_cells"),
                    _pct(F.col("total_missing_cells"), F.col("rows") * ncols)
                    .alias("overall_missing_percentage"),
                    "complete_rows",
                    _pct(F.col("complete_rows"), F.col("rows")).alias("complete_rows_percentage")))


def _any_missing(df: DataFrame) -> Column:
    cond = F.lit(False)
    for c in df.columns:
        cond = cond | is_missing(df, c)
    return cond


# ---------------------------------------------------------------- A7 / A8

def data_info(df: DataFrame) -> DataFrame:
    """Per column dtype, kind, missing, unique + dataset totals on every row."""
    prof = column_profile(df)
    ov = overview(df)
    kinds = {f.name: ("numeric" if f.name in numeric_columns(df)
                      else "categorical" if f.name in categorical_columns(df) else "other")
             for f in df.schema.fields}
    kind = F.create_map(*[x for c, k in kinds.items() for x in (F.lit(c), F.lit(k))])
    return (with_scalars(prof, ov.select("rows", "columns",
                                          F.col("missing_cells").alias("total_missing"),
                                          "duplicate_rows"))
            .select("column", "ordinal", "dtype", kind[F.col("column")].alias("kind"), "missing",
                    "unique", "rows", "columns", "total_missing", "duplicate_rows"))


def summarize_numeric(df: DataFrame, column: str) -> DataFrame:
    """A8 numeric: totals incl. missing, unique, mean, median, std, min, max, q1, q3,
    skewness, kurtosis."""
    mom = numeric_moments(df, [column])
    q = quantiles(df, [column], [0.25, 0.5, 0.75], wide=True)
    u = distinct_counts(df, [column])
    return (mom.join(q, "column", "left").join(u, "column", "left")
            .select("column", F.col("rows").alias("total"), "missing",
                    _pct(F.col("missing"), F.col("rows")).alias("missing_percentage"),
                    F.coalesce("unique", F.lit(0)).cast("bigint").alias("unique"), "mean",
                    F.col("q_1").alias("median"), "std", "min", "max", F.col("q_0").alias("q1"),
                    F.col("q_2").alias("q3"), "skewness", "kurtosis"))


def summarize_categorical(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """A8 text: totals and top-k values with % of ALL rows (NULLs in denominator)."""
    nulls = null_counts(df, [column])
    u = distinct_counts(df, [column])
    top = top_values(df, [column], k)
    return (top.join(nulls, "column").join(u, "column", "left")
            .select("column", F.col("rows").alias("total"), "missing",
                    _pct(F.col("missing"), F.col("rows")).alias("missing_percentage"),
                    F.coalesce("unique", F.lit(0)).cast("bigint").alias("unique"), "rank", "value",
                    "count", _pct(F.col("count"), F.col("rows")).alias("percentage")))


# ---------------------------------------------------------------- A11

def compare_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per non-null group: count, mean, median, std, min, max of ``value``.

    Values are returned unrounded (round for display only)."""
    g = df.where(F.col(group).isNotNull())
    mom = numeric_moments(g, [value], [group])
    med = quantiles(g, [value], [0.5], [group], wide=True).withColumnRenamed("q_0", "median")
    return (mom.join(med, [group, "column"], "left")
            .select(group, "count", "mean", "median", "std", "min", "max"))


# ---------------------------------------------------------------- A12 / A13

def _target_rule(kind: str, n) -> list[tuple]:
    """The rule for a target's problem type, first match wins: (condition, type,
    why). ``n`` counts the distinct values, a missing one included."""
    return [
        (F.lit(kind in ("text", "bool")), "classification", "text or boolean target: values are classes"),
        (n < 20, "classification", "%d distinct values: few enough to be classes"),
        (n > 50, "regression", "%d distinct values: too many to be classes"),
        (F.lit(kind == "float"), "regression", "%d distinct fractional values"),
        (F.lit(True), "classification", "%d distinct whole numbers"),
    ]


def _first_match(rule: list[tuple], value) -> Column:
    out = None
    for row in reversed(rule):
        out = value(row) if out is None else F.when(row[0], value(row)).otherwise(out)
    return out


def detect_problem_type(df: DataFrame, target: str, order_by: str | None = None) -> DataFrame:
    """problem_type, reason, unique_values, target_dtype, is_continuous,
    sample_values (first 10 values by ``order_by``).

    unique_values counts a missing value as one more distinct value."""
    dt = df.schema[target].dataType
    kind = kind_of(dt)
    u = df.agg(F.count_distinct(clean_double(target) if kind == "float" else F.col(target))
               .alias("nd"),
               F.max(is_missing(df, target).cast("int")).alias("has_null"))
    n = (F.col("nd") + F.coalesce(F.col("has_null"), F.lit(0))).cast("bigint")
    rule = _target_rule(kind, n)
    out = u.select(_first_match(rule, lambda r: F.lit(r[1])).alias("problem_type"),
                   _first_match(rule, lambda r: F.format_string(r[2], n) if "%d" in r[2]
                                else F.lit(r[2])).alias("reason"),
                   n.alias("unique_values"), F.lit(dt.simpleString()).alias("target_dtype"),
                   (F.lit(kind == "float") & (n > 50)).alias("is_continuous"))
    if order_by:
        sample = (df.orderBy(order_by).limit(10)
                  .agg(F.collect_list(F.struct(F.col(order_by).alias("o"),
                                               F.col(target).cast("string").alias("v"))).alias("s"))
                  .select(F.transform(F.array_sort("s"), lambda x: x["v"]).alias("sample_values")))
        out = with_scalars(out, sample)
    return out


class ProblemTypeError(ValueError):
    pass


def check_problem_type(df: DataFrame, target: str, specified: str | None = None) -> str:
    """Validate a requested problem type (or detect one); raises on mismatch.

    Returns 'classification' or 'regression'. Reads one row of the detected rule.
    A request is refused only where it cannot work: classes of a fractional target
    with over 50 values, or regression on at most 20 whole numbers or texts."""
    found = detect_problem_type(df, target).first()
    n, kind = found["unique_values"], kind_of(df.schema[target].dataType)
    refused = {"classification": kind == "float" and n > 50,
               "regression": kind in ("integer", "text") and n <= 20}
    if specified in refused:
        if refused[specified]:
            other = "regression" if specified == "classification" else "classification"
            raise ProblemTypeError(f"{specified} does not suit {target!r}: {n} distinct values of kind "
                                   f"{kind}; use {other}")
        return specified
    return found["problem_type"]
