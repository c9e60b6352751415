"""Correlation matrices (Pearson, Spearman, Kendall tau-b) in long form, strong
pairs, pair wording and the heat-map grid.

Pearson: every pair is an expression of ONE aggregate: for NULL-free columns a sum of
products around the means of a first pass, else the pairwise-complete covariance
(``try_divide``, so a constant column yields NULL instead of an ANSI error);
chunked so very wide tables stay inside code generation limits.

Spearman: ``rank_products`` ranks the values of all columns in buckets and adds up
the products of a row's ranks; values travel, rows don't. Where columns have NULLs,
a pair is ranked on its complete rows (the pandas definition): a value has one rank more
for each partner column with NULLs, and all pairs come from one job.

Kendall: see ``kendall.tau_b``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_double, numeric_columns
from .rank_products import rank_products

METHODS = ("pearson", "spearman", "kendall")


def resolve_method(method: str | None) -> str:
    """Unknown method -> pearson (endpoint behaviour)."""
    return method if method in METHODS else "pearson"


def _pair_exprs(x: Column, y: Column, tag: str) -> list[Column]:
    both = x.isNotNull() & y.isNotNull()
    xb, yb = F.when(both, x), F.when(both, y)
    return [F.try_divide(F.covar_samp(xb, yb),
                         F.stddev_samp(xb) * F.stddev_samp(yb)).alias(f"r_{tag}"),
            F.count_if(both).alias(f"n_{tag}")]


def pearson_long(df: DataFrame, columns: Sequence[str] | None = None,
                 chunk: int = 150) -> DataFrame:
    """(column1, column2, i, j, n, correlation) for i <= j, pairwise complete.

    A cheap first pass (count, min, max, mean per column) classifies columns; pairs
    of null-free columns then need one sum of centred products, pairs touching a
    constant column are NULL, and only pairs with NULLs pay for the pairwise-complete
    form."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    if len(columns) < 2:
        raise ValueError("a correlation takes two numeric columns or more")
    base = df.select(*[clean_double(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    k = len(columns)
    pre = base.agg(F.count(F.lit(1)).alias("rows"),
                   *[x for i in range(k) for x in (F.count(f"__c{i}").alias(f"n{i}"),
                                                   F.avg(f"__c{i}").alias(f"mu{i}"),
                                                   F.min(f"__c{i}").alias(f"lo{i}"),
                                                   F.max(f"__c{i}").alias(f"hi{i}"))]).first()
    rows = pre["rows"]
    full = [pre[f"n{i}"] == rows for i in range(k)]
    const = [pre[f"n{i}"] == 0 or pre[f"lo{i}"] == pre[f"hi{i}"] for i in range(k)]
    exprs, fixed = [], {}
    centred = [F.col(f"__c{i}") - F.lit(pre[f"mu{i}"]) for i in range(k)]
    for i in range(k):
        if full[i] and not const[i]:
            exprs.append(F.sum(centred[i] * centred[i]).alias(f"ss{i}"))
    for i, j in combinations_with_replacement(range(k), 2):
        tag = f"{i}_{j}"
        if i == j:
            fixed[tag] = (pre[f"n{i}"], None if const[i] else 1.0)
        elif const[i] or const[j]:
            n = rows if (full[i] and full[j]) else None
            if n is None:
                exprs.append(F.count_if(F.col(f"__c{i}").isNotNull()
                                        & F.col(f"__c{j}").isNotNull()).alias(f"n_{tag}"))
            fixed[tag] = (n, None)
        elif full[i] and full[j]:
            exprs.append(F.sum(centred[i] * centred[j]).alias(f"cv_{tag}"))
            fixed[tag] = (rows, "cv")
        else:
            exprs += _pair_exprs(F.col(f"__c{i}"), F.col(f"__c{j}"), tag)
            fixed[tag] = (None, "pw")
    if not exprs:
        exprs = [F.count(F.lit(1)).alias("__rows")]
    parts = []
    for s in range(0, len(exprs), chunk):
        parts.append(base.agg(*exprs[s:s + chunk]))
    agg = parts[0]
    for p in parts[1:]:
        agg = _join1(agg, p)
    structs = []
    for i, j in combinations_with_replacement(range(k), 2):
        tag = f"{i}_{j}"
        n, kind = fixed[tag]
        n_col = F.lit(n).cast("bigint") if n is not None else F.col(f"n_{tag}")
        if kind == "cv":
            r = F.try_divide(F.col(f"cv_{tag}"), F.sqrt(f"ss{i}") * F.sqrt(f"ss{j}"))
        elif kind == "pw":
            r = F.col(f"r_{tag}")
        else:
            r = F.lit(kind).cast("double")
        structs.append(F.struct(F.lit(columns[i]).alias("column1"),
                                F.lit(columns[j]).alias("column2"),
                                F.lit(i).alias("i"), F.lit(j).alias("j"),
                                n_col.alias("n"), _clip(r).alias("correlation")))
    return agg.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def _join1(a: DataFrame, b: DataFrame) -> DataFrame:
    from .profile import with_scalars
    return with_scalars(a, b)


def _clip(r: Column) -> Column:
    r = F.when(~F.isnan(r), r)
    return F.when(r > 1.0, F.lit(1.0)).when(r < -1.0, F.lit(-1.0)).otherwise(r)


def spearman_long(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns) if columns is not None else numeric_columns(df)
    if len(columns) < 2:
        raise ValueError("a correlation takes two numeric columns or more")
    base = df.select(*[clean_double(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    seen = base.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in base.columns]).first()
    holes = [i for i, c in enumerate(base.columns) if seen[c] < seen["rows"]]
    sums, constant = rank_products(base, seen["rows"], holes) if seen["rows"] else ({}, [True] * len(columns))
    out = []
    for i, j in combinations_with_replacement(range(len(columns)), 2):
        n, xy, xx, yy = sums.get((i, j), (0, 0.0, 0.0, 0.0))
        if i == j:
            r = None if constant[i] else 1.0
        else:
            r = min(1.0, max(-1.0, xy / (math.sqrt(xx) * math.sqrt(yy)))) if xx and yy else None
        out.append((columns[i], columns[j], i, j, n, r))
    return df.sparkSession.createDataFrame(out, "column1 string, column2 string, i int, j int, n long, correlation double")


def correlation_long(df: DataFrame, columns: Sequence[str] | None = None,
                     method: str = "pearson") -> DataFrame:
    """Upper triangle incl. diagonal: (column1, column2, i, j, n, correlation)."""
    method = resolve_method(method)
    if method == "pearson":
        return pearson_long(df, columns)
    if method == "spearman":
        return spearman_long(df, columns)
    from .kendall import kendall_long
    return kendall_long(df, columns)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None,
                       method: str = "pearson") -> DataFrame:
    """Full n x n long form (mirrored), diagonal included."""
    up = correlation_long(df, columns, method)
    low = up.where(F.col("i") != F.col("j")).select(
        F.col("column2").alias("column1"), F.col("column1").alias("column2"),
        F.col("j").alias("i"), F.col("i").alias("j"), "n", "correlation")
    return up.unionByName(low)


def strong_pairs(corr_long: DataFrame, threshold: float = 0.5, strong: float = 0.7) -> DataFrame:
    """i<j with |r| > threshold; 'strong' if |r| > strong else 'moderate'."""
    return (corr_long.where((F.col("i") < F.col("j")) & (F.abs("correlation") > threshold))
            .select(F.col("column1").alias("feature1"), F.col("column2").alias("feature2"),
                    "correlation",
                    F.when(F.abs("correlation") > strong, "strong").otherwise("moderate")
                    .alias("strength"), F.abs("correlation").alias("abs_correlation")))


def strong_pairs_summary(corr_long: DataFrame, threshold: float = 0.5,
                         strong: float = 0.7) -> DataFrame:
    """T10 summary: total features, strong and moderate counts."""
    sp = strong_pairs(corr_long, threshold, strong)
    feats = corr_long.agg(F.count_distinct("column1").alias("total_features"))
    cnt = sp.agg(F.count_if(F.col("strength") == "strong").alias("strong_correlations_count"),
                 F.count_if(F.col("strength") == "moderate").alias("moderate_correlations_count"))
    from .profile import with_scalars
    return with_scalars(feats, cnt)


def describe_strength(r: Column) -> Column:
    a = F.abs(r)
    return (F.when(a > 0.7, "strong").when(a > 0.4, "moderate").when(a > 0.2, "weak")
            .otherwise("very weak"))


def pair_correlation(df: DataFrame, col1: str, col2: str, method: str = "pearson") -> DataFrame:
    """One pair, with strength wording (0.7/0.4/0.2) and direction
    (``> 0`` positive, else negative)."""
    method = resolve_method(method)
    cols = [col1, col2]
    long = correlation_long(df, cols, method).where((F.col("i") == 0) & (F.col("j") == 1))
    r = F.col("correlation")
    return long.select(F.col("column1").alias("col1"), F.col("column2").alias("col2"),
                       F.lit(method).alias("method"), r.alias("correlation"),
                       describe_strength(r).alias("strength"),
                       F.when(r > 0, "positive").otherwise("negative").alias("direction"))


def quick_insight_pairs(corr_long: DataFrame, threshold: float = 0.7, k: int = 3) -> DataFrame:
    """The first k pairs (column order, not sorted by r) with |r| > threshold."""
    return (corr_long.where((F.col("i") < F.col("j")) & (F.abs("correlation") > threshold))
            .orderBy("i", "j").limit(k)
            .select(F.col("column1").alias("feature1"), F.col("column2").alias("feature2"),
                    "correlation"))
