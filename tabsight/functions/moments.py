"""Bias-corrected sample skewness and excess kurtosis.

Spark's ``skewness``/``kurtosis`` are population moments (g1, g2). The
sample-adjusted forms used by the reference (pandas ``skew``/``kurt``) are

    G1 = g1 * sqrt(n (n - 1)) / (n - 2)
    G2 = (n - 1) / ((n - 2)(n - 3)) * ((n + 1) g2 + 6)

Both are NULL when n is too small or the column is constant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(n: Column, g1: Column) -> Column:
    return F.when((n > 2) & g1.isNotNull() & ~F.isnan(g1),
                  g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(n: Column, g2: Column) -> Column:
    return F.when((n > 3) & g2.isNotNull() & ~F.isnan(g2),
                  (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def pop_skewness(c: Column) -> Column:
    # population skewness; NULL (not NaN) for a constant column
    s = F.skewness(c)
    return F.when(~F.isnan(s), s)


def pop_kurtosis(c: Column) -> Column:
    k = F.kurtosis(c)
    return F.when(~F.isnan(k), k)
