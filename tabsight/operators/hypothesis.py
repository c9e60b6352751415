"""One-way ANOVA (T12) and the Shapiro-Wilk normality test."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean_double, numeric_columns
from ..functions.special import f_sf, norm_ppf, norm_ppf_array, norm_sf
from ..session import ship_package
from .profile import numeric_moments, with_scalars
from .quantiles import long_values
from .ranks import running_counts


@F.pandas_udf(T.DoubleType())
def _f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_sf(None if pd.isna(a) else float(a), float(b), float(c))
                      if not (pd.isna(b) or pd.isna(c)) else None
                      for a, b, c in zip(f, d1, d2)], dtype="float64")


def anova_oneway(df: DataFrame, group: str, value: str) -> DataFrame:
    """F statistic, dfs and p-value of a one-way ANOVA over non-null groups.

    Per-group n, mean, variance come from one aggregate (one row per group);
    SSB uses the grand mean in a second step (better than the one-step form)."""
    ship_package(df.sparkSession)
    v = clean_double(value)
    g = (df.where(F.col(group).isNotNull() & v.isNotNull())
         .groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("m"),
                             F.var_samp(v).alias("s2")))
    tot = g.agg(F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("k"),
                (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"))
    parts = with_scalars(g, tot).agg(
        F.first("n_total").alias("n_total"), F.first("k").alias("k"),
        F.sum(F.col("n") * (F.col("m") - F.col("gm")) ** 2).alias("ssb"),
        F.sum(F.coalesce((F.col("n") - 1) * F.col("s2"), F.lit(0.0))).alias("ssw"))
    d1 = F.col("k") - 1
    d2 = F.col("n_total") - F.col("k")
    f = F.try_divide(F.try_divide(F.col("ssb"), d1), F.try_divide(F.col("ssw"), d2))
    out = parts.select("k", "n_total", d1.alias("df_between"), d2.alias("df_within"), "ssb", "ssw",
                       f.alias("f_statistic"))
    return (out.withColumn("p_value", _f_pvalue("f_statistic", "df_between", "df_within"))
            .withColumn("significant", F.col("p_value") < 0.05)
            .withColumnRenamed("k", "groups").withColumnRenamed("n_total", "n"))


# Shapiro-Wilk W and p-value: Royston's approximation (Applied Statistics
# algorithm AS R94, 1995). The published polynomial
# coefficients of that algorithm, in its order.
SW_G = (-2.273, 0.459)
SW_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SW_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SW_C3 = (0.544, -0.39978, 0.025054, -6.714e-4)
SW_C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
SW_C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
SW_C6 = (-0.4803, -0.082676, 0.0030302)


def _poly(c: Sequence[float], x: float) -> float:
    r = 0.0
    for coef in reversed(c):
        r = r * x + coef
    return r


def shapiro_wilk(x: np.ndarray) -> tuple[float | None, float | None]:
    """(W, p) of one in-memory sample (None when undefined): the small-sample form that
    the tests hold the distributed job against."""
    x = np.sort(np.asarray(x, dtype=np.float64))
    n = len(x)
    if n < 3 or x[-1] - x[0] <= 0:
        return None, None
    half = n // 2
    if n == 3:
        a = np.array([math.sqrt(0.5)])
    else:
        m = np.array([norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, half + 1)])
        summ2 = 2.0 * float(np.sum(m * m))
        ssumm2 = math.sqrt(summ2)
        rsn = 1.0 / math.sqrt(n)
        a1 = _poly(SW_C1, rsn) - m[0] / ssumm2
        a = -m / 1.0
        if n > 5:
            a2 = -m[1] / ssumm2 + _poly(SW_C2, rsn)
            fac = math.sqrt((summ2 - 2 * m[0] ** 2 - 2 * m[1] ** 2) / (1 - 2 * a1 ** 2 - 2 * a2 ** 2))
            a = -m / fac
            a[0], a[1] = a1, a2
        else:
            fac = math.sqrt((summ2 - 2 * m[0] ** 2) / (1 - 2 * a1 ** 2))
            a = -m / fac
            a[0] = a1
    diffs = x[::-1][:half] - x[:half]
    num = float(np.dot(a, diffs)) ** 2
    den = float(np.sum((x - x.mean()) ** 2))
    w = min(1.0, num / den)
    return w, shapiro_p(w, n)


def shapiro_p(w: float, n: int) -> float:
    """p-value of W for a sample of ``n`` >= 3 (the published approximation; its
    fit ends at n = 5000, beyond which the value is an extrapolation)."""
    if n == 3:
        return max(0.0, (6.0 / math.pi) * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return 1.0
    y = math.log1p(-w)
    if n <= 11:
        gamma = _poly(SW_G, float(n))
        if y >= gamma:
            return 1e-99
        return norm_sf(-math.log(gamma - y), _poly(SW_C3, float(n)), math.exp(_poly(SW_C4, float(n))))
    ln = math.log(n)
    return norm_sf(y, _poly(SW_C5, ln), math.exp(_poly(SW_C6, ln)))


def tail_weights(n: int, sum_m2: float) -> tuple[float, float, float]:
    """(divisor of the inner scores, weight of the outermost pair, weight of the
    next pair) from the sum of squared normal scores; a weight of 0 means that the
    pair is an inner one."""
    if n == 3:
        return math.inf, math.sqrt(0.5), 0.0
    m1 = norm_ppf((n - 0.375) / (n + 0.25))
    m2 = norm_ppf((n - 1.375) / (n + 0.25))
    root, u = math.sqrt(sum_m2), 1.0 / math.sqrt(n)
    a1 = _poly(SW_C1, u) + m1 / root
    if n <= 5:
        return math.sqrt((sum_m2 - 2 * m1 ** 2) / (1 - 2 * a1 ** 2)), a1, 0.0
    a2 = _poly(SW_C2, u) + m2 / root
    return math.sqrt((sum_m2 - 2 * m1 ** 2 - 2 * m2 ** 2) / (1 - 2 * a1 ** 2 - 2 * a2 ** 2)), a1, a2


@F.pandas_udf(T.StructType().add("w", "double").add("p", "double"))
def _w_and_p(n: pd.Series, sum_m2: pd.Series, sum_mx: pd.Series, sum_xx: pd.Series,
             x1: pd.Series, x2: pd.Series, y2: pd.Series, y1: pd.Series) -> pd.DataFrame:
    out = []
    for size, mm, mx, xx, lo1, lo2, hi2, hi1 in zip(n, sum_m2, sum_mx, sum_xx, x1, x2, y2, y1):
        if size < 3 or not xx > 0 or hi1 <= lo1:
            out.append((None, None))
            continue
        size = int(size)
        div, a1, a2 = tail_weights(size, mm)
        inner = mx - norm_ppf((size - 0.375) / (size + 0.25)) * (hi1 - lo1)
        total = a1 * (hi1 - lo1)
        if a2:
            inner -= norm_ppf((size - 1.375) / (size + 0.25)) * (hi2 - lo2)
            total += a2 * (hi2 - lo2)
        total += inner / div
        w = min(1.0, total * total / xx)
        out.append((w, shapiro_p(w, size)))
    return pd.DataFrame(out, columns=["w", "p"], dtype="float64")


#: Positions of one value that one row stands for at most.
SCORE_CHUNK = 1 << 16


@F.pandas_udf(T.StructType().add("s", "double").add("q", "double"))
def _score_sums(first: pd.Series, cnt: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Sum and sum of squares of the normal scores of positions first+1 .. first+cnt."""
    lengths = cnt.to_numpy(dtype="int64")
    starts = np.cumsum(lengths) - lengths
    step = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
    i = np.repeat(first.to_numpy(dtype="int64"), lengths) + step + 1
    m = norm_ppf_array((i - 0.375) / (np.repeat(n.to_numpy(dtype="float64"), lengths) + 0.25))
    return pd.DataFrame({"s": np.add.reduceat(m, starts), "q": np.add.reduceat(m * m, starts)})


def shapiro(df: DataFrame, columns: Sequence[str] | None = None,
            by: Sequence[str] = ()) -> DataFrame:
    """Shapiro-Wilk over all non-null values of each (group, column);
    ``is_normal`` = p > 0.05, ``p_extrapolated`` = more than 5,000 values, where
    the published approximation of p was not fitted. Adds skewness and kurtosis
    (agent form).

    W is a sum over order statistics: distinct values get their positions from
    ``running_counts``, a value's positions are cut into chunks, and the normal
    scores of each chunk are summed in Arrow batches. Every group ends as one row
    of sums, so no group meets in one task."""
    spark = df.sparkSession
    ship_package(spark)
    by = list(by)
    columns = list(columns) if columns is not None else numeric_columns(df, tuple(by))
    keys = [*by, "column"]
    distinct = long_values(df, columns, by).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("cnt"))
    placed = running_counts(distinct, keys, ["v"], "cnt")
    sizes = placed.groupBy(*keys).agg(F.sum("cnt").alias("n"),
                                      (F.sum(F.col("v") * F.col("cnt")) / F.sum("cnt")).alias("mean"))
    sizes = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], "n", "mean")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    rows = placed.join(sizes, on).withColumn("x", F.col("v") - F.col("mean"))
    chunk = F.lit(SCORE_CHUNK)
    cut = rows.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("cnt") - 1) / chunk)))) \
        .withColumn("__first", F.col("before") + F.col("__k") * chunk) \
        .withColumn("__c", F.least(chunk.cast("long"), F.col("cnt") - F.col("__k") * chunk))
    scored = cut.withColumn("m", _score_sums("__first", "__c", "n"))

    def at(pos):
        return F.max(F.when((F.col("before") < pos) & (pos <= F.col("before") + F.col("cnt")), F.col("x")))

    n = F.col("n")
    sums = scored.groupBy(*keys, "n").agg(
        F.sum("m.q").alias("mm"), F.sum(F.col("m.s") * F.col("x")).alias("mx"),
        F.sum(F.col("__c") * F.col("x") * F.col("x")).alias("xx"),
        at(F.lit(1)).alias("x1"), at(F.least(F.lit(2), n)).alias("x2"),
        at(F.greatest(n - 1, F.lit(1))).alias("y2"), at(n).alias("y1"))
    res = sums.withColumn("t", _w_and_p("n", "mm", "mx", "xx", "x1", "x2", "y2", "y1")).select(
        *keys, n.alias("sample_size"), F.when(~F.isnan("t.w"), F.col("t.w")).alias("statistic"),
        F.when(~F.isnan("t.p"), F.col("t.p")).alias("p_value"), (n > 5000).alias("p_extrapolated"))
    mom = numeric_moments(df, columns, by).select(*[F.col(k).alias(f"__{k}") for k in keys], "skewness", "kurtosis")
    return (res.join(mom, on, "left").drop(*[f"__{k}" for k in keys])
            .withColumn("is_normal", F.col("p_value") > 0.05))
