"""Kendall tau-b as a distributed job.

    tau_b = S / sqrt((n0 - n1)(n0 - n2)),  S = sum_{i<j} sgn(x_i - x_j) sgn(y_i - y_j)

n0 = n(n-1)/2 and the tie terms n1, n2 come from ``groupBy(value).count()``.
Rows first collapse to distinct (x, y) points with a count (hot values and
duplicates cost one row). A group of points larger than the target is split
in rank space: positions inside the group (running counts of its distinct values,
range partitioned) are cut into equal runs per axis; a value lying in more than one
run gets a bucket of its own. Then

* pairs in the same x-bucket      -> S of the points in that bucket
* same y-bucket, other x-bucket   -> S of (x-bucket, y) in that y-bucket
* different x- and y-buckets      -> S of the bucket grid, weighted by cell counts

Every pair falls in exactly one part (the second part gives 0 to pairs that
share an x-bucket); single-value buckets add 0 and are skipped. The parts are
new groups, split again while larger than the target (breadth first, one
union per level, checkpointed). Groups within the target run ``weighted_s``
(numpy, O(s log^2 s)) in ``applyInPandas``: no task ever holds more than the
target number of points.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_double, numeric_columns
from ..session import broadcast_row_limit, checkpoint_dir, ship_package
from .ranks import running_counts


def weighted_s(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """sum_{i<j} w_i w_j sgn(a_i - a_j) sgn(b_i - b_j) over weighted points."""
    if len(a) < 2:
        return 0.0
    # merge points sharing (a, b): their mutual pairs are ties (0)
    pts = pd.DataFrame({"a": a, "b": b, "w": w}).groupby(["a", "b"], sort=False)["w"].sum()
    a = pts.index.get_level_values(0).to_numpy(np.float64)
    b = pts.index.get_level_values(1).to_numpy(np.float64)
    w = pts.to_numpy(np.float64)
    n = len(a)
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order].astype(np.float64)
    rb = np.unique(b, return_inverse=True)[1].astype(np.int64)
    big = int(rb.max()) + 2
    pos = np.arange(n, dtype=np.int64)
    less = np.zeros(n)
    greater = np.zeros(n)
    width = 1
    while width < n:
        blk = pos // (2 * width)
        right = (pos // width) % 2 == 1
        if right.any():
            lk = blk[~right] * big + rb[~right]
            o = np.argsort(lk, kind="stable")
            lks = lk[o]
            cw = np.concatenate(([0.0], np.cumsum(w[~right][o])))
            rblk = blk[right]
            rk = rblk * big + rb[right]
            start = np.searchsorted(lks, rblk * big, "left")
            end = np.searchsorted(lks, rblk * big + big, "left")
            lt = np.searchsorted(lks, rk, "left")
            le = np.searchsorted(lks, rk, "right")
            less[right] += cw[lt] - cw[start]
            greater[right] += cw[end] - cw[le]
        width *= 2
    s_pos = float(np.sum(w * (less - greater)))
    # pairs sharing a: position order counted them as a_i < a_j; they must be 0.
    # Inside an a-group sorted by b every such pair has b_i <= b_j, and equal
    # (a, b) points are single weighted rows, so remove all cross-point pairs.
    grp = pd.DataFrame({"a": a, "w": w, "w2": w * w}).groupby("a", sort=False).sum()
    within = float(((grp["w"] ** 2 - grp["w2"]) / 2.0).sum())
    return s_pos - within


def _s_udf(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    s = weighted_s(pdf["a"].to_numpy(np.float64), pdf["b"].to_numpy(np.float64),
                   pdf["w"].to_numpy(np.float64))
    return pd.DataFrame({"g": [key[0]], "s": [s]})


def _group_s(points: DataFrame) -> DataFrame:
    ship_package(points.sparkSession)
    return points.select("g", *[F.col(c).cast("double").alias(c) for c in ("a", "b", "w")]) \
        .groupBy("g").applyInPandas(_s_udf, "g string, s double")


def _rank_buckets(pts: DataFrame, sizes: DataFrame, a: str, m: int, out: str) -> DataFrame:
    """Per group g: order points by ``a``, cut positions into m equal runs; a
    value of ``a`` lying in more than one run gets a bucket of its own.
    Bucket ids follow the order of ``a``: 2c for a range, 2c+1 for a single value.
    A value's first and last position follow from the counts of the values, so that
    only the distinct values are sorted, not the points."""
    values = pts.groupBy("g", a).agg(F.count(F.lit(1)).alias("__k"))
    width = F.ceil(F.col("__s") / F.lit(m))
    first = F.floor(F.col("before") / width).cast("long")
    last = F.floor((F.col("before") + F.col("__k") - 1) / width).cast("long")
    of = running_counts(values, ["g"], [a], "__k").join(sizes, "g") \
        .select("g", a, (2 * first + F.when(last > first, 1).otherwise(0)).alias(out))
    return pts.join(of, ["g", a])


def _total_s(points: DataFrame, target: int, m: int) -> dict[str, float]:
    """root -> sum of S over the root's groups, recursing on groups above ``target``.

    A group's name is its root (one column pair) and the path below it, so all
    pairs go through the same few jobs."""
    spark = points.sparkSession
    checkpoint_dir(spark)
    total: dict[str, float] = {}
    largest = None
    while True:
        sizes = points.groupBy("g").agg(F.count(F.lit(1)).alias("__s")).checkpoint(eager=True)
        big = sizes.where(F.col("__s") > target)
        n_big, top = big.agg(F.count(F.lit(1)), F.max("__s")).first()
        if n_big and n_big <= broadcast_row_limit(spark):
            big = F.broadcast(big)
        small = points.join(big, "g", "left_anti") if n_big else points
        root = F.substring_index("g", "/", 1).alias("root")
        for r in _group_s(small).groupBy(root).agg(F.sum("s").alias("s")).collect():  # one row a pair
            total[r["root"]] = total.get(r["root"], 0.0) + float(r["s"] or 0.0)
        if not n_big:
            return total
        if largest is not None and top >= largest:
            raise RuntimeError("a level of the Kendall decomposition made no group smaller")
        largest = top
        pts = points.join(big.select("g"), "g", "left_semi")
        pts = _rank_buckets(_rank_buckets(pts, big, "a", m, "ba"), big, "b", m, "bb").checkpoint(eager=True)  # read three times
        g = F.col("g")
        # pairs in one x-range, pairs in one y-range across x-ranges, and the grid
        sx = pts.where(F.col("ba") % 2 == 0).select(
            F.concat(g, F.lit("/x"), F.col("ba").cast("string")).alias("g"), "a", "b", "w")
        sy = pts.where(F.col("bb") % 2 == 0).select(
            F.concat(g, F.lit("/y"), F.col("bb").cast("string")).alias("g"),
            F.col("ba").cast("double").alias("a"), "b", "w")
        sc = pts.groupBy("g", "ba", "bb").agg(F.sum("w").alias("w")).select(
            F.concat(g, F.lit("/c")).alias("g"), F.col("ba").cast("double").alias("a"),
            F.col("bb").cast("double").alias("b"), "w")
        points = sx.unionByName(sy).unionByName(sc).checkpoint(eager=True)


def _pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], target_group: int, buckets: int | None) -> DataFrame:
    """(pair, n, s, n1, n2, tau) for the column pairs, numbered from 0, in one run."""
    m = buckets or max(2, int(math.sqrt(target_group) / 2))
    both = F.array(*[F.struct(F.lit(str(k)).alias("g"), clean_double(x).alias("a"), clean_double(y).alias("b"))
                     for k, (x, y) in enumerate(pairs)])
    checkpoint_dir(df.sparkSession)
    pts = df.select(F.explode(both).alias("p")).select("p.*").where(F.col("a").isNotNull() & F.col("b").isNotNull()) \
        .groupBy("g", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("w")).checkpoint(eager=True)
    totals = _total_s(pts, target_group, m)
    empty = [str(k) for k in range(len(pairs)) if str(k) not in totals]
    s_rows = df.sparkSession.createDataFrame([(g, float(round(s))) for g, s in totals.items()] + [(g, 0.0) for g in empty],
                                             "g string, s double")

    def ties(side: str, out: str) -> DataFrame:
        t = pts.groupBy("g", side).agg(F.sum("w").alias("t"))
        return t.groupBy("g").agg(F.sum(F.col("t") * (F.col("t") - 1) / 2.0).alias(out), F.sum("t").alias(f"n_{out}"))

    out = F.broadcast(s_rows).join(ties("a", "n1"), "g", "left").join(ties("b", "n2"), "g", "left")
    n = F.coalesce(F.col("n_n1"), F.lit(0.0))
    n0 = n * (n - 1) / 2.0
    den = F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2")))
    return out.select(F.col("g").cast("int").alias("pair"), n.cast("bigint").alias("n"), "s", "n1", "n2",
                      F.try_divide(F.col("s"), den).alias("tau"))


def kendall_pair(df: DataFrame, x: str, y: str, target_group: int = 50_000,
                 buckets: int | None = None) -> DataFrame:
    """One row: n, s, n1, n2, tau (tau-b on pairwise-complete rows).

    Groups above ``target_group`` distinct points are split recursively with
    ``buckets`` runs per axis (default: about sqrt(target)/2, so the grid of one
    group, at most (2 buckets + 1)^2 cells, fits the target itself)."""
    return _pairs(df, [(x, y)], target_group, buckets).drop("pair")


def kendall_long(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column1, column2, i, j, n, correlation) for i <= j: one scan for the
    diagonal, one run of the decomposition for all pairs."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    if len(columns) < 2:
        raise ValueError("a correlation takes two numeric columns or more")
    own = df.agg(*[x for k, c in enumerate(columns) for x in (
        F.count(clean_double(c)).alias(f"n{k}"), (F.min(clean_double(c)) < F.max(clean_double(c))).alias(f"d{k}"))])
    diagonal = own.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column1"), F.lit(c).alias("column2"), F.lit(k).alias("i"), F.lit(k).alias("j"),
        F.col(f"n{k}").alias("n"), F.when(F.col(f"d{k}"), F.lit(1.0)).alias("correlation"))
        for k, c in enumerate(columns)])).alias("x")).select("x.*")
    places = list(combinations(range(len(columns)), 2))
    found = _pairs(df, [(columns[i], columns[j]) for i, j in places], 50_000, None)
    names = df.sparkSession.createDataFrame([(k, columns[i], columns[j], i, j) for k, (i, j) in enumerate(places)],
                                            "pair int, column1 string, column2 string, i int, j int")
    return diagonal.unionByName(found.join(F.broadcast(names), "pair").select(
        "column1", "column2", "i", "j", "n", F.col("tau").alias("correlation")))
