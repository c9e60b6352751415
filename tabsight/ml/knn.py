"""Exact k-nearest-neighbour classification / regression.

Training rows are dealt to the nearest of a few pivots, and a pivot's rows are cut
into blocks of at most ``block``. A test row knows its distance to every pivot and
each pivot's radius: enough near cells to hold k training rows bound its k-th
distance, and by the triangle inequality only cells that this bound reaches can
hold a neighbour. So each training row is shipped once, each test row to the
blocks it may need. In a task a block's training rows stand first and its test
rows stream past them, some at a time, so that a task holds its block and a few arrays
of ``NUMBERS`` numbers, whatever the number of test rows.
Candidates are reduced with ``row_number() <= k`` (a partial WindowGroupLimit
before the shuffle) and voted; nothing passes through the driver but the pivots.

Rows have ids of their own (key order, then content), so repeated keys and any
type of key are right. Ties: nearer first, then the smaller training key; the vote
takes the most frequent label, then the smallest label.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import positions
from ..session import checkpoint_dir, ship_package


def _features(df: DataFrame, features: str | Sequence[str]):
    if isinstance(features, str):
        return F.transform(F.col(features), lambda x: x.cast("double"))
    return F.array(*[F.col(c).cast("double") for c in features])


#: Numbers that a temporary array of a task holds at most.
NUMBERS = 1_000_000


def _slices(batch: pa.RecordBatch, width: int):
    """Parts of a batch whose rows, times ``width``, stay below ``NUMBERS``."""
    step = max(1, NUMBERS // max(1, width))
    for s in range(0, batch.num_rows, step):
        yield batch.slice(s, step)


def _pair_distances(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows ``rows`` of ``a`` from the rows ``cols`` of ``b``."""
    out = np.empty(len(rows))
    step = max(1, NUMBERS // max(1, a.shape[1]))
    for s in range(0, len(rows), step):
        d = a[rows[s:s + step]] - b[cols[s:s + step]]
        out[s:s + step] = np.sqrt((d * d).sum(axis=1))
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` and ``b``, in slices."""
    out = np.empty((len(a), len(b)))
    step = max(1, NUMBERS // max(1, len(b) * a.shape[1]))
    for s in range(0, len(a), step):
        d = a[s:s + step, None, :] - b[None, :, :]
        out[s:s + step] = np.sqrt((d * d).sum(axis=2))
    return out


def _closest(a: np.ndarray, b: np.ndarray, squares: np.ndarray, ids: np.ndarray, k: int):
    """(rows of ``a``, rows of ``b``, distances): the k nearest rows of ``b`` for each row of
    ``a``, ties by ``ids``. The matrix product |a|² + |b|² - 2 a.b names the rows that may be
    among them, its rounding allowed for; these are measured and sorted."""
    own = (a * a).sum(axis=1)
    rough = own[:, None] + squares - 2 * (a @ b.T)
    if np.isfinite(rough).all():
        bound = np.partition(rough, k - 1, axis=1)[:, k - 1] + 1e-9 * (own + squares.max())
        rows, cols = np.nonzero(rough <= bound[:, None])
    else:
        rows, cols = np.nonzero(np.ones(rough.shape, bool))
    del rough
    dist = _pair_distances(a, b, rows, cols)
    order = np.lexsort((ids[cols], dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    first = np.searchsorted(rows, np.arange(len(a)))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], cols[keep], dist[keep]


def _vectors(column) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(width) != 1 or width[0] is None:
        raise ValueError("all feature vectors must have the same length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width[0])


def _near_pivots(points: np.ndarray):
    """The pivot nearest to each row of x and its distance."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            d = _distances(_vectors(b.column("x")), points)
            cell = d.argmin(axis=1)
            b = b.append_column("cell", pa.array(cell, pa.int32()))
            yield b.append_column("far", pa.array(d[np.arange(len(d)), cell], pa.float64()))
    return run


def _reached(points: np.ndarray, radius: np.ndarray, count: np.ndarray, k: int):
    """The cells of each test row that may hold one of its k nearest rows."""
    def run(batches):
        for batch in batches:
            for b in _slices(batch, points.size):  # a row may go to every cell
                d = _distances(_vectors(b.column("x")), points)
                upper = d + radius
                order = np.argsort(upper, axis=1, kind="stable")
                enough = np.cumsum(count[order], axis=1) >= k
                at = np.where(enough.any(axis=1), enough.argmax(axis=1), len(points) - 1)
                bound = np.take_along_axis(upper, order, axis=1)[np.arange(len(d)), at]
                slack = 1e-9 * (1 + np.abs(bound))
                hit = (d - radius <= (bound + slack)[:, None]) & (count > 0)
                rows, cells = np.nonzero(hit)
                out = b.take(pa.array(rows))
                yield out.append_column("cell", pa.array(cells, pa.int32()))
    return run


def _nearest(k: int):
    """k candidates of each test row from the training rows of its block, which come first."""
    def run(batches):
        group, held = None, []
        train = None
        for b in batches:
            cells, subs, sides = (b.column(c).to_numpy() for c in ("cell", "sub", "side"))
            cut = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (subs[1:] != subs[:-1]) | (sides[1:] != sides[:-1])])
            for s, e in zip(cut, [*cut[1:], b.num_rows]):
                if (cells[s], subs[s]) != group:
                    group, held, train = (cells[s], subs[s]), [], None
                part = b.slice(s, e - s)
                if sides[s] == 0:
                    held.append(part)
                    continue
                if train is None:
                    if not held:
                        continue
                    t = pa.Table.from_batches(held)
                    x = _vectors(t.column("x"))
                    train = (x, (x * x).sum(axis=1), t.column("id").to_numpy(), t.column("y").to_numpy())
                    held = []
                x, squares, ids, ys = train
                for some in _slices(part, len(ids)):
                    rows, cols, dist = _closest(_vectors(some.column("x")), x, squares, ids, min(k, len(ids)))
                    yield pa.RecordBatch.from_arrays(
                        [some.column("id").take(pa.array(rows)), pa.array(ids[cols]), pa.array(ys[cols]), pa.array(dist)],
                        names=["test_id", "train_id", "y", "dist"])
    return run


def _numbered(df: DataFrame, key: str, features, label: str | None) -> DataFrame:
    """(id, key, x[, y]): ids from 0 in key order; equal keys by content, then place."""
    x = _features(df, features).alias("x")
    cols = [F.col(key).alias("k"), x] + ([F.col(label).cast("double").alias("y")] if label else [])
    rows = df.select(*cols).withColumn("__c", F.xxhash64("x")).withColumn("__t", F.monotonically_increasing_id())
    checkpoint_dir(df.sparkSession)
    return positions(rows.checkpoint(eager=True), ["k", "__c", "__t"]) \
        .withColumn("id", F.col("pos") - 1).drop("pos", "__c", "__t").checkpoint(eager=True)


def knn_predict(train: DataFrame, test: DataFrame, key: str, features: str | Sequence[str],
                label: str, k: int = 5, weights: str = "uniform", task: str = "classification",
                block: int = 4096, pivots: int = 64) -> DataFrame:
    """Predictions for every test row: (key, prediction)."""
    spark = train.sparkSession
    ship_package(spark)
    tr, te = _numbered(train, key, features, label), _numbered(test, key, features, None)
    n = tr.agg(F.max("id") + 1).first()[0]
    if n is None or te.isEmpty():
        return test.select(F.col(key), F.lit(None).cast("double").alias("prediction")).limit(0)
    # at most ``pivots`` rows, evenly spaced in key order
    m = min(pivots, -(-n // block))
    chosen = tr.where(F.col("id") % F.lit(-(-n // m)) == 0).select("x").collect()
    points = np.unique(np.array([r[0] for r in chosen], dtype=np.float64), axis=0)
    near = T.StructType([*tr.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
    celled = tr.mapInArrow(_near_pivots(points), near)
    celled = positions(celled.checkpoint(eager=True), ["id"], by=["cell"]) \
        .withColumn("sub", ((F.col("pos") - 1) / block).cast("long")).drop("pos")
    cells = {r["cell"]: r for r in celled.groupBy("cell").agg(
        F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"), F.max("sub").alias("top")).collect()}  # one row a pivot
    radius = np.array([cells[c]["radius"] if c in cells else 0.0 for c in range(len(points))])
    count = np.array([cells[c]["n"] if c in cells else 0 for c in range(len(points))])
    tops = F.element_at(F.create_map(*[F.lit(v) for c, r in cells.items() for v in (c, r["top"])]), F.col("cell"))
    reach = T.StructType([*te.select("id", "x").schema.fields, T.StructField("cell", T.IntegerType())])
    asked = te.select("id", "x").mapInArrow(_reached(points, radius, count, k), reach) \
        .withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), tops)))
    both = celled.select("cell", "sub", F.lit(0).alias("side"), "id", "x", "y").unionByName(
        asked.select("cell", "sub", F.lit(1).alias("side"), "id", "x", F.lit(None).cast("double").alias("y")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cand = both.repartition(parts, "cell", "sub").sortWithinPartitions("cell", "sub", "side", "id") \
        .mapInArrow(_nearest(k), "test_id long, train_id long, y double, dist double")
    w = Window.partitionBy("test_id").orderBy("dist", "train_id")
    near = cand.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    if task == "regression":
        if weights == "distance":
            wt = F.when(F.col("dist") == 0, F.lit(1e300)).otherwise(1.0 / F.col("dist"))
            pred = near.groupBy("test_id").agg((F.sum(wt * F.col("y")) / F.sum(wt)).alias("prediction"))
        else:
            pred = near.groupBy("test_id").agg(F.avg("y").alias("prediction"))
    else:
        wt = (F.when(F.col("dist") == 0, F.lit(1e300)).otherwise(1.0 / F.col("dist"))
              if weights == "distance" else F.lit(1.0))
        votes = near.groupBy("test_id", "y").agg(F.sum(wt).alias("votes"))
        wv = Window.partitionBy("test_id").orderBy(F.desc("votes"), "y")
        pred = (votes.withColumn("r", F.row_number().over(wv)).where(F.col("r") == 1)
                .select("test_id", F.col("y").alias("prediction")))
    return te.select(F.col("id").alias("test_id"), F.col("k").alias(key)).join(pred, "test_id").drop("test_id")
