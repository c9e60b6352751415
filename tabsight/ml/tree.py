"""Exact decision trees (E7): thresholds between any two neighbouring values.

The measure of a set of rows is a vector of sums: the row count, then a count for each
class, or the sum of the target. A split is best when it makes the sum over both sides of
|sums|² / count greatest, which is the least Gini impurity, or the least squared error.

Large nodes are split by Spark, a level at a time. Quantiles cut each feature into buckets,
so a column of any size is spread out. A first scan adds up the sums of each (node, feature,
bucket), so those before each bucket are known. A second one sums rows by (node, feature,
value) and deals these lists to their buckets, in one shuffle; there running sums are added,
every place between two values is scored, and the driver receives the best split of each
node. Nothing is written between levels. A node whose values fit in a
task (``VALUES``) is shipped there once with all its rows, and its subtree grown in full, to
any depth.

Ties go to the lowest feature, then to the lowest threshold. ``min_samples_split`` is the
least number of rows that a node needs to be split. A node of one class, or of equal
targets, is a leaf; any other is split as long as a feature has two values."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from ..sources.ingest import scratch_path

#: Values (rows by features) of a node that one task grows.
VALUES = 4_000_000
#: Values (rows by features) that a task sums up before it sends them, and numbers of a level's sums.
CHUNK, SUMS = 1_000_000, 2_000_000


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "tree")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measures(y: np.ndarray, classes: int) -> np.ndarray:
    """(rows, 1 + classes or 2): count and class indicators, or count, target and its square."""
    if classes:
        return np.concatenate((np.ones((len(y), 1)), y[:, None] == np.arange(classes)), axis=1)
    return np.stack((np.ones(len(y)), y, y * y), axis=1)


def is_pure(total, classes: int) -> bool:
    if classes:
        return max(total[1:]) == total[0]
    return total[2] / total[0] - (total[1] / total[0]) ** 2 <= 1e-12 * max(1.0, total[2] / total[0])


def _rounded(gain):
    """To ten digits: sums in another order differ in the last ones, which must not decide."""
    unit = 10.0 ** np.ceil(np.log10(np.maximum(np.abs(gain), 1e-290)))
    return np.round(gain / unit, 10) * unit


def threshold(low: float, high: float) -> float:
    middle = low + (high - low) / 2
    return middle if low <= middle < high else low


class Nodes:
    """A tree as lists: inner nodes with feature and threshold, leaves with left -1."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.total, self.gain = [], [], [], [], [], []

    def add(self, total) -> int:
        for column, v in ((self.feature, 0), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.gain, 0.0)):
            column.append(v)
        self.total.append([float(v) for v in total])
        return len(self.total) - 1

    def split(self, node: int, feature: int, cut: float, low, high, gain: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node], self.right[node] = self.add(low), self.add(high)
        return self.left[node], self.right[node]

    def graft(self, node: int, other: Nodes) -> None:
        """Put the tree ``other`` in place of a leaf."""
        at = [node, *range(len(self.total), len(self.total) + len(other.total) - 1)]
        for k in range(1, len(other.total)):
            self.add(other.total[k])
        for k, place in enumerate(at):
            if other.left[k] >= 0:
                self.feature[place], self.cut[place], self.gain[place] = other.feature[k], other.cut[k], other.gain[k]
                self.left[place], self.right[place] = at[other.left[k]], at[other.right[k]]

    def of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of a matrix."""
        feature, cut, left, right = (np.array(v) for v in (self.feature, self.cut, self.left, self.right))
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            rows = rows[left[node[rows]] >= 0]
            at = node[rows]
            node[rows] = np.where(x[rows, feature[at]] <= cut[at], left[at], right[at])
        return node


def best_split(x: np.ndarray, m: np.ndarray):
    """(score, feature, threshold) of the best split of a node's rows, or None; ``m`` holds
    counts and the sums that are scored."""
    best = None
    total = m.sum(axis=0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        low = np.cumsum(m[order], axis=0)[at]
        high = total - low
        score = _rounded((low[:, 1:] ** 2).sum(axis=1) / low[:, 0] + (high[:, 1:] ** 2).sum(axis=1) / high[:, 0])
        i = int(score.argmax())
        if best is None or score[i] > best[0]:
            best = (float(score[i]), f, threshold(float(v[at[i]]), float(v[at[i] + 1])))
    return best


def grow(x: np.ndarray, m: np.ndarray, classes: int, depth: float, least: int) -> Nodes:
    """The subtree of a node's rows, with ``depth`` levels at most below it."""
    out = Nodes()
    open_ = [(out.add(m.sum(axis=0)), np.arange(len(x)), 0)]
    while open_:
        node, rows, level = open_.pop()
        if level >= depth or len(rows) < max(2, least) or is_pure(out.total[node], classes):
            continue
        found = best_split(x[rows], m[rows] if classes else m[rows][:, :2])
        if found is None:
            continue
        _, f, cut = found
        go = x[rows, f] <= cut
        low, high = m[rows[go]].sum(axis=0), m[rows[~go]].sum(axis=0)
        left, right = out.split(node, f, cut, low, high, _decrease(out.total[node], low, high, classes))
        open_ += [(left, rows[go], level + 1), (right, rows[~go], level + 1)]
    return out


def _spread(total, classes: int) -> float:
    """Impurity times count: Gini, or squared error."""
    if classes:
        return total[0] - sum(v * v for v in total[1:]) / total[0]
    return total[2] - total[1] ** 2 / total[0]


def _decrease(total, low, high, classes: int) -> float:
    return max(0.0, float(_spread(total, classes) - _spread(low, classes) - _spread(high, classes)))


class ExactTree:
    """``fit(df)`` on (features vector, label). Missing feature values count as larger than
    all others."""

    def __init__(self, kind: str, max_depth: int | None = None, min_samples_split: int = 2, features_col: str = "features",
                 label_col: str = "label"):
        if kind not in ("regression", "classification"):
            raise ValueError(f"unknown problem type {kind!r}")
        if min_samples_split < 2:
            raise ValueError("min_samples_split must be 2 or more")
        self.kind, self.depth, self.least = kind, math.inf if max_depth is None else max_depth, min_samples_split
        self.features_col, self.label_col = features_col, label_col

    def fit(self, df: DataFrame) -> ExactTreeModel:
        spark = df.sparkSession
        ship_package(spark)
        x = F.transform(vector_to_array(self.features_col), lambda v: F.when(F.isnan(v), F.lit(math.inf)).otherwise(v))
        rows = _stored(df.select(x.alias("x"), F.col(self.label_col).cast("double").alias("y")))
        labels = sorted(r[0] for r in rows.select("y").distinct().collect()) if self.kind == "classification" else []  # one row a class
        d, shift = rows.agg(F.max(F.size("x")), F.avg("y")).first()
        if d is None:
            raise ValueError("no rows to fit")
        if labels:
            code = F.create_map(*[F.lit(v) for i, c in enumerate(labels) for v in (c, float(i))])
            rows, shift = rows.withColumn("y", code[F.col("y")]), 0.0
        else:  # centred, so that squares keep their digits
            rows = rows.withColumn("y", F.col("y") - F.lit(shift))
        k = len(labels)
        total = rows.agg(F.count(F.lit(1)), *([F.count_if(F.col("y") == i) for i in range(k)] if k else [F.sum("y"), F.sum(F.col("y") ** 2)])).first()
        tree = Nodes()
        level, depth = [tree.add(total)], 0
        small: list[tuple[int, int]] = []  # nodes that a task grows, and their depth
        cuts: list[np.ndarray] | None = None
        while level:
            open_ = [n for n in level if depth < self.depth and tree.total[n][0] >= self.least and not is_pure(tree.total[n], k)]
            small += [(n, depth) for n in open_ if tree.total[n][0] * d <= VALUES]
            large = [n for n in open_ if tree.total[n][0] * d > VALUES]
            level, depth = [], depth + 1
            if large and cuts is None:
                cuts = self._cuts(rows, d)
            for node, f, cut, low in self._splits(rows, tree, large, k, cuts):
                high = [a - b for a, b in zip(tree.total[node], low, strict=True)]
                level += tree.split(node, f, cut, low, high, _decrease(tree.total[node], low, high, k))
        for node, sub in self._subtrees(rows, tree, small, k):
            tree.graft(node, sub)
        return ExactTreeModel(tree, labels, float(shift), d, self.features_col)

    @staticmethod
    def _cuts(rows: DataFrame, d: int) -> list[np.ndarray]:
        """Ascending borders of the buckets of each feature, about a partition each."""
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        grid = [i / parts for i in range(1, parts)] or [0.5]
        found = rows.agg(*[F.percentile_approx(F.col("x")[f], grid, 20 * len(grid)).alias(f"c{f}") for f in range(d)]).first()
        return [np.unique(np.array(c, float)) for c in found]

    def _splits(self, rows: DataFrame, tree: Nodes, large: list[int], k: int, cuts: list[np.ndarray]):
        """(node, feature, threshold, sums left) of the best split of each large node."""
        if not large:
            return
        width = 1 + (k or 2)
        buckets = max(len(c) for c in cuts) + 1
        step = max(1, SUMS // (len(cuts) * buckets * (width + 1)))  # nodes whose sums of all buckets fit in a task
        for s in range(0, len(large), step):
            yield from self._some_splits(rows, tree, np.array(large[s:s + step]), k, cuts, buckets)

    def _some_splits(self, rows: DataFrame, tree: Nodes, large: np.ndarray, k: int, cuts: list[np.ndarray], buckets: int):
        import pyarrow as pa
        d, width, spark = len(cuts), 1 + (k or 2), rows.sparkSession
        place = np.full(len(tree.total), -1)
        place[large] = np.arange(len(large))
        names = [f"m{i}" for i in range(width)]

        def lists(batches):
            """(places, values, sums) for each feature of many rows: one line for each place and
            value; a place is (feature, bucket, node) as one number."""
            held, n = [], 0
            for b in itertools.chain(batches, [None]):
                if b is not None and b.num_rows:
                    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
                    node = place[tree.of(x)]
                    keep = node >= 0
                    held.append((x[keep], node[keep], measures(b.column("y").to_numpy()[keep], k)))
                    n += int(keep.sum()) * d
                if n and (b is None or n >= CHUNK):
                    x, node, m = (np.concatenate(v) for v in zip(*held, strict=True))
                    held, n = [], 0
                    for f in range(d):
                        at = (f * buckets + np.searchsorted(cuts[f], x[:, f], side="left")) * len(large) + node
                        order = np.lexsort((x[:, f], at))
                        v, at = x[order, f], at[order]
                        first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (at[1:] != at[:-1])])
                        yield at[first], v[first], np.add.reduceat(m[order], first, axis=0)

        def bucket_sums(batches):
            sums, heads = np.zeros((d * buckets * len(large), width)), np.full(d * buckets * len(large), np.nan)
            for at, v, m in lists(batches):
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                sums[at[first]] += np.add.reduceat(m, first, axis=0)
                heads[at[first]] = np.fmin(heads[at[first]], v[first])
            some = np.flatnonzero(sums[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(heads[some]), *[pa.array(sums[some, i]) for i in range(width)]],
                                             names=["at", "head", *names])

        columns = ", ".join(f"{n} double" for n in names)
        found = rows.mapInArrow(bucket_sums, f"at long, head double, {columns}").groupBy("at") \
            .agg(F.min("head").alias("head"), *[F.sum(n).alias(n) for n in names]).collect()  # a row a node, feature and bucket
        sums, heads = np.zeros((d, buckets, len(large), width)), np.full((d, buckets, len(large)), np.nan)
        for r in found:
            sums.reshape(-1, width)[r["at"]], heads.reshape(-1)[r["at"]] = [r[n] for n in names], r["head"]
        before = np.cumsum(sums, axis=1) - sums
        following = np.full(heads.shape, np.nan)  # the first value of the node in a later bucket
        for i in range(buckets - 2, -1, -1):
            following[:, i] = np.where(np.isnan(heads[:, i + 1]), following[:, i + 1], heads[:, i + 1])
        total = np.array([tree.total[n] for n in large])
        shared = spark.sparkContext.broadcast((before.reshape(-1, width), following.reshape(-1), total))

        def dealt(batches):
            for at, v, m in lists(batches):
                yield pa.RecordBatch.from_arrays([pa.array(at // len(large)), pa.array(at), pa.array(v), *[pa.array(m[:, i]) for i in range(width)]],
                                                 names=["bucket", "at", "value", *names])

        def scored(batches):
            """The best split of each place; lines come sorted by place and value."""
            before, following, total = shared.value
            last, parts = None, []

            def best():
                v, m = (np.concatenate(x) for x in zip(*parts, strict=True))
                first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
                v, low = v[first], before[last] + np.cumsum(np.add.reduceat(m, first, axis=0), axis=0)
                after = np.r_[v[1:], following[last]]
                v, low, after = (x[~np.isnan(after)] for x in (v, low, after))
                if not len(v):
                    return None
                used = slice(1, None) if k else slice(1, 2)
                high = total[last % len(large)] - low
                score = _rounded((low[:, used] ** 2).sum(axis=1) / low[:, 0] + (high[:, used] ** 2).sum(axis=1) / high[:, 0])
                i = int(score.argmax())
                out = [last % len(large), score[i], -(last // len(large) // buckets), -v[i], after[i], *low[i]]
                return pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=["node", "score", "f", "v", "after", *names])

            for b in itertools.chain(batches, [None]):
                at = b.column("at").to_numpy() if b is not None else np.empty(0)
                if b is not None and len(at):
                    v, m = b.column("value").to_numpy(), np.stack([b.column(n).to_numpy() for n in names], axis=1)
                edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]) if len(at) else []
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    if parts and at[i] != last:
                        if (row := best()) is not None:
                            yield row
                        parts = []
                    last = int(at[i])
                    parts.append((v[i:j], m[i:j]))
                if b is None and parts and (row := best()) is not None:
                    yield row

        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        top = rows.mapInArrow(dealt, f"bucket long, at long, value double, {columns}").repartition(parts, "bucket").drop("bucket") \
            .sortWithinPartitions("at", "value").mapInArrow(scored, f"node long, score double, f long, v double, after double, {columns}") \
            .groupBy("node").agg(F.max(F.struct("score", "f", "v", "after", *names)).alias("s"))
        try:
            out = top.collect()  # a row a node
        finally:
            shared.destroy()
        for r in out:
            s = r["s"]
            yield int(large[r["node"]]), -s["f"], threshold(-s["v"], s["after"]), [s[n] for n in names]

    def _subtrees(self, rows: DataFrame, tree: Nodes, small: list[tuple[int, int]], k: int):
        """(node, subtree) for each small node, grown in a task."""
        if not small:
            return
        left = {n: self.depth - depth for n, depth in small}
        least = self.least

        def placed(batches):
            import pyarrow as pa
            for b in batches:
                if b.num_rows:
                    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    node = tree.of(x)
                    at = np.flatnonzero(np.isin(node, list(left)))
                    some = b.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(node[at], pa.int32()), some.column("x"), some.column("y")], names=["node", "x", "y"])

        def grown(batches):
            import pickle

            import pyarrow as pa

            def done(node, parts):
                x, y = (np.concatenate(v) for v in zip(*parts, strict=True))
                order = np.lexsort((y, *x.T))  # sums don't depend on the order of arrival
                sub = grow(x[order], measures(y[order], k), k, left[node], least)
                return pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([pickle.dumps(sub)])], names=["node", "tree"])

            last, parts = None, []
            for b in batches:
                node = b.column("node").to_numpy()
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                y = b.column("y").to_numpy()
                edges = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True]) if len(node) else []
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    if parts and node[i] != last:
                        yield done(last, parts)
                        parts = []
                    last = int(node[i])
                    parts.append((x[i:j], y[i:j]))
            if parts:
                yield done(last, parts)

        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.mapInArrow(placed, "node int, x array<double>, y double").repartition(parts, "node").sortWithinPartitions("node")
        import pickle
        for r in dealt.mapInArrow(grown, "node int, tree binary").collect():  # the model itself
            yield r["node"], pickle.loads(r["tree"])


class ExactTreeModel:
    """``transform`` adds ``prediction``."""

    def __init__(self, tree: Nodes, labels: list[float], shift: float, d: int, features_col: str):
        self.tree, self.labels, self.d, self.features_col = tree, labels, d, features_col
        total = np.array(tree.total)
        self.value = np.array(labels)[total[:, 1:].argmax(axis=1)] if labels else total[:, 1] / total[:, 0] + shift

    @property
    def depth(self) -> int:
        at = [0] * len(self.tree.total)
        for node, (a, b) in enumerate(zip(self.tree.left, self.tree.right, strict=True)):
            if a >= 0:
                at[a] = at[b] = at[node] + 1
        return max(at)

    @property
    def weights(self) -> list[float]:
        """Decrease of impurity by feature, as shares."""
        out = np.zeros(self.d)
        for f, gain, left in zip(self.tree.feature, self.tree.gain, self.tree.left, strict=True):
            out[f] += gain if left >= 0 else 0.0
        return (out / (out.sum() or 1.0)).tolist()

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.tree.of(np.where(np.isnan(x), math.inf, x))]

    def transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)
        plain = [c for c in df.columns if c != self.features_col]  # vectors don't cross Arrow
        schema = T.StructType([*[df.schema[c] for c in plain], T.StructField("prediction", T.DoubleType())])

        def run(batches):
            import pyarrow as pa
            model = shared.value
            for b in batches:
                x = b.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, model.d)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in plain], pa.array(model.predict(x), pa.float64())], names=schema.names)

        return df.select(*plain, vector_to_array(self.features_col).alias("__x")).mapInArrow(run, schema)
