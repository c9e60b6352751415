"""Gradient tree boosting with second-order statistics (E5, and E4 for several classes).

Each round adds one regression tree (squared loss, two classes) or one for each class
(softmax, from shared probabilities). Trees grow level by level. A level is one job: every
task sums gradients and hessians of its rows by (class, node, feature, bin); the histograms
are added by (class, feature) in a shuffle; the reducers find each node's best split of
their feature; the driver receives a row for each class, node and feature, and keeps the
best. No row, and no histogram, reaches the driver.

Rows are kept as binned blocks in the checkpoint folder: up to ``BLOCK_ROWS`` rows with one
two-byte bin for each feature, the label and the scores so far. Trees since the blocks were
written are applied to the scores inside the tasks; after ``FOLD`` rounds blocks are written
anew. So a lost executor costs its tasks only, and lineage stays short.

``Newton`` is the regularised second-order method: gain of a split (GL²/(HL+λ) +
GR²/(HR+λ) - G²/(H+λ)) / 2 - γ, leaves -G/(H+λ), child hessians of at least
``min_child_weight``, and for missing values the side of the larger gain. ``Residual``
splits by squared error of the residuals and gives leaves one Newton step."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from ..sources.ingest import scratch_path

BLOCK_ROWS, FOLD = 32_768, 10
#: Values (rows by features) that a task should have at least. Each task sends the histograms of
#: all open nodes, so there is at most one a core: what a level shuffles doesn't grow with the rows.
TASK_VALUES = 4_000_000


@dataclass
class Tree:
    """Nodes of a tree: inner ones with feature, bin, threshold, side of missing values
    and children; leaves with a value (child -1)."""
    feature: list = field(default_factory=lambda: [0])
    bin: list = field(default_factory=lambda: [0])
    threshold: list = field(default_factory=lambda: [0.0])
    missing_left: list = field(default_factory=lambda: [False])
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, threshold: float, missing_left: bool, gain: float) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.threshold[node] = feature, bin_, threshold
        self.missing_left[node], self.gain[node] = missing_left, gain
        for name in ("left", "right"):
            getattr(self, name)[node] = len(self.value)
            for column, fresh in (("feature", 0), ("bin", 0), ("threshold", 0.0), ("missing_left", False), ("left", -1), ("right", -1),
                                  ("value", 0.0), ("gain", 0.0)):
                getattr(self, column).append(fresh)
        return self.left[node], self.right[node]

    def nodes_of(self, x, n: int, by_bin: bool, missing: int = 0):
        """The node of each of ``n`` rows; ``x[f]`` are the bins (or values) of feature f."""
        node = np.zeros(n, np.int64)
        feature, left, right = (np.array(v) for v in (self.feature, self.left, self.right))
        cut, side = np.array(self.bin if by_bin else self.threshold), np.array(self.missing_left)
        rows = np.arange(n)
        while len(rows):
            at = node[rows]
            inner = left[at] >= 0
            rows, at = rows[inner], at[inner]
            v = x[feature[at], rows]
            gone = v == missing if by_bin else np.isnan(v)
            go = np.where(gone, side[at], v <= cut[at])
            node[rows] = np.where(go, left[at], right[at])
        return node


def cut_points(df: DataFrame, columns: str, d: int, max_bins: int) -> list[np.ndarray]:
    """Ascending thresholds of each feature (element of an array column): midpoints
    between all values where there are at most ``max_bins``, else quantiles."""
    values = df.select(F.posexplode(columns).alias("i", "v")).where(~F.isnan("v"))  # drops NULL too
    rough = {r["i"]: r["n"] for r in values.groupBy("i").agg(F.approx_count_distinct("v", 0.02).alias("n")).collect()}  # a row a feature
    few = [i for i, n in rough.items() if n <= 1.1 * max_bins]
    grid = [k / max_bins for k in range(1, max_bins)]
    out = [np.empty(0)] * d
    for r in values.where(F.col("i").isin(few)).groupBy("i").agg(F.collect_set("v").alias("v")).collect():  # about max_bins values each
        v = np.unique(np.array(r["v"], float))
        out[r["i"]] = (v[1:] + v[:-1]) / 2
    if len(few) < len(rough):
        quantiles = values.where(~F.col("i").isin(few)).groupBy("i").agg(F.percentile_approx("v", grid, 100 * max_bins).alias("v"))
        for r in quantiles.collect():
            out[r["i"]] = np.unique(np.array(r["v"], float))
    return out


class _Loss:
    def __init__(self, kind: str, classes: int):
        self.kind, self.k = kind, classes if kind == "softmax" else 1

    def __call__(self, score, y, newton: bool):
        """(gradients, hessians) as (classes, rows)."""
        if self.kind == "squared":
            return score - y, np.ones_like(score)
        if self.kind == "logistic":
            p = 1 / (1 + np.exp(-score))
            return p - y, p * (1 - p)
        z = np.exp(score - score.max(axis=0))
        p = z / z.sum(axis=0)
        g = p - (y == np.arange(self.k)[:, None])
        return (g, 2 * p * (1 - p)) if newton else (g, np.abs(g) * (1 - np.abs(g)))


@dataclass
class _Settings:
    loss: _Loss
    newton: bool
    reg_lambda: float
    gamma: float
    min_child_weight: float
    rate: float
    missing: int  # the bin of missing values

    def gains(self, g, h):
        """(gain, missing_left) for histograms (nodes, bins): a split after each bin. For the
        squared error of the residuals, counts take the hessians' place."""
        lam, least = (self.reg_lambda, self.min_child_weight) if self.newton else (0.0, 1.0)
        all_g, all_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
        gone_g, gone_h = g[:, self.missing:], h[:, self.missing:]
        best, side = None, None

        def part(a, b):
            return np.where(b + lam > 0, a * a / np.where(b + lam > 0, b + lam, 1), 0)
        low_g, low_h = np.cumsum(g[:, :self.missing], axis=1)[:, :-1], np.cumsum(h[:, :self.missing], axis=1)[:, :-1]
        for left in (False, True):
            gl, hl = (low_g + gone_g, low_h + gone_h) if left else (low_g, low_h)
            gr, hr = all_g - gl, all_h - hl
            gain = part(gl, hl) + part(gr, hr) - part(all_g, all_h)
            gain = gain / 2 - self.gamma if self.newton else gain
            gain = np.where((hl >= least) & (hr >= least) & (hl > 0) & (hr > 0), gain, -np.inf)
            # sums in another order differ in the last digits, which must not decide
            unit = 10.0 ** np.ceil(np.log10(np.maximum(part(all_g, all_h) + np.abs(np.where(np.isfinite(gain), gain, 0)).max(axis=1, keepdims=True), 1e-9)))
            gain = np.round(gain / unit, 10) * unit
            best, side = (gain, np.zeros(gain.shape, bool)) if best is None else (np.maximum(best, gain), gain > best)
        return best, side

    def leaf(self, g: float, h: float) -> float:
        if self.newton:
            return -self.rate * g / (h + self.reg_lambda) if h + self.reg_lambda > 0 else 0.0
        shrink = (self.loss.k - 1) / self.loss.k if self.loss.kind == "softmax" else 1.0
        return -self.rate * shrink * g / h if h > 1e-150 else 0.0


def _unpacked(row, d: int, k: int):
    n = len(row["y"]) // 8
    return (np.frombuffer(row["x"], "<u2").reshape(d, n), np.frombuffer(row["y"]), np.frombuffer(row["score"]).reshape(k, n))


def _after(x, score, rounds: list[list[Tree]], missing: int):
    """Scores with the trees of ``rounds`` added."""
    out = score.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[k] += np.array(tree.value)[tree.nodes_of(x, x.shape[1], True, missing)]
    return out


class BoostedTrees:
    """``fit(df)`` on (features vector, label)."""

    def __init__(self, kind: str, rounds: int = 100, depth: int = 6, rate: float = 0.1, newton: bool = True, reg_lambda: float = 1.0,
                 gamma: float = 0.0, min_child_weight: float = 1.0, max_bins: int = 256, features_col: str = "features",
                 label_col: str = "label"):
        if kind not in ("regression", "classification"):
            raise ValueError(f"unknown problem type {kind!r}")
        if not 1 < max_bins < 60_000:
            raise ValueError("max_bins must be from 2 to 60,000")
        self.kind, self.rounds, self.depth, self.rate, self.newton = kind, rounds, depth, rate, newton
        self.reg_lambda, self.gamma, self.min_child_weight, self.max_bins = reg_lambda, gamma, min_child_weight, max_bins
        self.features_col, self.label_col = features_col, label_col

    def fit(self, df: DataFrame) -> BoostedModel:
        spark = df.sparkSession
        ship_package(spark)
        rows = self._stored(df.select(vector_to_array(self.features_col).alias("x"), F.col(self.label_col).cast("double").alias("y")))
        n, d, mean = rows.agg(F.count(F.lit(1)), F.max(F.size("x")), F.avg("y")).first()
        if not n:
            raise ValueError("no rows to fit")
        classes: list[float] = []
        if self.kind == "classification":
            classes = sorted(r[0] for r in rows.select("y").distinct().collect())  # one row a class
        loss = _Loss("squared" if self.kind == "regression" else "logistic" if len(classes) <= 2 else "softmax", len(classes))
        cuts = cut_points(rows, "x", d, self.max_bins)
        bins = max(2, *(len(c) + 1 for c in cuts))
        s = _Settings(loss, self.newton, self.reg_lambda, self.gamma, self.min_child_weight, self.rate, bins)
        base = self._base(rows, loss, classes, mean, n)
        tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-n * d // TASK_VALUES)))  # coalesce never adds partitions
        blocks = self._blocks(rows.coalesce(tasks), d, cuts, classes, loss.k, base, bins)
        state = self._loaded(blocks, d, loss.k)
        rounds: list[list[Tree]] = []
        for t in range(self.rounds if d else 0):
            if t and t % FOLD == 0:
                state.unpersist()
                blocks = self._folded(blocks, rounds[-FOLD:], d, loss.k, bins)
                state = self._loaded(blocks, d, loss.k)
            rounds.append(self._round(state, rounds[t // FOLD * FOLD:], d, s, cuts))
        state.unpersist()
        return BoostedModel(rounds, base, classes, loss.k, d, self.features_col)

    @staticmethod
    def _loaded(blocks: DataFrame, d: int, k: int):
        """The blocks as arrays, a handful of large rows; kept in memory, else read again."""
        return blocks.rdd.map(lambda r: _unpacked(r, d, k)).cache()

    @staticmethod
    def _stored(df: DataFrame) -> DataFrame:
        path = scratch_path(df.sparkSession, "boost")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _base(self, rows, loss, classes, mean, n) -> list[float]:
        """Scores to start from: the mean, the log-odds, or the log of the classes' shares
        (equal ones for the second-order method)."""
        if loss.kind == "squared":
            return [float(mean)]
        counts = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}  # one row a class
        if loss.kind == "logistic":
            p = counts[classes[-1]] / n if len(classes) == 2 else 0.5
            return [math.log(p / (1 - p))]
        return [0.5 if self.newton else math.log(counts[c] / n) for c in classes]

    def _blocks(self, rows, d, cuts, classes, k, base, missing) -> DataFrame:
        def run(batches):
            import pyarrow as pa
            for b in batches:
                for at in range(0, b.num_rows, BLOCK_ROWS):
                    part = b.slice(at, BLOCK_ROWS)
                    x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)
                    y = part.column("y").to_numpy()
                    binned = np.empty((d, len(y)), "<u2")
                    for f in range(d):
                        v = x[:, f]
                        binned[f] = np.where(np.isnan(v), missing, np.searchsorted(cuts[f], v, side="left"))
                    y = np.searchsorted(classes, y).astype(float) if classes else y.astype(float)
                    score = np.repeat(np.array(base)[:, None], len(y), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()]) for v in (binned, y, score)], names=["x", "y", "score"])

        return self._stored(rows.mapInArrow(run, "x binary, y binary, score binary"))

    def _folded(self, blocks, rounds, d, k, missing) -> DataFrame:
        def run(batches):
            import pyarrow as pa
            for b in batches:
                for row in b.to_pylist():
                    x, _, score = _unpacked(row, d, k)
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (row["x"], row["y"], _after(x, score, rounds, missing).tobytes())],
                                                     names=["x", "y", "score"])

        return self._stored(blocks.mapInArrow(run, blocks.schema))

    def _round(self, blocks, recent: list[list[Tree]], d: int, s: _Settings, cuts) -> list[Tree]:
        trees = [Tree() for _ in range(s.loss.k)]
        level = [[0] for _ in trees]  # open nodes of each tree
        for depth in range(self.depth + 1):
            if not any(level):
                break
            found = self._level(blocks, recent, trees, level, d, s, last=depth == self.depth)
            following = [[] for _ in trees]
            for k, tree in enumerate(trees):
                for node in level[k]:
                    g, h, best = found[k, node]
                    tree.value[node] = s.leaf(g, h)
                    if best is not None:
                        gain, f, b, left = best
                        following[k] += tree.split(node, f, b, float(cuts[f][b]) if b < len(cuts[f]) else math.inf, left, gain)
            level = following
        return trees

    def _level(self, blocks, recent, trees, level, d: int, s: _Settings, last: bool) -> dict:
        """(class, node) -> (G, H, best split or None) for the open nodes of a level."""
        sizes = [len(v) for v in level]
        shared = blocks.context.broadcast((recent, trees, level))

        def histograms(part):
            sums: dict = {}
            recent, trees, level = shared.value
            for x, y, score in part:
                g, h = s.loss(_after(x, score, recent, s.missing), y, s.newton)
                for k, tree in enumerate(trees):
                    if not sizes[k]:
                        continue
                    slot = np.full(len(tree.value), -1)
                    slot[level[k]] = np.arange(sizes[k])
                    node = slot[tree.nodes_of(x, len(y), True, s.missing)]
                    inside = node >= 0
                    node, gk, hk = node[inside], g[k][inside], h[k][inside]
                    for f in range(1 if last else d):
                        place = node * (s.missing + 1) + x[f][inside]
                        width = sizes[k] * (s.missing + 1)
                        table = np.stack([np.bincount(place, w, width) for w in ((gk, hk) if s.newton else (gk, hk, None))])
                        sums[k, f] = sums[k, f] + table if (k, f) in sums else table
            return sums.items()

        def best(item):
            (k, f), table = item
            g, h, *c = table.reshape(-1, sizes[k], s.missing + 1)
            totals = np.stack([g.sum(axis=1), h.sum(axis=1)])
            if last:
                return k, f, totals, None
            gain, side = s.gains(g, c[0] if c else h)
            at = gain.argmax(axis=1)
            rows = np.arange(sizes[k])
            return k, f, totals, (gain[rows, at], at, side[rows, at])

        tasks = blocks.getNumPartitions()
        tables = blocks.mapPartitions(histograms)
        if tasks > 1:  # else the task's tables are the sums already
            tables = tables.reduceByKey(np.add, max(1, min(tasks, sum(1 for n in sizes if n) * (1 if last else d))))
        try:
            out = sorted(tables.map(best).collect(), key=lambda r: r[:2])
        finally:
            shared.destroy()
        found: dict = {}
        for k, f, (g, h), splits in out:
            for i, node in enumerate(level[k]):
                old = found.setdefault((k, node), (float(g[i]), float(h[i]), None))
                if splits is not None and splits[0][i] > (1e-9 if old[2] is None else old[2][0]):
                    found[k, node] = (*old[:2], (float(splits[0][i]), f, int(splits[1][i]), bool(splits[2][i])))
        return found


class BoostedModel:
    """Rounds of trees; ``transform`` adds ``raw`` (a score a class) and ``prediction``."""

    def __init__(self, rounds: list[list[Tree]], base: list[float], classes: list[float], k: int, d: int, features_col: str):
        self.rounds, self.base, self.classes, self.k, self.d, self.features_col = rounds, base, classes, k, d, features_col

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(classes, rows) for a matrix of rows by features."""
        out = np.repeat(np.array(self.base, float)[:, None], len(x), axis=1)
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[k] += np.array(tree.value)[tree.nodes_of(x.T, len(x), False)]
        return out

    @property
    def weights(self) -> list[float]:
        """Gain of all splits by a feature, as shares."""
        out = np.zeros(self.d)
        for trees in self.rounds:
            for tree in trees:
                for f, gain, left in zip(tree.feature, tree.gain, tree.left, strict=True):
                    out[f] += gain if left >= 0 else 0.0
        return (out / (out.sum() or 1.0)).tolist()

    def transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)
        plain = [c for c in df.columns if c != self.features_col]  # vectors don't cross Arrow
        schema = T.StructType([*[df.schema[c] for c in plain], T.StructField("raw", T.ArrayType(T.DoubleType())),
                               T.StructField("prediction", T.DoubleType())])

        def run(batches):
            import pyarrow as pa
            model = shared.value
            for b in batches:
                x = b.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, model.d)
                raw = model.scores(x)
                if not model.classes:
                    guess = raw[0]
                else:
                    first = (raw[0] > 0) * (len(model.classes) - 1) if model.k == 1 else raw.argmax(axis=0)
                    guess = np.array(model.classes)[first]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in plain], pa.array(list(raw.T), pa.list_(pa.float64())),
                                                  pa.array(guess, pa.float64())], names=schema.names)

        return df.select(*plain, vector_to_array(self.features_col).alias("__x")).mapInArrow(run, schema)
