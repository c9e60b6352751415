"""Support vector regression with the epsilon-insensitive loss.

Minimises |w|^2 / (2 C n) + mean(max(0, |y - w.x - b| - epsilon)) over a feature
column, or over a kernel's features, which tasks compute from that column and never
store. The rows are packed once, as the bytes of blocks of numbers. Each step is one
pass: tasks sum the loss and its gradient over these blocks, one row a partition; these
are added up a tree of fan-in ``FAN_IN``, and the driver adds the last few and steps a
limited memory quasi-Newton method over the weights (as many numbers as features). The
loss is rounded off over a width that shrinks to a thousandth of epsilon, so the
result is the optimum of the stated problem up to that rounding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, ship_package

#: Partial sums that a task, or the driver, adds.
FAN_IN = 32
#: Values (rows by weights) that a task should have at most, and that it holds at once.
TASK_VALUES, HELD_VALUES = 20_000_000, 64_000
#: Bytes of a block of rows; one Arrow batch has up to 10,000 blocks.
BLOCK_BYTES = 4096

#: Step lengths tried in one pass.
TRIED = 4


def smooth_loss(e: np.ndarray, epsilon: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its derivative at errors ``e``: 0 up to epsilon, a parabola over
    ``width``, then a line."""
    r = np.abs(e) - epsilon
    inner = np.clip(r, 0.0, width)
    loss = inner * inner / (2 * width) + np.maximum(r - width, 0.0)
    return loss, np.sign(e) * inner / width


def _packed(rows: DataFrame, columns: int) -> DataFrame:
    """The numbers (x, y) of each block of rows, row after row, as bytes: a pass then reads
    no list a row."""
    block = _block(columns)

    def pack(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                z = np.concatenate((x, b.column("y").to_numpy()[:, None]), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([z[at:at + block].tobytes() for at in range(0, len(z), block)], pa.binary())], names=["z"])

    return rows.mapInArrow(pack, "z binary")


def _block(columns: int) -> int:
    """Rows of a block."""
    return max(1, BLOCK_BYTES // (8 * (columns + 1)))


class _Sums:
    """Loss and gradient at each of some points, summed over the packed rows of a table in one pass."""

    def __init__(self, rows: DataFrame, n: int, columns: int, dim: int, c: float, epsilon: float, mapped=None):
        self.rows, self.n, self.columns, self.dim, self.c, self.epsilon, self.mapped = rows, n, columns, dim, c, epsilon, mapped
        self.partitions = rows.rdd.getNumPartitions()

    def __call__(self, points: np.ndarray, width: float) -> list[tuple[float, np.ndarray]]:
        epsilon, columns, dim, mapped = self.epsilon, self.columns, self.dim, self.mapped
        step, size = max(1, HELD_VALUES // max(1, dim)), len(points) * (dim + 2)
        blocks = max(1, step // _block(columns))

        def run(batches):
            sums = np.zeros((len(points), dim + 2))
            for batch in batches:
                for at in range(0, batch.num_rows, blocks):
                    held = b"".join(batch.column("z").slice(at, blocks).to_pylist())
                    held = np.frombuffer(held).reshape(-1, columns + 1)
                    for z in (held[i:i + step] for i in range(0, len(held), step)):
                        x, y = z[:, :-1], z[:, -1]
                        x = x if mapped is None else mapped(x)
                        for total, point in zip(sums, points, strict=True):
                            loss, slope = smooth_loss(x @ point[:-1] + point[-1] - y, epsilon, width)
                            total[0] += loss.sum()
                            total[1:-1] += slope @ x
                            total[-1] += slope.sum()
            yield pa.RecordBatch.from_arrays([pa.array([sums.ravel()], pa.list_(pa.float64()))], names=["s"])

        def add(batches):
            total = np.zeros(size)
            for b in batches:
                if b.num_rows:
                    total += b.column("s").flatten().to_numpy().reshape(b.num_rows, size).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

        schema = T.StructType([T.StructField("s", T.ArrayType(T.DoubleType()))])
        sums, n = self.rows.mapInArrow(run, schema), self.partitions
        while n > FAN_IN:
            n = -(-n // FAN_IN)
            sums = sums.repartition(n).mapInArrow(add, schema)
        out = []
        for s, point in zip(np.sum([p["s"] for p in sums.collect()], axis=0).reshape(len(points), -1) / self.n, points, strict=True):
            w = point.copy()
            w[-1] = 0.0  # the intercept is not penalised
            out.append((s[0] + w @ w / (2 * self.c * self.n), s[1:] + w / (self.c * self.n)))
        return out


def _minimise(f, start: np.ndarray, steps: int, tol: float, memory: int = 10) -> np.ndarray:
    """Two-loop quasi-Newton steps with backtracking; where the whole step is too long, one
    pass of ``f`` tries the next ``TRIED`` halves of it."""
    x, (value, grad), past = start, f(start[None])[0], []
    for _ in range(steps):
        if np.abs(grad).max() <= tol:
            break
        d, coefs = grad.copy(), []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            coefs.append(a)
            d -= a * y
        if past:
            s, y = past[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(coefs)):
            d += (a - (y @ d) / (s @ y)) * s
        t, found, tries = 1.0, None, [1.0]
        while found is None:
            for t, (v, g) in zip(tries, f(np.array([x - t * d for t in tries])), strict=True):
                if v <= value - 1e-4 * t * (grad @ d) or t < 1e-8:
                    found = x - t * d, v, g
                    break
            tries = [t / 2 ** i for i in range(1, TRIED + 1)]
        if t < 1e-8:
            break
        new, v, g = found
        if (g - grad) @ (new - x) > 1e-12 * (grad @ (x - new)):  # of the slope: means over many rows curve little
            past = [*past[1 - memory:], (new - x, g - grad)]
        x, value, grad = new, v, g
    return x


class SVRModel:
    """Weights and intercept; ``transform`` adds ``prediction``, from the features column or
    from the features that ``mapped`` makes of the column ``of``."""

    def __init__(self, weights: np.ndarray, intercept: float, features_col: str, of: str | None = None, mapped=None):
        self.weights, self.intercept, self.features_col, self.of, self.mapped = weights, intercept, features_col, of, mapped

    def transform(self, df: DataFrame) -> DataFrame:
        if self.mapped is not None:
            ship_package(df.sparkSession)
            dots = F.arrow_udf(_dots(self.weights, self.intercept, self.mapped), "double")
            return df.withColumn("prediction", dots(vector_to_array(self.of)))
        w = F.array(*[F.lit(float(v)) for v in self.weights])
        dot = F.aggregate(F.zip_with(vector_to_array(self.features_col), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return df.withColumn("prediction", dot + F.lit(float(self.intercept)))


def _dots(weights: np.ndarray, intercept: float, mapped):
    """Arrow lists -> the predictions of their mapped rows."""
    step = max(1, HELD_VALUES // max(1, len(weights)))

    def run(v: pa.Array) -> pa.Array:
        x = v.flatten().to_numpy(zero_copy_only=False)
        x, out = x.reshape(len(v), len(x) // max(1, len(v))), np.empty(len(v))
        for at in range(0, len(v), step):
            out[at:at + step] = mapped(x[at:at + step]) @ weights + intercept
        return pa.array(out)
    return run


class EpsilonSVR:
    """``fit(df)`` on (features vector, label). With ``mapped`` (a matrix of rows to one of
    features) the weights are those of ``mapped(df[of])``, and ``transform`` maps that column too."""

    def __init__(self, c: float = 1.0, epsilon: float = 0.1, max_iter: int = 100, tol: float = 1e-5,
                 features_col: str = "features", label_col: str = "label"):
        self.c, self.epsilon, self.max_iter, self.tol = c, epsilon, max_iter, tol
        self.features_col, self.label_col = features_col, label_col

    def fit(self, df: DataFrame, of: str | None = None, mapped=None) -> SVRModel:
        ship_package(df.sparkSession)
        checkpoint_dir(df.sparkSession)
        rows = df.select(vector_to_array(of or self.features_col).alias("x"), F.col(self.label_col).cast("double").alias("y")) \
            .checkpoint(eager=True)
        n, columns, mean, spread = rows.agg(F.count(F.lit(1)), F.max(F.size("x")), F.avg("y"), F.stddev_pop("y")).first()
        if not n:
            raise ValueError("no rows to fit")
        dim = columns if mapped is None else mapped(np.zeros((1, columns))).shape[1]
        tasks = -(-n * dim // TASK_VALUES)
        if rows.rdd.getNumPartitions() < tasks:
            rows = rows.repartition(tasks)
        sums = _Sums(_packed(rows, columns).checkpoint(eager=True), n, columns, dim, self.c, self.epsilon, mapped)
        point = np.r_[np.zeros(dim), mean]
        spread = spread or 1.0
        for width in (spread, spread / 10, max(self.epsilon, 1e-3) / 1000):
            point = _minimise(lambda p, w=width: sums(p, w), point, self.max_iter, self.tol)
        return SVRModel(point[:-1], point[-1], self.features_col, of, mapped)
