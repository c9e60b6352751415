"""Sums of products of average ranks, for Spearman.

Each row stays in the place its scan gave it: a block of rows has a number, and only
parts of its columns travel, twice a value, never whole rows and never once a column.

1. ``percentile_approx`` borders cut each column into buckets: one for each border
   itself (a single value, however many rows have it) and one for the values between
   two borders, about ``RUN`` rows. A scan counts the rows of all buckets, so the rank of
   a border and the first rank of every other bucket are known.
2. A second scan sends for each block and column the buckets of its rows, in row order,
   and the values between borders to their bucket. A bucket ranks its values in one task.
3. Ranks and buckets of a block meet again, and a task adds up the products.

Two columns are ranked on the rows that have both. So a value has one rank for all partner
columns without NULL, and one more for each partner column with NULLs: buckets count and
rank their rows for each of these by itself.

Places must be the same when a task runs again, so rows that come out of a shuffle are
checkpointed first.
"""

from __future__ import annotations

import contextlib
import io

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package

#: Rows of a block and ranks of a block, at most.
BLOCK, NUMBERS = 1 << 16, 4_000_000
#: Rows between two borders, about; a bucket is ranked in one task.
RUN = 500_000
#: Values that a partition gets, about.
VALUES = 5_000_000
#: Columns whose borders one aggregate finds.
CHUNK = 50

_PIECE = "block long, i int, bucket int, data binary"


def _placed(df: DataFrame) -> DataFrame:
    """``df``, checkpointed unless its rows come straight from a scan."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    if "Exchange" not in text.getvalue():
        return df
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _borders(df: DataFrame, rows: int) -> tuple[list[np.ndarray], list[bool]]:
    """Ascending borders of each column, and whether the column has one value only."""
    parts = max(16, -(-rows // RUN))
    grid = [q / parts for q in range(1, parts)]
    cuts, constant = [], []
    for s in range(0, len(df.columns), CHUNK):
        some = df.columns[s:s + CHUNK]
        found = df.agg(*[x for c in some for x in (F.percentile_approx(c, grid, 20 * parts).alias(f"q{c}"),
                                                   F.min(c).alias(f"lo{c}"), F.max(c).alias(f"hi{c}"))]).first()
        cuts += [np.unique(np.array(found[f"q{c}"] or [0.0], dtype=np.float64)) for c in some]
        constant += [found[f"lo{c}"] == found[f"hi{c}"] for c in some]
    return cuts, constant


def _codes(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Buckets: 2p + 1 for the p-th border, 2p for the values between it and the one before,
    2 * len(cuts) + 1 for NULL (here NaN)."""
    at = np.searchsorted(cuts, x)
    equal = cuts[np.minimum(at, len(cuts) - 1)] == x
    return (2 * at + (equal | np.isnan(x))).astype(_code_type(cuts))


def _code_type(cuts: np.ndarray) -> np.dtype:
    return np.min_scalar_type(2 * len(cuts) + 1)


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])


def _blocks(batches, size: int):
    """Arrays of ``size`` rows (the last one: the rest), a line a column."""
    held, n = [], 0
    for b in batches:
        held.append(_columns(b))
        n += b.num_rows
        if n >= size:
            x = np.concatenate(held, axis=1)
            whole = n - n % size
            for s in range(0, whole, size):
                yield x[:, s:s + size]
            held, n = [x[:, whole:]], n - whole
    if n:
        yield np.concatenate(held, axis=1)


def _doubled_ranks(v: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Twice the average rank of each value among all rows, then among the rows of each mark."""
    _, at = np.unique(v, return_inverse=True)
    out = np.empty((1 + len(marks), len(v)), _rank_type(len(v)))
    for line, rows in zip(out, [at, *(at[m] for m in marks)], strict=True):
        n = np.bincount(rows, minlength=at.max() + 1)
        line[:] = (2 * (np.cumsum(n) - n) + n + 1)[at]
    return out


def _rank_type(n: int) -> np.dtype:
    return np.dtype(np.int32 if n < 1 << 30 else np.int64)


def _between(codes: np.ndarray) -> np.ndarray:
    """The rows whose value is no border, by bucket, then place."""
    order = np.argsort(codes, kind="stable")
    return order[codes[order] % 2 == 0]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    block, i, bucket, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(i, pa.int32()), pa.array(bucket, pa.int32()),
                                       pa.array(data, pa.binary())], names=["block", "i", "bucket", "data"])


def _dealt(cuts: list[np.ndarray], holes: list[int], size: int):
    """For each block and column: the buckets of the rows (bucket -1), and the values of
    each bucket between borders, with the rows' marks: which of ``holes`` aren't NULL."""
    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for number, block in enumerate(_blocks(batches, size), first):
            marks = np.packbits(~np.isnan(block[holes]), axis=0)
            for i, x in enumerate(block):
                codes = _codes(x, cuts[i])
                out = [(number, i, -1, codes.tobytes())]
                rows = _between(codes)
                starts = np.flatnonzero(np.diff(codes[rows], prepend=codes.dtype.type(1)))
                for s, e in zip(starts, [*starts[1:], len(rows)]):
                    out.append((number, i, int(codes[rows[s]]), x[rows[s:e]].tobytes() + marks[:, rows[s:e]].tobytes()))
                yield _batch(out)
    return run


def _ranked(holes: int):
    """Values of a bucket, which come together, become their doubled ranks in it."""
    width = -(-holes // 8)

    def finished(key, held):
        sizes = [len(data) // (8 + width) for _, data in held]
        v = np.concatenate([np.frombuffer(data, count=n) for (_, data), n in zip(held, sizes, strict=True)])
        marks = np.concatenate([np.frombuffer(data, np.uint8, offset=8 * n).reshape(width, n)
                                for (_, data), n in zip(held, sizes, strict=True)], axis=1)
        ranks = _doubled_ranks(v, np.unpackbits(marks, axis=0, count=holes).astype(bool))
        ends = np.cumsum(sizes)
        return _batch([(block, *key, ranks[:, e - n:e].tobytes()) for (block, _), n, e in zip(held, sizes, ends, strict=True)])

    def run(batches):
        key, held = None, []
        for b in batches:
            passed = []
            for block, i, bucket, data in _pieces(b):
                if bucket < 0:
                    passed.append((block, i, bucket, data))
                    continue
                if (i, bucket) != key:
                    if held:
                        yield finished(key, held)
                    key, held = (i, bucket), []
                held.append((block, data))
            if passed:
                yield _batch(passed)
        if held:
            yield finished(key, held)
    return run


def _pieces(batch: pa.RecordBatch):
    return zip(*(batch.column(c).to_pylist() for c in ("block", "i", "bucket", "data")), strict=True)


def _multiplied(first: list[np.ndarray], codes_of: list[np.dtype], ranks_of: list[list[np.dtype]], holes: list[int]):
    """Sums of products of the centred ranks over a task's blocks. ``first``: for all rows,
    then for those of each mark, the centred rank of each border, and what each other
    bucket's ranks start from."""
    k, lines = len(first), 1 + len(holes)
    at = [1 + holes.index(i) if i in holes else 0 for i in range(k)]  # the line for the partner i
    one, other = np.triu_indices(k)

    def products(codes: dict, pieces: dict) -> np.ndarray:
        x = np.empty((k, lines, len(codes[0])))
        for i, c in codes.items():
            x[i] = first[i][:, c]
            if i in pieces:
                x[i][:, _between(c)] += np.concatenate(pieces[i], axis=1) / 2
        if not holes:
            p = x[:, 0] @ x[:, 0].T
            return np.stack([p[one, other], p[one, one], p[other, other]])
        for i in holes:
            gone = codes[i] == first[i].shape[1] - 1
            x[i][:, gone] = 0
            x[:, at[i], gone] = 0
        return np.array([(a @ b, a @ a, b @ b) for a, b in ((x[i, at[j]], x[j, at[i]]) for i, j in zip(one, other))]).T

    def run(batches):
        total, last, codes, pieces = np.zeros((3, len(one))), None, {}, {}
        for b in batches:
            for block, i, bucket, data in _pieces(b):
                if block != last:
                    if codes:
                        total += products(codes, pieces)
                    last, codes, pieces = block, {}, {}
                if bucket < 0:
                    codes[i] = np.frombuffer(data, codes_of[i])
                else:
                    pieces.setdefault(i, []).append(np.frombuffer(data, ranks_of[i][bucket]).reshape(lines, -1))
        if codes:
            total += products(codes, pieces)
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int32()), pa.array(other, pa.int32()), *map(pa.array, total)],
                                             names=["i", "j", "xy", "xx", "yy"])
    return run


def rank_products(df: DataFrame, rows: int, holes: list[int]) -> tuple[dict[tuple[int, int], tuple], list[bool]]:
    """For i <= j, over the rows that have both columns: their number, the sum of (rank -
    mean rank) of the i-th times that of the j-th column, and the sums of the squares of
    either; and which columns are constant. ``df`` has ``rows`` rows, one or more, and double
    columns with names of their own, without NaN; those numbered ``holes`` have NULLs."""
    spark = df.sparkSession
    ship_package(spark)
    k, lines = len(df.columns), 1 + len(holes)
    base = _placed(df)
    cuts, constant = _borders(base, rows)

    def counted(batches):
        n = [np.zeros((lines, 2 * len(c) + 2), np.int64) for c in cuts]
        for b in batches:
            block = _columns(b)
            marks = ~np.isnan(block[holes])
            for i, x in enumerate(block):
                codes = _codes(x, cuts[i])
                for line, some in zip(n[i], [codes, *(codes[m] for m in marks)], strict=True):
                    line += np.bincount(some, minlength=len(line))
        for i, c in enumerate(n):
            line, at = np.nonzero(c[:, :-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(line, pa.int32()),
                                              pa.array(at, pa.int32()), pa.array(c[line, at])], names=["i", "line", "bucket", "n"])
    counts = [np.zeros((lines, 2 * len(c) + 2), np.int64) for c in cuts]
    found = base.mapInArrow(counted, "i int, line int, bucket int, n long").groupBy("i", "line", "bucket").agg(F.sum("n").alias("n"))
    for r in found.collect():  # a row a column, kind of partner and bucket
        counts[r["i"]][r["line"], r["bucket"]] = r["n"]
    total = [n.sum(axis=1) for n in counts]
    first = [np.cumsum(n, axis=1) - n + np.where(np.arange(n.shape[1]) % 2, (n + 1) / 2, 0) - (t[:, None] + 1) / 2
             for n, t in zip(counts, total, strict=True)]
    ranks_of = [[_rank_type(m) for m in n[0]] for n in counts]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * k * lines // VALUES))
    size = max(1, min(BLOCK, NUMBERS // (k * lines)))
    ranks = base.mapInArrow(_dealt(cuts, holes, size), _PIECE) \
        .repartition(parts, "i", "bucket", F.when(F.col("bucket") < 0, F.col("block"))).sortWithinPartitions("i", "bucket") \
        .mapInArrow(_ranked(len(holes)), _PIECE)
    sums = ranks.repartition(parts, "block").sortWithinPartitions("block", "i", "bucket") \
        .mapInArrow(_multiplied(first, [_code_type(c) for c in cuts], ranks_of, holes), "i int, j int, xy double, xx double, yy double") \
        .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy")])
    line = {i: 1 + t for t, i in enumerate(holes)}
    return {(r["i"], r["j"]): (int(total[r["i"]][line.get(r["j"], 0)]), r["xy"], r["xx"], r["yy"]) for r in sums.collect()}, constant
