"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, ship_package

#: The byte class that separates words (space and \t..\r).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: the lineage ends there, and what was drawn once (row ids, sampled
    range bounds) stays the same when an executor is lost."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(df: DataFrame) -> SparkSession:
    """Make this package importable in Python workers and return the session."""
    ship_package(df.sparkSession)
    return df.sparkSession


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def row_key(text: Column) -> list[Column]:
    """A 128-bit content key; with the document id it names a row across scans.
    Rows that agree in both are repeated rows and need not be told apart."""
    return [F.xxhash64(text).alias("__h1"), F.xxhash64(F.lit("second"), text).alias("__h2")]


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with the content key columns that :func:`row_key` describes."""
    h1, h2 = row_key(F.col("text"))
    return df.withColumn("__h1", h1).withColumn("__h2", h2)


def map_arrow(df: DataFrame, carry: list[str], added: dict[str, T.DataType], run) -> DataFrame:
    """``df`` through ``run`` in Arrow batches. ``run`` takes an iterator of record
    batches and yields (batch, rows or None, new columns): the columns ``carry`` of
    those rows of the batch (None: all) go on as they are, nulls and large integers
    included, beside the new columns."""
    from pyspark.sql.pandas.types import to_arrow_type
    schema = T.StructType([*[df.schema[c] for c in carry], *[T.StructField(n, t) for n, t in added.items()]])
    types = {n: to_arrow_type(t) for n, t in added.items()}

    def go(batches):
        import pyarrow as pa
        for batch, rows, new in run(batches):
            old = [batch.column(c) if rows is None else batch.column(c).take(pa.array(rows, pa.int64())) for c in carry]
            yield pa.RecordBatch.from_arrays([*old, *[pa.array(new[n], types[n]) for n in types]], names=schema.names)

    return df.mapInArrow(go, schema)


def rank_within(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """``df`` plus ``rank``: the 0-based place of each row within the long column
    ``by`` (not null) following ``order``.

    Rows are range partitioned on (by, order, row id), so a group of any size is
    spread over tasks, and numbered inside each partition; a table of at most
    (partitions + groups) rows holds each partition's starting count. Equal rows
    take consecutive places in any order. ``df`` must be cheap and repeatable to
    compute, as the range bounds are sampled first: pass a written table."""
    spark = prepare(df)
    names = [f"__o{k}" for k in range(len(order))]
    keyed_rows = df.withColumns(dict(zip(names, order, strict=True))) \
        .withColumn("__tie", F.monotonically_increasing_id())
    sort = [F.col(by), *[F.col(n) for n in names], F.col("__tie")]
    ranged = (keyed_rows.repartitionByRange(shuffle_partitions(spark), *sort)
              .sortWithinPartitions(*sort).drop(*names, "__tie")
              .withColumn("__pid", F.spark_partition_id()))

    def number(batches):
        import numpy as np
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(by).to_numpy()
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            lengths = np.diff(np.r_[starts, len(key)])
            local = np.arange(len(key)) - np.repeat(starts, lengths)
            if last is not None and key[0] == last:
                local[: lengths[0]] += seen
            last, seen = key[-1], int(local[-1]) + 1
            yield b, None, {"__local": local}

    local = written(map_arrow(ranged, ranged.columns, {"__local": T.LongType()}, number))
    totals = local.groupBy(by, "__pid").agg((F.max("__local") + 1).alias("__n"))
    before = Window.partitionBy(by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(by, "__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (local.join(offsets, [by, "__pid"])
            .withColumn("rank", F.col("__off") + F.col("__local")).drop("__pid", "__local", "__off"))
