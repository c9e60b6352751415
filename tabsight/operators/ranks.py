"""Order statistics without an unpartitioned window.

1. Rows collapse to distinct (group, value, count) triples - a hot value is one
   row after map-side aggregation.
2. The triples are range partitioned on (group, value) and sorted; each range
   partition keeps running counts in one streaming pass over Arrow batches, with
   no further shuffle.
3. Per-(partition, group) totals form a table of at most (partitions + groups)
   rows; a window over it gives each partition's starting offset.

The numbered table is checkpointed (shared checkpoint folder) before its
partition ids are used twice, so both uses see one materialised layout and a
lost executor cannot re-sample the ranges.

rank = offset + (running count before the value) + (count + 1) / 2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, ship_package


def _running(batches):
    """Adds ``__local``: the sum of ``__cnt`` over the rows before each row within
    its group ``__g``, over batches sorted by group."""
    import numpy as np
    import pyarrow as pa
    last, seen = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column("__g").to_numpy(zero_copy_only=False)
        cnt = b.column("__cnt").to_numpy()
        upto = np.cumsum(cnt)
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        base = np.repeat(upto[starts] - cnt[starts], np.diff(np.r_[starts, len(g)]))
        local = upto - cnt - base
        if last is not None and g[0] == last:
            end = starts[1] if len(starts) > 1 else len(g)
            local[:end] += seen
        last, seen = g[-1], int(local[-1] + cnt[-1])
        yield b.append_column("__local", pa.array(local, pa.int64()))


def running_counts(df: DataFrame, group: Sequence[str], order: Sequence[str], count: str | None = None,
                   partitions: int | None = None) -> DataFrame:
    """``df`` plus ``before``: how many rows (or how much of the column ``count``)
    its group has before the row in ``order``."""
    spark = df.sparkSession
    ship_package(spark)
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.to_json(F.struct(*group)) if group else F.lit("")
    place = (["__g"] if group else []) + list(order)
    ranged = (df.withColumn("__g", key)
              .withColumn("__cnt", F.col(count) if count else F.lit(1).cast("long"))
              .repartitionByRange(p, *place).sortWithinPartitions(*place)
              .withColumn("__pid", F.spark_partition_id()))
    schema = T.StructType([*ranged.schema.fields, T.StructField("__local", T.LongType())])
    checkpoint_dir(spark)
    local = ranged.mapInArrow(_running, schema).checkpoint(eager=True)
    totals = local.groupBy("__pid", "__g").agg(F.max(F.col("__local") + F.col("__cnt")).alias("__ptot"))
    wo = Window.partitionBy("__g").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__pid", "__g", F.coalesce(F.sum("__ptot").over(wo), F.lit(0)).alias("__off"))
    if not group:
        offsets = F.broadcast(offsets)  # at most one row a partition
    return (local.join(offsets, ["__pid", "__g"])
            .withColumn("before", F.col("__off") + F.col("__local"))
            .drop("__pid", "__g", "__cnt", "__off", "__local"))


def positions(df: DataFrame, order: Sequence[str], by: Sequence[str] = (),
              partitions: int | None = None) -> DataFrame:
    """``df`` + ``pos``: the 1-based row position within ``by`` groups following
    ``order`` (a unique ordering), without a per-group task."""
    return running_counts(df, list(by), list(order), None, partitions) \
        .withColumn("pos", F.col("before") + 1).drop("before")


def dense_index(df: DataFrame, column: str) -> DataFrame:
    """(value, code): 0-based code of each distinct value in sorted order."""
    distinct = df.select(F.col(column).alias("value")).distinct()
    return positions(distinct, ["value"]).select("value", (F.col("pos") - 1).alias("code"))
