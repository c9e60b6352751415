"""Validation, schema listing, previews and a data-size estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# byte width per non-null value of fixed-width types (own definition)
_WIDTH = ((T.ByteType, 1), (T.BooleanType, 1), (T.ShortType, 2), (T.IntegerType, 4),
          (T.FloatType, 4), (T.DateType, 4), (T.LongType, 8), (T.DoubleType, 8),
          (T.TimestampType, 8), (T.TimestampNTZType, 8), (T.DecimalType, 16))


class EmptyDatasetError(ValueError):
    pass


def _bytes_expr(f: T.StructField):
    for cls, w in _WIDTH:
        if isinstance(f.dataType, cls):
            return F.count(F.col(f.name)) * w
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.sum(F.octet_length(F.col(f.name))), F.lit(0))
    return F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(F.col(f.name))))), F.lit(0))


def data_bytes_expr(df: DataFrame):
    total = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        total = total + _bytes_expr(f).cast("bigint")
    return total


def validate(df: DataFrame) -> DataFrame:
    """S3: rows, columns, data_bytes, dtypes ("name:type,..."); raises when empty."""
    if df.isEmpty():
        raise EmptyDatasetError("the table has no rows")
    dtypes = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  data_bytes_expr(df).alias("data_bytes")) \
        .select("rows", F.lit(len(df.columns)).cast("bigint").alias("columns"), "data_bytes",
                F.lit(dtypes).alias("dtypes"))


def schema_listing(df: DataFrame) -> DataFrame:
    """(ordinal, column, type) from the schema (no data read)."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string, type string")


def preview(df: DataFrame, order_by: str, n: int = 10) -> DataFrame:
    """First n rows by a key (file order is not defined in Spark)."""
    return df.orderBy(order_by).limit(n)
