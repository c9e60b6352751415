"""Schema-level column classes (numeric / categorical) and type labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC)


def is_categorical(dt: T.DataType) -> bool:
    # booleans are treated as categories everywhere
    return isinstance(dt, (T.StringType, T.BooleanType, T.VarcharType, T.CharType))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_categorical(f.dataType) and f.name not in exclude]


def dtype_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def type_name(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def kind_of(dt: T.DataType) -> str:
    """'integer' | 'float' | 'text' | 'bool' | 'other' (drives target rules)."""
    if isinstance(dt, INTEGRAL):
        return "integer"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(dt, T.BooleanType):
        return "bool"
    return "other"


def subset(requested: str | list[str] | None, available: list[str]) -> list[str]:
    """Comma list or list of names -> those present in ``available``, in request order.

    Unknown names are skipped silently (the outlier endpoint behaviour)."""
    if requested is None:
        return list(available)
    names = requested.split(",") if isinstance(requested, str) else requested
    wanted = [n.strip() for n in names if n.strip()]
    return [n for n in wanted if n in available]


def clean_double(c: str | Column) -> Column:
    """Cast to double and map NaN to NULL (one notion of missing)."""
    col = F.col(c) if isinstance(c, str) else c
    d = col.cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def is_missing(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, FLOATING):
        return F.col(c).isNull() | F.isnan(F.col(c))
    return F.col(c).isNull()
