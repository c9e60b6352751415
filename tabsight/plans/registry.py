"""Query registry: ``@query(name, sql)`` registers a Spark builder and its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int | dict = 6):
    """Register ``fn(spark, sf_dir) -> DataFrame``; doubles are rounded to
    ``digits`` decimals (the SQL rounds the same columns the same way)."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir), digits)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def finish(df: DataFrame, digits: int | dict = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            d = digits.get(f.name, digits.get("*", 6)) if isinstance(digits, dict) else digits
            if d is None:
                cols.append(F.col(f.name))
            else:
                cols.append(F.round(F.col(f.name).cast("double"), d).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
