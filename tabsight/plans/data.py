"""Driver tables and the prepared inputs each operator family is checked on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with value NULL at event_id % 7 = 0 and event_type NULL at % 11 = 0
    (the driver tables hold no NULLs; the SQL oracle uses the same CASE)."""
    ev = table(spark, sf_dir, "events")
    return (ev.withColumn("value", F.when(F.col("event_id") % 7 == 0, F.lit(None))
                          .otherwise(F.col("value")))
            .withColumn("event_type", F.when(F.col("event_id") % 11 == 0, F.lit(None))
                        .otherwise(F.col("event_type"))))


EVENTS_NULLS_SQL = """(SELECT event_id, ts, user_id,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props FROM events)"""


def lineitem_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numeric columns of lineitem plus derived, strongly related ones."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("l_net"),
                     (F.col("l_extendedprice") / F.col("l_quantity")).alias("l_unitprice"))


LINEITEM_NUMERIC_SQL = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS l_net, l_extendedprice / l_quantity AS l_unitprice
  FROM lineitem)"""
