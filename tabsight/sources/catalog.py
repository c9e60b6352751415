"""Dataset catalog: datasets are tables in the Spark catalog, stored as Parquet in
the warehouse or below a given path."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

_PLAIN = re.compile(r"[0-9a-z_]+")
#: Table property that holds a dataset's key.
KEY = "tabsight.key"


def table_name(key: str) -> str:
    """The dataset's table: the key itself after ``ds_`` where it is a lower-case name,
    else ``dx_`` and a hash, so that no two keys share a table."""
    return f"ds_{key}" if _PLAIN.fullmatch(key) else "dx_" + hashlib.md5(key.encode()).hexdigest()


def save_dataset(df: DataFrame, key: str, if_exists: str = "error",
                 path: str | None = None) -> DataFrame:
    """Store ``df`` under ``key``; an existing dataset is NOT overwritten:
    ``if_exists='error'`` raises, ``'ignore'`` keeps the stored one.
    Returns the stored dataset."""
    spark = df.sparkSession
    name = table_name(key)
    mode = {"error": "errorifexists", "ignore": "ignore"}[if_exists]
    if spark.catalog.tableExists(name):
        if if_exists == "error":
            raise FileExistsError(f"dataset '{key}' already exists")
        return spark.table(name)
    writer = df.write.mode(mode).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    text = key.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE `{name}` SET TBLPROPERTIES ('{KEY}' = '{text}')")
    return spark.table(name)


def load_dataset(spark: SparkSession, key: str) -> DataFrame:
    return spark.table(table_name(key))


def list_datasets(spark: SparkSession) -> DataFrame:
    """(key, table, is_temporary) of the stored datasets; other tables and views of the
    catalog are not datasets."""
    rows = []
    for t in spark.catalog.listTables():
        if not t.isTemporary and t.name.startswith(("ds_", "dx_")):
            known = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES `{t.name}`").collect()}
            if KEY in known or t.name.startswith("ds_"):
                rows.append((known.get(KEY, t.name.removeprefix("ds_")), t.name, False))
    return spark.createDataFrame(rows, "key string, table string, is_temporary boolean")


def drop_dataset(spark: SparkSession, key: str) -> bool:
    """Drop a dataset; returns whether it existed."""
    name = table_name(key)
    existed = spark.catalog.tableExists(name)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    return existed
