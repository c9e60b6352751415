"""Ingest / sink plans (S1-S11): every round trip writes a driver table to the
shared scratch location and reads it back through the library."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import catalog, ingest, inspect
from .data import EVENTS_NULLS_SQL, events_with_nulls, table
from .registry import query


@query("csv_roundtrip", "SELECT * FROM events")
def q_csv_roundtrip(spark, sf):
    """S1 + S8: write events (JSON text, full of quotes) as CSV, read it back with
    the frozen schema."""
    ev = table(spark, sf, "events")
    path = ingest.write_csv(ev, ingest.scratch_path(spark, "events-csv"))
    return ingest.read_csv(spark, path, schema=ev.schema)


@query("csv_roundtrip_lines", "SELECT * FROM documents")
def q_csv_roundtrip_lines(spark, sf):
    """S1 + S8 on documents: whole texts with line breaks inside fields."""
    doc = table(spark, sf, "documents")
    path = ingest.write_csv(doc, ingest.scratch_path(spark, "documents-csv"))
    return ingest.read_csv(spark, path, schema=doc.schema, multi_line=True)


@query("csv_plain_quotes", """
SELECT p_partkey, CAST(p_size AS VARCHAR) || '" pipe' AS size, p_name || chr(10) || 'of "' || p_type || '", ' || p_brand AS label FROM part""")
def q_csv_plain_quotes(spark, sf):
    """Records with lone quotes in plain fields, and with line breaks, commas and
    doubled quotes in quoted ones, read by byte ranges."""
    p = table(spark, sf, "part")
    label = F.concat("p_name", F.lit('\nof ""'), "p_type", F.lit('"", '), "p_brand")
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(","), F.col("p_size").cast("string"), F.lit('" pipe,"'), label, F.lit('"'))
    path = ingest.scratch_path(spark, "part-csv")
    p.select(line.alias("value")).write.text(path)
    return ingest.read_csv(spark, path, T.StructType([
        T.StructField("p_partkey", T.LongType()), T.StructField("size", T.StringType()), T.StructField("label", T.StringType())]),
        header=False, multi_line=True)


_EV_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def _infer_sql() -> str:
    parts = []
    for i, c in enumerate(_EV_COLS):
        txt = f"CAST({c} AS VARCHAR)"
        parts.append(f"""SELECT '{c}' AS "column", {i} AS ordinal, count({c}) AS non_null,
          CASE WHEN count({c}) = 0 THEN 'string'
               WHEN count_if(regexp_full_match({txt}, '[+-]?[0-9]+')
                    AND TRY_CAST({txt} AS BIGINT) IS NOT NULL) = count({c}) THEN 'bigint'
               WHEN count(CASE WHEN regexp_full_match(lower({txt}),
                         '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?|[+-]?inf(inity)?')
                    THEN TRY_CAST({txt} AS DOUBLE) END) = count({c}) THEN 'double'
               WHEN count_if({txt} IN ('True', 'true', 'TRUE', 'False', 'false', 'FALSE'))
                    = count({c}) THEN 'boolean'
               ELSE 'string' END AS inferred FROM {EVENTS_NULLS_SQL}""")
    return " UNION ALL ".join(parts)


@query("infer_types", _infer_sql())
def q_infer_types(spark, sf):
    """Events (with NULLs written as empty fields) to CSV, read as text with
    NA tokens nulled, types inferred from try_cast counts in one aggregate."""
    ev = events_with_nulls(spark, sf)
    path = ingest.write_csv(ev, ingest.scratch_path(spark, "events-csv"))
    text = ingest.null_tokens(spark.read.options(**ingest.CSV_QUOTING).option("header", True).csv(path))
    return ingest.infer_types(text)


@query("json_roundtrip", "SELECT * FROM events")
def q_json_roundtrip(spark, sf):
    """JSON records sink and source with a frozen schema."""
    ev = table(spark, sf, "events")
    path = ingest.write_json(ev, ingest.scratch_path(spark, "events-json"))
    return ingest.read_json(spark, path, ev.schema)


@query("validate_dataset", """
SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns,
  CAST(8 * count(event_id) + 8 * count(ts) + 8 * count(user_id) + sum(strlen(event_type))
    + 8 * count(value) + sum(strlen(props)) AS BIGINT) AS data_bytes,
  'event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double,props:string'
    AS dtypes
FROM events""")
def q_validate_dataset(spark, sf):
    """S3 + S11: rows, columns, data bytes, types."""
    return inspect.validate(table(spark, sf, "events"))


@query("data_bytes", """
SELECT CAST(8 * count(doc_id) + sum(strlen(text)) + sum(strlen(lang))
  + sum(strlen(source)) + 8 * count(n_chars) AS BIGINT) AS data_bytes FROM documents""")
def q_data_bytes(spark, sf):
    """S11 on documents (whole texts)."""
    doc = table(spark, sf, "documents")
    return doc.agg(inspect.data_bytes_expr(doc).alias("data_bytes"))


@query("save_dataset", "SELECT * FROM orders")
def q_save_dataset(spark, sf):
    """Store orders as a catalog table (never overwriting) and read it back."""
    import uuid
    key = f"orders_{uuid.uuid4().hex[:8]}"
    stored = catalog.save_dataset(table(spark, sf, "orders"), key, if_exists="error")
    # a second save of the same key keeps the first copy
    catalog.save_dataset(table(spark, sf, "orders").limit(0), key, if_exists="ignore")
    return stored


@query("list_datasets", """
SELECT 'orders-2' AS key, count(*) AS rows FROM orders UNION ALL SELECT 'orders_2', count(*) FROM customer
UNION ALL SELECT 'Orders 2', count(*) FROM supplier""")
def q_list_datasets(spark, sf):
    """S4 + S5: three datasets under keys that look alike, found again by listing."""
    import uuid
    mark = f"-{uuid.uuid4().hex[:8]}"
    for key, name in (("orders-2", "orders"), ("orders_2", "customer"), ("Orders 2", "supplier")):
        catalog.save_dataset(table(spark, sf, name), key + mark)
    found = [r["key"] for r in catalog.list_datasets(spark).collect() if r["key"].endswith(mark)]
    out = None
    for key in found:
        one = catalog.load_dataset(spark, key).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(key.removesuffix(mark)).alias("key"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


_TYPEMAP = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
  WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
  WHEN 'FLOAT' THEN 'float' WHEN 'BOOLEAN' THEN 'boolean' ELSE lower(data_type) END"""


@query("schema_listing", f"""
SELECT CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name AS "column",
  {_TYPEMAP} AS type FROM information_schema.columns WHERE table_name = 'orders'""")
def q_schema_listing(spark, sf):
    """Column and type list."""
    return inspect.schema_listing(table(spark, sf, "orders"))


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def q_preview(spark, sf):
    """First 10 rows by key."""
    return inspect.preview(table(spark, sf, "orders"), "o_orderkey")
