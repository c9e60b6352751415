"""CSV / JSON ingest and export.

CSV is read as text once; NA tokens become NULL; each column's type is chosen
from ``try_cast`` success counts computed for ALL columns in ONE aggregate
(bigint, else double, else boolean, else string); the result is cast once and
the schema is frozen for later reads. NaN in float columns becomes NULL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import FLOATING, clean_double
from ..session import checkpoint_dir
from .csv_ranges import UnbalancedQuote, read_records

# The default missing-value tokens of the reference's CSV
# parser (pandas ``read_csv`` default ``na_values``), as documented.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")

INTEGER_TEXT = "^[+-]?[0-9]+$"
# a cast also takes '12F' or '7d' for numbers: only text of this form is one
NUMBER_TEXT = r"(?i)^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?$|^[+-]?inf(?:inity)?$"
BOOL_TRUE = ("True", "true", "TRUE")
BOOL_FALSE = ("False", "false", "FALSE")


def double_text(column: str):
    """The number that a text column holds, NULL where it holds none."""
    return F.when(F.col(column).rlike(NUMBER_TEXT), F.expr(f"try_cast(`{column}` AS DOUBLE)"))


def null_tokens(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    """Map NA tokens (exact match) to NULL in every string column."""
    toks = list(tokens)
    return df.select(*[
        F.when(F.col(f.name).isin(toks), F.lit(None).cast("string")).otherwise(F.col(f.name))
        .alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields])


def infer_types(text: DataFrame) -> DataFrame:
    """(column, ordinal, non_null, inferred) from one aggregate over text columns."""
    cols = text.columns
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c)
        aggs += [F.count(v).alias(f"n{i}"),
                 F.count_if(v.rlike(INTEGER_TEXT)
                            & F.expr(f"try_cast(`{c}` AS BIGINT)").isNotNull()).alias(f"l{i}"),
                 F.count(double_text(c)).alias(f"d{i}"),
                 F.count_if(v.isin(list(BOOL_TRUE + BOOL_FALSE))).alias(f"b{i}")]
    agg = text.agg(*aggs)
    structs = []
    for i, c in enumerate(cols):
        n = F.col(f"n{i}")
        kind = (F.when(n == 0, "string").when(F.col(f"l{i}") == n, "bigint")
                .when(F.col(f"d{i}") == n, "double").when(F.col(f"b{i}") == n, "boolean")
                .otherwise("string"))
        structs.append(F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"),
                                n.alias("non_null"), kind.alias("inferred")))
    return agg.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def apply_types(text: DataFrame, types: dict[str, str]) -> DataFrame:
    out = []
    for c in text.columns:
        t = types.get(c, "string")
        if t == "boolean":
            out.append(F.when(F.col(c).isin(list(BOOL_TRUE)), F.lit(True))
                       .when(F.col(c).isin(list(BOOL_FALSE)), F.lit(False)).alias(c))
        elif t == "double":
            out.append(clean_double(double_text(c)).alias(c))
        elif t == "string":
            out.append(F.col(c))
        else:
            out.append(F.expr(f"try_cast(`{c}` AS {t.upper()})").alias(c))
    return text.select(*out)


# doubled quotes inside quoted fields, on both sides
CSV_QUOTING = {"quote": '"', "escape": '"'}


#: A line that ends inside a quoted field: a field that starts with a quote and has no closing one.
OPEN_LINE = r'^(?:(?:"(?:[^"]|"")*+"[^,]*+|(?!")[^,]*+),)*+"(?:[^"]|"")*+$'


def _check_lines(spark: SparkSession, path: str) -> None:
    """Raise if a quoted field is open at the end of a line: its record goes on in the
    next line, and reading line by line would split it."""
    bad = spark.read.text(path).where(F.col("value").rlike(OPEN_LINE)).limit(1).collect()
    if bad:
        raise UnbalancedQuote(f"quoted field open at the end of a line of {path}: {bad[0][0][:80]!r}; "
                              "read it with multi_line=True")


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "ranges")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _records_text(spark: SparkSession, path: str, names: list[str] | None, header: bool) -> DataFrame:
    """The records at ``path`` as text columns; names from the first record of the first
    file, or positions (_c0, _c1, ..), unless given. Missing fields are null, surplus ones dropped."""
    records = read_records(spark, path, _written)
    if names is None:
        top = records.where("first").limit(1).collect()  # one record
        if not top:
            return spark.createDataFrame([], T.StructType([]))
        names = [x.removeprefix("\ufeff") for x in top[0]["fields"]] if header else [f"_c{i}" for i in range(len(top[0]["fields"]))]
    rows = records.where(~F.col("first")) if header else records
    return rows.select(*[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             tokens=NA_TOKENS, header: bool = True, multi_line: bool = False) -> DataFrame:
    """Read CSV; with ``schema`` no inference happens (frozen schema).

    ``multi_line=True`` reads quoted fields that hold line breaks, by byte ranges in
    parallel (see ``csv_ranges``). Otherwise files are split by lines, and a line that ends
    inside a quoted field raises ``UnbalancedQuote`` instead of being cut in two. A quote
    inside a plain field is a character of it."""
    names = [f.name for f in schema.fields] if schema is not None else None
    if multi_line:
        text = _records_text(spark, path, names, header)
    else:
        _check_lines(spark, path)
        reader = spark.read.options(**CSV_QUOTING).option("header", header).option("mode", "PERMISSIVE")
        if schema is not None:
            # parse as text first so NA tokens never break typed parsing
            reader = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
        text = reader.csv(path)
    text = null_tokens(text, tokens)
    if schema is not None:
        return text.select(*[_cast_text(f) for f in schema.fields])
    types = {r["column"]: r["inferred"] for r in infer_types(text).collect()}
    return apply_types(text, types)


def _cast_text(f: T.StructField):
    c = F.col(f.name)
    if isinstance(f.dataType, T.StringType):
        return c
    if isinstance(f.dataType, T.BooleanType):
        return (F.when(c.isin(list(BOOL_TRUE)), F.lit(True))
                .when(c.isin(list(BOOL_FALSE)), F.lit(False)).alias(f.name))
    if isinstance(f.dataType, T.TimestampNTZType):
        return F.to_timestamp_ntz(c, F.lit(TS_NTZ)).alias(f.name)
    if isinstance(f.dataType, FLOATING):
        return clean_double(double_text(f.name)).cast(f.dataType).alias(f.name)
    return F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name)


# microsecond timestamps survive text round trips
TS_NTZ = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
TS_TZ = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """CSV export with a header row (one file per task); quotes inside quoted
    fields are doubled."""
    (df.write.mode(mode).options(**CSV_QUOTING).option("header", True).option("timestampNTZFormat", TS_NTZ)
     .option("timestampFormat", TS_TZ).csv(path))
    return path


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """S7 sink: JSON records, one object per line."""
    (df.write.mode(mode).option("timestampNTZFormat", TS_NTZ)
     .option("timestampFormat", TS_TZ).json(path))
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S7 source: JSON records with a frozen schema (no second inference)."""
    return (spark.read.schema(schema).option("timestampNTZFormat", TS_NTZ)
            .option("timestampFormat", TS_TZ).json(path))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tabsight-io/{name}-{uuid.uuid4().hex}"
