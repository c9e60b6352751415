"""ML preparation (M1-M5): label encoding, mean imputation, target encoding,
an exactly sized deterministic split, standardisation and CV folds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import categorical_columns, numeric_columns
from ..operators.profile import with_scalars
from ..operators.ranks import dense_index, positions
from ..session import broadcast_byte_limit, checkpoint_dir

MISSING_LABEL = "nan"


def label_encode(df: DataFrame, columns: Sequence[str] | None = None,
                 exclude: Sequence[str] = ()) -> tuple[DataFrame, dict[str, DataFrame]]:
    """M1: text/bool columns -> 0-based codes of their sorted string values
    (missing becomes the category 'nan'). Returns (encoded df, {col: mapping})."""
    cols = list(columns) if columns is not None else categorical_columns(df, tuple(exclude))
    limit = broadcast_byte_limit(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    out, maps = df, {}
    for c in cols:
        text = F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LABEL))
        out = out.withColumn(c, text)
        mapping = dense_index(out.select(c), c).checkpoint(eager=True)
        size = mapping.agg(F.sum(F.octet_length("value") + 32)).first()[0] or 0
        m = F.broadcast(mapping) if size <= limit else mapping
        out = (out.join(m.withColumnRenamed("value", c), c, "left")
               .withColumn(c, F.col("code").cast("int")).drop("code")
               .select(*df.columns))
        maps[c] = mapping
    return out, maps


def impute_mean(df: DataFrame, columns: Sequence[str] | None = None,
                fit_on: DataFrame | None = None) -> DataFrame:
    """M2: replace NULL/NaN numerics by the column mean of ``fit_on`` (default:
    the whole frame, as the reference does before splitting)."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    src = fit_on if fit_on is not None else df
    means = src.agg(*[F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")))
                      .alias(f"__m{i}") for i, c in enumerate(cols)])
    j = with_scalars(df, means)
    sel = []
    for f in df.schema.fields:
        if f.name in cols:
            i = cols.index(f.name)
            v = F.col(f.name).cast("double")
            filled = F.when(v.isNull() | F.isnan(v), F.col(f"__m{i}")).otherwise(v)
            sel.append(filled.alias(f.name))
        else:
            sel.append(F.col(f.name))
    return j.select(*sel)


def encode_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame | None]:
    """M3: a text target becomes 0-based codes; the mapping keeps the labels."""
    if isinstance(df.schema[target].dataType, (T.StringType, T.BooleanType)):
        enc, maps = label_encode(df, [target])
        return enc, maps[target]
    return df, None


def hash_key(key: str, seed: int = 42):
    """md5 of the seed and the key; a null key has a hash of its own."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("\0null"))))


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """``df`` plus a unique row number (from 0) in the order of the rows' content:
    128 bits of hash, then a row id for equal rows, which may swap places without
    any effect. Written to the checkpoint folder, so the numbers stay."""
    hashed = df.withColumn("__k1", F.xxhash64(*df.columns)).withColumn("__k2", F.xxhash64(F.lit(1), *df.columns)) \
        .withColumn("__k3", F.monotonically_increasing_id())
    checkpoint_dir(df.sparkSession)
    numbered = positions(hashed.checkpoint(eager=True), ["__k1", "__k2", "__k3"])
    return numbered.withColumn(name, F.col("pos") - 1).drop("__k1", "__k2", "__k3", "pos") \
        .checkpoint(eager=True)


def split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42,
          limit: int = 20_000, keys_of: DataFrame | None = None) -> DataFrame:
    """M4: add ``is_test``: exactly ceil(test_size * n) rows, the smallest by
    (md5(seed:key), key), a null key after others. Where rows share a key, the last key
    that fits in part gives as many of its rows as are missing. The threshold pair is found
    by narrowing an md5 hex prefix (one bounded 65,536-row count per step) until at most
    ``limit`` rows, or rows of one hash, are left; these are counted by key - no global
    sort, no single task, and no key's rows in one place. The keys are read from ``keys_of``
    (``df``), which has the same keys where reading ``df`` takes more work."""
    base = df.withColumn("__h", hash_key(key, seed))
    scope = base if keys_of is None else keys_of.select(key).withColumn("__h", hash_key(key, seed))
    n = scope.count()
    t = int(math.ceil(test_size * n))
    if t <= 0:
        return base.withColumn("is_test", F.lit(False)).drop("__h")
    if t >= n:
        return base.withColumn("is_test", F.lit(True)).drop("__h")
    prefix, below = "", 0
    while True:
        plen = len(prefix) + 4
        counts = (scope.groupBy(F.substring("__h", 1, plen).alias("p"))
                  .agg(F.count(F.lit(1)).alias("c")).orderBy("p").collect())
        need = t - below
        cum = 0
        for r in counts:
            if cum + r["c"] >= need:
                prefix = r["p"]
                bucket = r["c"]
                break
            cum += r["c"]
        below += cum
        scope = scope.where(F.col("__h").startswith(prefix))
        if bucket <= limit or plen >= 32:
            break
    missing = F.col(key).isNull()
    keys = scope.groupBy("__h", key).agg(F.count(F.lit(1)).alias("__c")).orderBy("__h", missing, key).collect()
    for last in keys:
        if below + last["__c"] >= t:
            break
        below += last["__c"]
    hstar, kstar = F.lit(last["__h"]), F.lit(last[key]).cast(df.schema[key].dataType)
    at = (F.col("__h") == hstar) & F.col(key).eqNullSafe(kstar)
    less = ~missing if last[key] is None else F.coalesce(F.col(key) < kstar, F.lit(False))
    before = (F.col("__h") < hstar) | ((F.col("__h") == hstar) & less)
    if below + last["__c"] == t:
        return base.withColumn("is_test", before | at).drop("__h")
    # the key's rows are more than the test part has room for: number them
    some = with_row_key(base.where(at), "__n").withColumn("is_test", F.col("__n") < t - below).drop("__n")
    rest = base.where(~at).withColumn("is_test", before)
    return rest.unionByName(some).drop("__h")


def standardize(train: DataFrame, test: DataFrame | None, columns: Sequence[str]
                ) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """M5: (x - mean) / population std fitted on ``train``; a zero std leaves
    x - mean (scale 1). Returns (train, test, fitted stats row)."""
    stats = train.agg(*[x for i, c in enumerate(columns) for x in
                        (F.avg(c).alias(f"__mu{i}"), F.stddev_pop(c).alias(f"__sd{i}"))])

    def apply(d: DataFrame) -> DataFrame:
        j = with_scalars(d, stats)
        sel = []
        for f in d.schema.fields:
            if f.name in columns:
                i = columns.index(f.name)
                sd = F.col(f"__sd{i}")
                scale = F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
                sel.append(((F.col(f.name) - F.col(f"__mu{i}")) / scale).alias(f.name))
            else:
                sel.append(F.col(f.name))
        return j.select(*sel)

    return apply(train), (apply(test) if test is not None else None), stats


def assign_folds(df: DataFrame, k: int, key: str, label: str | None = None,
                 order_hash: bool = True, seed: int = 42) -> DataFrame:
    """V7 folds on the training part, unshuffled in split order.

    With ``label`` (classification): stratified round robin - the j-th row of
    each class (by split order) goes to fold (j - 1) mod k. Without
    (regression): contiguous blocks, the first n mod k folds one row larger.
    Positions come from ``positions`` (range partitioned), never one task."""
    k = int(k)
    if k < 2:
        raise ValueError(f"cross-validation takes 2 folds or more, not {k}")
    d = df.withColumn("__h", hash_key(key, seed)) if order_hash else df
    order = ["__h", key] if order_hash else [key]
    if label is not None:
        p = positions(d, order, by=[label])
        out = p.withColumn("fold", ((F.col("pos") - 1) % k).cast("int"))
    else:
        n = d.count()
        big, small = n // k + 1, n // k
        n_big = n % k
        p = positions(d, order)
        z = F.col("pos") - 1
        out = p.withColumn("fold", F.when(z < big * n_big, (z / big).cast("int"))
                           .otherwise((F.lit(n_big) + ((z - big * n_big) / max(small, 1)).cast("int"))
                                      .cast("int")))
    return out.drop("pos", *(["__h"] if order_hash else []))
