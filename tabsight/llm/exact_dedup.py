"""Exact deduplication by composable polynomial fingerprints.

A text's bytes are cut into chunks. The hash of a chunk is the polynomial
sum(byte[i] * B**(n-1-i)) mod p, and the hash of a concatenation is
hash(x) * B**len(y) + hash(y): so chunks are hashed wherever they lie, and their
length-shifted hashes are summed. Texts of one chunk are hashed in place; the
chunks of longer ones are dealt out over the cluster first.

Equal fingerprints are only candidates: each text is compared with that of its
group's representative chunk by chunk, as a join of chunks. Groups in which a
comparison fails are split by their texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import ascii_lower, keyed, prepare, row_key, shuffle_partitions, written

#: Two primes below 2**31: byte * power fits 39 bits, so sums of 2**24 products
#: fit 64 bits, and a chunk hash is one dot product.
MODULI = (2147483647, 2147483629)
BASE = 1_000_003


def powers(n: int, p: int):
    """BASE**0 .. BASE**(n-1) mod p by doubling."""
    import numpy as np
    out = np.ones(max(n, 1), dtype=np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have:have + more] = out[:more] * np.uint64(pow(BASE, have, p)) % np.uint64(p)
        have += more
    return out


def chunk_hash(data: bytes, table) -> int:
    """Polynomial hash of one chunk; ``table`` is ``powers(len, p)`` or longer
    with its modulus."""
    import numpy as np
    pw, p = table
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    return int(np.dot(b, pw[:len(b)][::-1]) % np.uint64(p)) if len(b) else 0


def combine(left: int, right: int, right_bytes: int, p: int) -> int:
    """Hash of a concatenation from the hashes of its parts."""
    return (left * pow(BASE, right_bytes, p) + right) % p


def _contribution(p: int, chunk_bytes: int):
    """A chunk's share of its text's hash: its own hash shifted by the bytes that
    follow it. Shares of all chunks add up to the hash of the text."""
    @pandas_udf("long")
    def share(chunk, after):
        table = (powers(chunk_bytes, p), p)
        return chunk.__class__([chunk_hash(c, table) * pow(BASE, int(a), p) % p
                                for c, a in zip(chunk, after, strict=True)], dtype="int64")
    return share


def _chunks(texts: DataFrame, chunk_bytes: int) -> DataFrame:
    """One row for each chunk of the binary column ``__bytes``: number, bytes and
    how many bytes follow. An empty text has one empty chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("__bytes") / F.lit(chunk_bytes))).cast("int")
    rows = texts.withColumn("__no", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("__chunk", F.substring("__bytes", F.col("__no") * chunk_bytes + 1, F.lit(chunk_bytes))) \
        .withColumn("__after", F.greatest(F.lit(0), F.octet_length("__bytes") - (F.col("__no") + 1) * chunk_bytes)) \
        .drop("__bytes")


def fingerprints(df: DataFrame, chunk_bytes: int = 1 << 16, moduli: Sequence[int] = MODULI) -> DataFrame:
    """(doc_id, content key, n_bytes, text_sha256, f0, f1): one row for each row."""
    prepare(df)
    key = ["doc_id", "__h1", "__h2"]
    norm = ascii_lower(F.coalesce("text", F.lit("")))
    base = df.select("doc_id", *row_key(F.col("text")), norm.cast("binary").alias("__bytes"),
                     F.sha2(norm, 256).alias("text_sha256")).withColumn("n_bytes", F.octet_length("__bytes"))
    shares = [_contribution(p, chunk_bytes) for p in moduli]
    short = base.filter(F.col("n_bytes") <= chunk_bytes).select(
        *key, "n_bytes", "text_sha256", *[s("__bytes", F.lit(0)).alias(f"f{k}") for k, s in enumerate(shares)])
    long = base.filter(F.col("n_bytes") > chunk_bytes)
    dealt = _chunks(long, chunk_bytes).repartition(shuffle_partitions(df.sparkSession), *key, "__no")
    # repeated rows give equal shares of a chunk: they count once, and come back by the join
    parts = dealt.select(*key, "__no", *[s("__chunk", "__after").alias(f"f{k}") for k, s in enumerate(shares)]) \
        .groupBy(*key, "__no").agg(*[F.max(f"f{k}").alias(f"f{k}") for k in range(len(moduli))]) \
        .groupBy(*key).agg(*[(F.sum(f"f{k}") % F.lit(p)).alias(f"f{k}") for k, p in enumerate(moduli)])
    renamed = parts.withColumnsRenamed({c: f"{c}_" for c in key})
    on = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("__h1") == F.col("__h1_")) & (F.col("__h2") == F.col("__h2_"))
    return short.unionByName(long.select(*key, "n_bytes", "text_sha256").join(renamed, on)
                             .drop(*renamed.columns[:3]))


def exact_duplicates(df: DataFrame, chunk_bytes: int = 1 << 16, moduli: Sequence[int] = MODULI) -> DataFrame:
    """(doc_id, content key, keep_id, group_size, kept, text_sha256) for each row
    of ``df`` (doc_id, text), dropped ones too.

    Texts are equal when they agree after lower-casing A-Z; a null text counts as
    empty, and all empty texts are one group. The row with the largest doc_id
    stays; among repeated rows with that doc_id exactly one does. A null doc_id is
    below every other; a group of null ids keeps one row and has a null keep_id.
    An empty table gives an empty result; other columns are not read."""
    rows = written(fingerprints(df, chunk_bytes, moduli).withColumn("__rid", F.monotonically_increasing_id()))
    marks = [f"f{k}" for k in range(len(moduli))]
    group = [*marks, "n_bytes"]
    ident = F.struct("doc_id", "__h1", "__h2")
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), F.max(ident).alias("__rep"))
    several = sizes.filter("__n > 1").drop("__n")
    members = written(rows.join(several, group).withColumn("__is_rep", F.col("__rep") == ident))
    texts = keyed(df.select("doc_id", "text")).select(
        "doc_id", "__h1", "__h2", ascii_lower(F.coalesce("text", F.lit(""))).alias("__norm"))
    wanted = members.select("doc_id", "__h1", "__h2", *group, "__is_rep").distinct() \
        .withColumnsRenamed({"doc_id": "__d", "__h1": "__g1", "__h2": "__g2"})
    # the same plan at every size: texts are dealt by key, whatever the groups' number
    found = texts.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h1") == F.col("__g1"))
                       & (F.col("__h2") == F.col("__g2"))).drop("__d", "__g1", "__g2")
    pieces = _chunks(found.withColumn("__bytes", F.col("__norm").cast("binary")).drop("__norm"), chunk_bytes)
    reps = pieces.filter("__is_rep").dropDuplicates([*group, "__no"]) \
        .select(*group, "__no", F.col("__chunk").alias("__rep_chunk"))
    unequal = pieces.filter("not __is_rep").join(reps, [*group, "__no"]) \
        .filter(F.col("__chunk") != F.col("__rep_chunk")).select(*group).distinct()
    unequal = written(unequal)
    split = F.lit(None).cast("string")
    if unequal.isEmpty():
        rows = rows.withColumn("__split", split)
    else:  # fingerprints that differing texts share: these groups are split by their texts
        own = found.join(unequal, group, "left_semi").dropDuplicates(["doc_id", "__h1", "__h2"]) \
            .select(F.col("doc_id").alias("__d"), F.col("__h1").alias("__g1"), F.col("__h2").alias("__g2"),
                    F.col("__norm").alias("__split"))
        rows = written(rows.join(own, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h1") == F.col("__g1"))
                                 & (F.col("__h2") == F.col("__g2")), "left").drop("__d", "__g1", "__g2"))
    pick = F.max(F.struct("doc_id", (-F.col("__rid")).alias("r")))
    classes = rows.groupBy(*group, "__split").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), (-pick["r"]).alias("__kept_rid")) \
        .withColumnsRenamed({c: f"_{c}" for c in [*group, "__split"]})
    on = F.col("__split").eqNullSafe(F.col("___split"))
    for c in group:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return rows.join(classes, on).select(
        "doc_id", "__h1", "__h2", "keep_id", "group_size",
        (F.col("__rid") == F.col("__kept_rid")).alias("kept"), "text_sha256")


def kept_rows(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``df`` that ``decisions`` (doc_id, content key, kept) keeps. Of rows
    that agree in doc_id and text one stays: the least by the content of all columns, so a
    rerun keeps the same."""
    keys = decisions.filter("kept").select(F.col("doc_id").alias("__d"), F.col("__h1").alias("__g1"),
                                           F.col("__h2").alias("__g2")).distinct()
    on = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h1") == F.col("__g1")) & (F.col("__h2") == F.col("__g2"))
    columns = [F.col(f"`{c}`") for c in df.columns]
    return keyed(df).join(keys, on, "left_semi").groupBy("doc_id", "__h1", "__h2") \
        .agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__row")) \
        .select(*[F.col("__row")[c].alias(c) for c in df.columns])
