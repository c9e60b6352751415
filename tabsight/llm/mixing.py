"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies,
``target / source_size``. The whole part is taken as it is; the fractional parts
are rounded by the pivotal method: two documents meet, probability mass moves at
random from one to the other until one of them is integral, and the other goes
on to the next meeting. Every document keeps its expected number of copies, and
the number of copies in a source hardly varies. Documents meet in order of size,
so that the words taken hardly vary either.

The meetings form a reduction tree: documents are ranked within their source
(see ``rank_within``) and cut into blocks of ``block`` neighbours; each block
leaves one fractional document at most; the leftovers of ``fan_in`` blocks meet
at the next level, until one is left for each source, which is rounded by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, prepare, rank_within, row_key, written

#: Probabilities this near to 0 or 1 count as integral.
EPS = 1e-9


def word_sizes(df: DataFrame) -> DataFrame:
    """(doc_id, source, content key, size): words of the whole text, null is 0."""
    return df.select("doc_id", "source", *row_key(F.col("text")),
                     F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0))
                     .cast("long").alias("size"))


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
                   max_repeat: float = 2.0) -> DataFrame:
    """(source, s_idx, weight, source_size, target): one row for each source.

    Sources in order of code points, null last, take ``weights`` in turn. They
    share ``share`` times all words by weight; a target stops at ``max_repeat``
    times its source's size and the excess is shared again by weight."""
    if share > max_repeat:
        raise ValueError("share must not exceed max_repeat: no targets could reach it")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("__one", F.lit(0).cast("long"))
    ranked = rank_within(written(per), "__one", [F.col("source").isNull(), F.col("source")])
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = written(ranked.select("source", F.col("rank").alias("s_idx"), w.alias("weight"), "source_size"))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * float(max_repeat)
    level, capped = 0.0, -1
    while total:  # each turn caps at least one more source, or is the last
        full = F.col("weight") * level >= cap if capped >= 0 else F.lit(False)
        fixed, free, n = rows.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
                                  F.sum(full.cast("long"))).first()
        if n == capped or not free:
            break
        capped, level = n, (share * total - fixed) / free
    return rows.withColumn("target", F.least(cap, F.col("weight") * F.lit(float(level))))


def _meet(p, draw):
    """Pivotal rounding of the list ``p`` in place; the index of what stays
    fractional, or -1."""
    open_at = -1
    for j, b in enumerate(p):
        if b <= EPS or b >= 1 - EPS:
            p[j] = float(round(b))
            continue
        if open_at < 0:
            open_at = j
            continue
        a = p[open_at]
        total = a + b
        if total < 1:  # one of the two gives all it has
            winner, loser = (j, open_at) if draw() * total < b else (open_at, j)
            p[winner], p[loser], rest = total, 0.0, winner
        else:  # one of the two is filled up
            filled, rest = (open_at, j) if draw() * (2 - total) < 1 - b else (j, open_at)
            p[filled], p[rest] = 1.0, total - 1
        if EPS < p[rest] < 1 - EPS:
            open_at = rest
        else:
            p[rest], open_at = float(round(p[rest])), -1
    return open_at


def mix(df: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_repeat: float = 2.0,
        seed: int = 17, block: int = 1024, fan_in: int = 64) -> DataFrame:
    """How often each row of ``df`` (doc_id, text, source) is taken: its doc_id,
    source, content key, size, source_size, target, copies and taken words.

    Null texts and texts without a word have size 0; they take copies like any
    other but add no words. A null source is a source, the last one. Repeated
    rows are rows of their own. Rows with a null doc_id are mixed like others.
    An empty table gives an empty result. A source of size 0 has target 0 and
    no copies. Other columns are not read. Equal input gives equal results
    however it is partitioned: order and draws depend on content only."""
    spark = prepare(df)
    sized = written(word_sizes(df))
    targets = written(source_targets(sized, weights, share, max_repeat))
    rows = sized.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))) \
        .drop("__s", "weight").withColumn(
            "want", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    ranked = rank_within(written(rows), "s_idx", [-F.col("size"), F.col("__h1"), F.col("__h2"), F.col("doc_id")])
    state = ranked.withColumn("base", F.floor("want")).withColumn("p", F.col("want") - F.floor("want")) \
        .withColumn("blk", F.floor(F.col("rank") / block))

    def settle(level):
        def run(key, table):
            import numpy as np
            import pyarrow as pa
            table = table.sort_by("rank")
            p = table.column("p").to_pylist()
            rng = np.random.Generator(np.random.Philox([seed, level, key[0].as_py(), key[1].as_py()]))
            left = _meet(p, rng.random)
            table = table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))
            return table.append_column("open", pa.array(np.arange(len(p)) == left))
        return run

    done, level = [], 0
    schema = state.withColumn("open", F.lit(True)).schema
    while True:
        met = written(state.groupBy("s_idx", "blk").applyInArrow(settle(level), schema))
        done.append(met.filter(~F.col("open")))
        left = met.filter("open").drop("open")
        top = left.agg(F.max("blk")).first()[0]
        if not top:  # one leftover for each source, or none at all
            break
        state, level = left.withColumn("blk", F.floor(F.col("blk") / fan_in)), level + 1
    coin = F.pmod(F.xxhash64(F.lit(seed), "s_idx", "__h1", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    out = left.withColumn("p", (coin < F.col("p")).cast("double"))
    for d in done:
        out = out.unionByName(d.drop("open"))
    copies = (F.col("base") + F.round("p")).cast("long")
    return out.select("doc_id", "source", "__h1", "__h2", "size", "source_size", "target", copies.alias("copies"),
                      (copies * F.col("size")).alias("taken"))


def mixed_rows(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` repeated as :func:`mix` decides, with its columns.

    Rows are told apart by doc_id, text and source. Those that agree in all three share
    their copies evenly, the odd ones going to the first rows by the content of all columns,
    so a rerun gives the same rows."""
    from .common import keyed
    name = ["doc_id", "__h1", "__h2", "source"]
    copies = written(mix(df, **options).groupBy(*name).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
                     .withColumnsRenamed({c: f"__of_{c}" for c in name}))
    on = F.col("doc_id").eqNullSafe(F.col("__of_doc_id")) & F.col("source").eqNullSafe(F.col("__of_source")) \
        & (F.col("__h1") == F.col("__of___h1")) & (F.col("__h2") == F.col("__of___h2"))
    columns = [F.col(f"`{c}`") for c in df.columns]
    found = keyed(df).join(copies.filter("__copies > 0"), on).select(
        F.struct(*columns).alias("__row"), "__copies", "__rows", F.xxhash64(*name).alias("__by"), F.xxhash64(*columns).alias("__content"))
    shared = F.expr("__copies div __rows")
    out = found.filter("__rows = 1").select("__row", F.col("__copies").alias("__times"))
    if not copies.filter("__rows > 1").isEmpty():
        ranked = rank_within(written(found.filter("__rows > 1")), "__by", [F.col("__content")])
        out = out.unionByName(ranked.select("__row", (shared + (F.col("rank") < F.col("__copies") % F.col("__rows")).cast("long")).alias("__times")))
    return out.filter("__times > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__times")))) \
        .select(*[F.col("__row")[c].alias(c) for c in df.columns])
