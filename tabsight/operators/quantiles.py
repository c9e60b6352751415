"""Exact quantiles (linear interpolation, like pandas ``quantile`` and SQL
``quantile_cont``) computed without funnelling a column through one task.

Spark's exact ``percentile`` aggregate keeps a value->count map per group and
merges all of it in a single task, which does not survive a continuous
column at scale. Instead:

1. One aggregate per (group, column): exact ``n``, min, max and a
   ``percentile_approx`` sketch on a grid of ``grid + 1`` probabilities.
   The sketch has a rank error of at most ``n / accuracy``.
2. For every requested probability the target ranks ``floor(pos)`` and
   ``ceil(pos)`` (``pos = p (n - 1)``) are bracketed by two grid values.
   While a bracket may still hold more than ``gather_limit`` distinct values,
   one more pass sketches just the rows inside it and counts its values (each
   pass shrinks it ~grid/4 x). A bracket is done when its ends meet or its rows
   or (approximately counted) distinct values are few: a column with few
   distinct values needs no such pass, however many rows it has.
3. The last step counts the rows below each bracket in one wide aggregate,
   collapses the rows inside it - and no others - to distinct (value, count)
   pairs and ranks those with a window over at most about ``gather_limit`` rows
   per (group, column, p).

Hot values are harmless: rows are pre-aggregated to distinct values before
any ranking, and a bracket spanning one value holds one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_double
from ..session import broadcast_row_limit, checkpoint_dir


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                name: str = "column", value: str = "v") -> DataFrame:
    """Unpivot ``columns`` to (by..., column, v) doubles, dropping NULL/NaN."""
    columns = list(columns)
    wide = df.select(*[F.col(b) for b in by],
                     *[clean_double(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    if len(columns) == 1:
        long = wide.select(*by, F.lit(columns[0]).alias(name), F.col("__c0").alias(value))
    else:
        long = (wide.unpivot(list(by), [f"__c{i}" for i in range(len(columns))], name, value)
                .withColumn(name, _rename(name, columns)))
    return long.where(F.col(value).isNotNull())


def _rename(name: str, columns: Sequence[str]) -> Column:
    expr = None
    for i, c in enumerate(columns):
        cond = F.col(name) == F.lit(f"__c{i}")
        expr = F.when(cond, F.lit(c)) if expr is None else expr.when(cond, F.lit(c))
    return expr


def _attach(data: DataFrame, state: DataFrame, keys: list[str], small_rows: int | None,
            limit: int) -> DataFrame:
    """Equi-join per-(group, column) state onto row data; broadcast when proven small."""
    if small_rows is not None and small_rows <= limit:
        return data.join(F.broadcast(state), keys)
    return data.join(state, keys)


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
              by: Sequence[str] = (), *, accuracy: int = 10_000, grid: int = 200,
              gather_limit: int = 200_000, wide: bool = False, exact: bool = True) -> DataFrame:
    """Exact linear-interpolated quantiles.

    Returns ``(by..., column, p, value)`` (or, with ``wide=True``,
    ``(by..., column, q_<k>...)`` one column per probability index ``k``).
    Columns with no non-null value get NULL. ``exact=False`` returns the
    one-pass ``percentile_approx`` answer (rank error <= n / accuracy).
    """
    by = list(by)
    probs = [float(p) for p in probs]
    if not probs:
        raise ValueError("probs must not be empty")
    spark = df.sparkSession
    limit = broadcast_row_limit(spark)
    long = long_values(df, columns, by)
    keys = by + ["column"]
    nk = len(probs)
    if not exact:
        approx = long.groupBy(*keys).agg(F.percentile_approx("v", probs, accuracy).alias("__q"))
        if wide:
            return approx.select(*keys, *[F.get(F.col("__q"), k).alias(f"q_{k}")
                                          for k in range(nk)])
        return approx.select(*keys, F.posexplode("__q").alias("__k", "value")) \
            .select(*keys, F.get(F.array(*[F.lit(p) for p in probs]), F.col("__k")).alias("p"),
                    "value")
    gather_limit = max(gather_limit, 64)  # the sketches cannot tell fewer values apart
    gp = [j / grid for j in range(grid + 1)]
    slack = 1.0 / accuracy

    stats = (long.groupBy(*keys)
             .agg(F.count("v").alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax"),
                  F.approx_count_distinct("v").alias("nd"),
                  F.percentile_approx("v", gp, accuracy).alias("sk")))
    # bounded: one row per (group, column); materialised once in the shared
    # checkpoint folder (no executor memory held, lineage cut for later passes)
    checkpoint_dir(spark)
    stats = stats.checkpoint(eager=True)
    n_state = None if by else len(columns)

    # target ranks (one projection: chained withColumn re-analyses the plan each time)
    ranks = []
    for k, p in enumerate(probs):
        pos = (F.col("n") - 1).cast("double") * F.lit(p)
        ranks += [F.floor(pos).alias(f"r0_{k}"), F.ceil(pos).alias(f"r1_{k}"),
                  (pos - F.floor(pos)).alias(f"fr_{k}")]
    state = _bracket(stats.select("*", *ranks), nk, grid, slack, base_n=F.col("n"),
                     below=F.lit(0))

    last = None
    while True:
        row = state.agg(F.count(F.lit(1)).alias("__n"),
                        *[F.max(f"bound_{k}") for k in range(nk)],
                        *[F.sum(f"bound_{k}") for k in range(nk)]).first()
        n_state = row["__n"] if n_state is None else n_state
        bound = max((b for b in list(row)[1:1 + nk] if b is not None), default=None)
        total = sum(b for b in list(row)[1 + nk:] if b is not None)
        if bound is None or bound <= gather_limit:
            break
        if last is not None and total >= last:
            raise RuntimeError("quantile brackets no longer shrink; raise accuracy or gather_limit")
        last = total
        joined = _attach(long, state.select(*keys, *[F.col(f"lo_{k}") for k in range(nk)],
                                            *[F.col(f"hi_{k}") for k in range(nk)]),
                         keys, n_state, limit)
        aggs = []
        for k in range(nk):
            # the ends are counted apart: a hot value that is an end says no more
            inside = (F.col("v") > F.col(f"lo_{k}")) & (F.col("v") < F.col(f"hi_{k}"))
            aggs += [F.count_if(F.col("v") <= F.col(f"lo_{k}")).alias(f"below_{k}"),
                     F.count_if(inside).alias(f"inb_{k}"),
                     F.approx_count_distinct(F.when(inside, F.col("v"))).alias(f"nd_{k}"),
                     F.percentile_approx(F.when(inside, F.col("v")), gp, accuracy).alias(f"sk_{k}")]
        refined = joined.groupBy(*keys).agg(*aggs)
        state = state.join(refined, keys)
        for k in range(nk):
            state = _bracket(state, nk, grid, slack, base_n=F.col(f"inb_{k}"),
                             below=F.col(f"below_{k}"), only=k, sketch=f"sk_{k}", distinct=f"nd_{k}",
                             edge_lo=F.col(f"lo_{k}"), edge_hi=F.col(f"hi_{k}"))
        state = state.drop(*[f"{c}_{k}" for k in range(nk) for c in ("below", "inb", "nd", "sk")])
        # the state is one row per (group, column): checkpoint it to the shared
        # folder so the lineage of the refinement loop stays one pass deep
        checkpoint_dir(spark)
        state = state.checkpoint(eager=True)

    # rows below each bracket: one wide aggregate; rows inside: distinct values
    tcols = [f"{c}_{k}" for k in range(nk) for c in ("lo", "hi", "r0", "r1", "fr")]
    joined = _attach(long, state.select(*keys, *tcols), keys, n_state, limit)
    below = joined.groupBy(*keys).agg(*[F.count_if(F.col("v") < F.col(f"lo_{k}")).alias(f"b_{k}")
                                        for k in range(nk)])
    # one row per (group, column), like the state
    below = below.select(*keys, F.posexplode(F.array(*[F.col(f"b_{k}") for k in range(nk)]))
                         .alias("k", "below"))
    tgt = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"),
                             F.col(f"lo_{k}").alias("lo"), F.col(f"hi_{k}").alias("hi"),
                             F.col(f"r0_{k}").alias("r0"), F.col(f"r1_{k}").alias("r1"),
                             F.col(f"fr_{k}").alias("fr"))
                    for k, p in enumerate(probs)])
    inside = F.filter(tgt, lambda t: (F.col("v") >= t["lo"]) & (F.col("v") <= t["hi"]))
    rel = (joined.select(*keys, "v", F.explode(inside).alias("t"))
           .select(*keys, "t.k", "t.p", "t.r0", "t.r1", "t.fr", F.col("v").alias("w")))
    grouped = rel.groupBy(*keys, "k", "p", "r0", "r1", "fr", "w") \
        .agg(F.count(F.lit(1)).alias("cnt"))
    grouped = _attach(grouped, below, [*keys, "k"], n_state and n_state * nk, limit)
    w = Window.partitionBy(*keys, "k").orderBy("w") \
        .rowsBetween(Window.unboundedPreceding, 0)
    ranked = (grouped.withColumn("end", F.col("below") + F.sum("cnt").over(w))
              .withColumn("start", F.col("end") - F.col("cnt")))
    hit0 = (F.col("start") <= F.col("r0")) & (F.col("r0") < F.col("end"))
    hit1 = (F.col("start") <= F.col("r1")) & (F.col("r1") < F.col("end"))
    out = (ranked.where(hit0 | hit1)
           .groupBy(*keys, "k", "p", "fr")
           .agg(F.max(F.when(hit0, F.col("w"))).alias("v0"),
                F.max(F.when(hit1, F.col("w"))).alias("v1")))
    out = out.select(*keys, "k", "p",
                     (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("fr")).alias("value"))
    if wide:
        return (out.groupBy(*keys)
                .agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(f"q_{k}")
                       for k in range(nk)]))
    return out.select(*keys, "p", "value")


def _bracket(state: DataFrame, nk: int, grid: int, slack: float, base_n: Column, below: Column,
             only: int | None = None, sketch: str = "sk", distinct: str = "nd", edge_lo: Column | None = None,
             edge_hi: Column | None = None) -> DataFrame:
    """Pick [lo_k, hi_k] from a sketch on ``grid`` steps over ``base_n`` rows."""
    ks = range(nk) if only is None else [only]
    new = {}
    for k in ks:
        m = base_n.cast("double")
        some = F.greatest(m, F.lit(1.0))
        r0 = F.col(f"r0_{k}") - below
        r1 = F.col(f"r1_{k}") - below
        err = m * F.lit(slack) + 1
        j_lo = F.greatest(F.lit(0), F.floor((r0 - err) * grid / some).cast("int") - 1)
        j_hi = F.least(F.lit(grid), F.ceil((r1 + 1 + err) * grid / some).cast("int") + 1)
        first = F.col("vmin") if edge_lo is None else edge_lo
        last = F.col("vmax") if edge_hi is None else edge_hi
        lo = F.when(r0 >= m, last).when(j_lo <= 0, first).otherwise(F.get(F.col(sketch), j_lo))
        hi = F.when(r1 < 0, first).when(j_hi >= grid, last).otherwise(F.get(F.col(sketch), j_hi))
        # distinct values are estimated within a few percent; the ends count as two
        bound = F.least(m, (j_hi - j_lo).cast("double") * m / grid + 2 * err,
                        F.col(distinct) * 1.2 + 2) + 2
        new[f"lo_{k}"], new[f"hi_{k}"] = lo, hi
        new[f"bound_{k}"] = F.when(lo == hi, F.lit(1.0)).otherwise(F.coalesce(bound, F.lit(0.0)))
    keep = [F.col(c) for c in state.columns if c not in new]
    return state.select(*keep, *[e.alias(n) for n, e in new.items()])


def median(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return quantiles(df, columns, [0.5], by).withColumnRenamed("value", "median").drop("p")


def iqr_bounds(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
               factor: float = 1.5) -> DataFrame:
    """(by..., column, q1, q3, iqr, lower_bound, upper_bound) per column."""
    q = quantiles(df, columns, [0.25, 0.75], by, wide=True)
    return (q.withColumnRenamed("q_0", "q1").withColumnRenamed("q_1", "q3")
            .withColumn("iqr", F.col("q3") - F.col("q1"))
            .withColumn("lower_bound", F.col("q1") - F.lit(factor) * F.col("iqr"))
            .withColumn("upper_bound", F.col("q3") + F.lit(factor) * F.col("iqr")))
