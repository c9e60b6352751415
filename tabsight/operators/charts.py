"""The numbers behind each chart (drawing is left to the caller).

Every chart is an aggregate: histograms are ``groupBy(bin).count()`` against
a bin grid generated from ``spark.range`` (so empty bins appear), box plots
come from exact quartiles plus one filtered min/max pass, scatter plots are
2-D bin counts (never every point) with a least-squares line from
``regr_slope``/``regr_intercept``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import categorical_columns, clean_double, numeric_columns
from .profile import numeric_moments, top_k, value_counts, with_scalars
from ..session import checkpoint_dir
from .quantiles import long_values, quantiles


def _bin_of(v: Column, lo: Column, width: Column, bins: Column) -> Column:
    """Equal-width bin, last bin closed; a zero-width range puts all in bin 0."""
    raw = F.floor(F.try_divide(v - lo, width)).cast("long")
    return F.when(width > 0, F.least(raw, (bins - 1).cast("long"))).otherwise(F.lit(0).cast("long"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, lower, upper, count, mean, median) for ``bins`` equal-width bins
    over [min, max] of the non-null values."""
    v = clean_double(column)
    base = df.select(v.alias("v")).where(F.col("v").isNotNull())
    stats = base.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"))
    med = quantiles(df, [column], [0.5], wide=True).select(F.col("q_0").alias("median"))
    return _histogram_from(base, stats, F.lit(bins), extra=med)


def _histogram_from(base: DataFrame, stats: DataFrame, bins: Column,
                    extra: DataFrame | None = None) -> DataFrame:
    stats = stats.withColumn("bins", bins.cast("long")) \
        .withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    counted = (with_scalars(base, stats.select("lo", "width", "bins"))
               .select(_bin_of(F.col("v"), F.col("lo"), F.col("width"), F.col("bins")).alias("bin"))
               .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    # the bin grid: one row per bin, size fixed by the bin count (not the data)
    grid = (stats.select(F.explode(F.sequence(F.lit(0).cast("long"),
                                              F.greatest(F.col("bins") - 1, F.lit(0)).cast("long")))
                         .alias("bin"), "lo", "width", *[c for c in stats.columns
                                                         if c not in ("lo", "width", "bin")]))
    out = (grid.join(counted, "bin", "left")
           .select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("lower"),
                   (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("upper"),
                   F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
                   *[c for c in stats.columns if c in ("mean",)]))
    if extra is not None:
        out = with_scalars(out, extra)
    return out


def auto_bins(n: int, iqr: float | None, lo: float, hi: float) -> int:
    """numpy 'auto' rule: the smaller of the Freedman-Diaconis and Sturges widths."""
    if n <= 0 or hi is None or lo is None or hi <= lo:
        return 1
    rng = hi - lo
    sturges = rng / (math.log2(n) + 1.0)
    fd = 2.0 * (iqr or 0.0) * n ** (-1.0 / 3.0)
    width = min(fd, sturges) if fd > 0 else sturges
    return max(1, int(math.ceil(rng / width)))


def _auto_bins_col(n: Column, iqr: Column, lo: Column, hi: Column) -> Column:
    rng = hi - lo
    sturges = rng / (F.log2(n) + 1.0)
    fd = 2.0 * F.coalesce(iqr, F.lit(0.0)) * F.pow(n, -1.0 / 3.0)
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    return F.when((n <= 0) | (hi <= lo), F.lit(1)) \
        .otherwise(F.greatest(F.lit(1), F.ceil(rng / width)))


def histogram_auto(df: DataFrame, column: str, iqr: DataFrame | None = None) -> DataFrame:
    """C2 bins: width = min(Freedman-Diaconis, Sturges) from n, IQR and range.
    ``iqr``: one row (iqr) if the quartiles are known already."""
    v = clean_double(column)
    base = df.select(v.alias("v")).where(F.col("v").isNotNull())
    q = iqr if iqr is not None else quantiles(df, [column], [0.25, 0.75], wide=True) \
        .select((F.col("q_1") - F.col("q_0")).alias("iqr"))
    stats = with_scalars(base.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"),
                                  F.max("v").alias("hi")), q)
    bins = _auto_bins_col(F.col("n"), F.col("iqr"), F.col("lo"), F.col("hi"))
    return _histogram_from(base, stats, bins).drop("mean")


def kde(df: DataFrame, column: str, gridsize: int = 200, cut: float = 3.0,
        fine_bins: int = 1024) -> DataFrame:
    """C2 density: Gaussian KDE with Scott's bandwidth (h = std * n^(-1/5)),
    evaluated on ``gridsize`` points over [min - cut h, max + cut h]. The data
    are pre-binned into ``fine_bins`` equal bins (bin centre x count), so the
    evaluation cost is fixed by the grid, not by the data."""
    v = clean_double(column)
    base = df.select(v.alias("v")).where(F.col("v").isNotNull())
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"),
                     F.max("v").alias("hi"), F.stddev_samp("v").alias("sd")) \
        .withColumn("h", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))) \
        .withColumn("fw", (F.col("hi") - F.col("lo")) / fine_bins)
    binned = (with_scalars(base, stats.select("lo", "fw"))
              .select(_bin_of(F.col("v"), F.col("lo"), F.col("fw"), F.lit(fine_bins)).alias("b"))
              .groupBy("b").agg(F.count(F.lit(1)).alias("c")))
    centres = with_scalars(binned, stats).select(
        (F.col("lo") + (F.col("b") + 0.5) * F.col("fw")).alias("xc"), "c", "n", "h", "lo", "hi")
    # each occupied fine bin contributes to the fixed grid of evaluation points
    g0 = F.col("lo") - cut * F.col("h")
    step = (F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (gridsize - 1)
    contrib = centres.select(F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("g"),
                             "xc", "c", "n", "h", g0.alias("g0"), step.alias("step"))
    x = F.col("g0") + F.col("g") * F.col("step")
    z = (x - F.col("xc")) / F.col("h")
    dens = F.col("c") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return (contrib.where(F.col("h") > 0)
            .groupBy("g").agg(F.first(x).alias("x"), F.sum(dens).alias("density"))
            .select(F.col("g").cast("bigint").alias("point"), "x", "density"))


def boxplot(df: DataFrame, columns: Sequence[str] | str | None = None,
            by: Sequence[str] = ()) -> DataFrame:
    """q1, median, q3, fences, whiskers (extreme values inside the
    fences) and the number of fliers, per (group, column)."""
    by = list(by)
    if isinstance(columns, str):
        from ..functions.columns import subset
        columns = subset(columns, numeric_columns(df, tuple(by)))
    cols = list(columns) if columns is not None else numeric_columns(df, tuple(by))
    keys = by + ["column"]
    checkpoint_dir(df.sparkSession)
    q = quantiles(df, cols, [0.25, 0.5, 0.75], by, wide=True).checkpoint(eager=True)
    b = (q.select(*keys, F.col("q_0").alias("q1"), F.col("q_1").alias("median"),
                  F.col("q_2").alias("q3"))
         .withColumn("iqr", F.col("q3") - F.col("q1"))
         .withColumn("lower_bound", F.col("q1") - 1.5 * F.col("iqr"))
         .withColumn("upper_bound", F.col("q3") + 1.5 * F.col("iqr")))
    long = long_values(df, cols, by)
    # one row per (group, column): broadcast after checking its (materialised) size
    from ..session import broadcast_row_limit
    small = not by or q.count() <= broadcast_row_limit(df.sparkSession)
    bounds = F.broadcast(b) if small else b
    inside = (F.col("v") >= F.col("lower_bound")) & (F.col("v") <= F.col("upper_bound"))
    w = (long.join(bounds.select(*keys, "lower_bound", "upper_bound"), keys)
         .groupBy(*keys)
         .agg(F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
              F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
              F.count_if(~inside).alias("fliers"), F.count(F.lit(1)).alias("count")))
    return (b.join(w, keys, "left")
            .select(*keys, "count", "q1", "median", "q3", "iqr", "lower_bound", "upper_bound",
                    "whisker_low", "whisker_high", "fliers"))


def count_plot(df: DataFrame, column: str) -> DataFrame:
    """(value, count) for every non-null value (order: count desc, value)."""
    return value_counts(df, [column]).select("value", "count")


def top_n(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values (ties by value)."""
    return top_k(value_counts(df, [column]), n).select("rank", "value", "count")


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """C7 line: least squares y = slope x + intercept on pairwise-complete rows."""
    xv, yv = clean_double(x), clean_double(y)
    both = df.select(xv.alias("x"), yv.alias("y"))
    return both.agg(F.regr_count("y", "x").alias("n"), F.regr_slope("y", "x").alias("slope"),
                    F.regr_intercept("y", "x").alias("intercept"),
                    F.regr_r2("y", "x").alias("r2"))


def scatter_grid(df: DataFrame, x: str, y: str, bins: int = 50,
                 color_by: str | None = None) -> DataFrame:
    """C7 points as 2-D bin counts (x_bin, y_bin, count[, mean colour])."""
    xv, yv = clean_double(x), clean_double(y)
    sel = [xv.alias("x"), yv.alias("y")]
    if color_by:
        sel.append(clean_double(color_by).alias("c"))
    base = df.select(*sel).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    st = base.agg(F.min("x").alias("xlo"), F.max("x").alias("xhi"),
                  F.min("y").alias("ylo"), F.max("y").alias("yhi"))
    wx = (F.col("xhi") - F.col("xlo")) / bins
    wy = (F.col("yhi") - F.col("ylo")) / bins
    g = with_scalars(base, st).select(
        _bin_of(F.col("x"), F.col("xlo"), wx, F.lit(bins)).alias("x_bin"),
        _bin_of(F.col("y"), F.col("ylo"), wy, F.lit(bins)).alias("y_bin"),
        *([F.col("c")] if color_by else []))
    aggs = [F.count(F.lit(1)).alias("count")]
    if color_by:
        aggs.append(F.avg("c").alias("mean_color"))
    return g.groupBy("x_bin", "y_bin").agg(*aggs)


def pair_grid(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 20) -> DataFrame:
    """Scatter grids of every numeric pair (i < j) and, on the diagonal, the
    histogram of each column (x_col = y_col, y_bin NULL), in one job:
    (x_col, y_col, x_bin, y_bin, count); bins without a row are left out."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    base = df.select(*[clean_double(c).alias(f"__c{i}") for i, c in enumerate(cols)])
    st = base.agg(*[x for i in range(len(cols)) for x in
                    (F.min(f"__c{i}").alias(f"lo{i}"), F.max(f"__c{i}").alias(f"hi{i}"))])
    j = with_scalars(base, st)
    pairs = []
    for a in range(len(cols)):
        own = (F.col(f"hi{a}") - F.col(f"lo{a}")) / bins
        pairs.append(F.struct(
            F.lit(cols[a]).alias("x_col"), F.lit(cols[a]).alias("y_col"),
            F.when(F.col(f"__c{a}").isNotNull(), F.lit(True)).alias("ok"),
            _bin_of(F.col(f"__c{a}"), F.col(f"lo{a}"), own, F.lit(bins)).alias("x_bin"),
            F.lit(None).cast("long").alias("y_bin")))
        for b in range(a + 1, len(cols)):
            wa = (F.col(f"hi{a}") - F.col(f"lo{a}")) / bins
            wb = (F.col(f"hi{b}") - F.col(f"lo{b}")) / bins
            pairs.append(F.struct(
                F.lit(cols[a]).alias("x_col"), F.lit(cols[b]).alias("y_col"),
                F.when(F.col(f"__c{a}").isNotNull() & F.col(f"__c{b}").isNotNull(), F.lit(True))
                .alias("ok"),
                _bin_of(F.col(f"__c{a}"), F.col(f"lo{a}"), wa, F.lit(bins)).alias("x_bin"),
                _bin_of(F.col(f"__c{b}"), F.col(f"lo{b}"), wb, F.lit(bins)).alias("y_bin")))
    return (j.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
            .where(F.col("ok")).groupBy("x_col", "y_col", "x_bin", "y_bin")
            .agg(F.count(F.lit(1)).alias("count")))


def line_series(df: DataFrame, x: str, y: str, buckets: int | None = None) -> DataFrame:
    """Y over x ordered by x; with ``buckets`` the mean of y per equal-width
    x bucket (a bounded series for very long inputs)."""
    if not buckets:
        return df.select(F.col(x).alias("x"), F.col(y).alias("y")).orderBy("x")
    xv = clean_double(x)
    base = df.select(xv.alias("v"), clean_double(y).alias("y")).where(F.col("v").isNotNull())
    st = base.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    w = (F.col("hi") - F.col("lo")) / buckets
    return (with_scalars(base, st)
            .select(_bin_of(F.col("v"), F.col("lo"), w, F.lit(buckets)).alias("bucket"),
                    (F.col("lo") + w * 0).alias("lo"), w.alias("w"), "v", "y")
            .groupBy("bucket").agg(F.avg("v").alias("x"), F.avg("y").alias("y"),
                                   F.count(F.lit(1)).alias("count")))


BOX_STATS = ("whisker_low", "q1", "median", "q3", "whisker_high", "fliers")


def _box_rows(box: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row (position, label, value) for each box statistic."""
    stats = F.array(*[F.struct(F.lit(i).cast("long").alias("position"), F.lit(n).alias("label"),
                               F.col(n).cast("double").alias("value")) for i, n in enumerate(BOX_STATS)])
    return box.select(*keys, F.explode(stats).alias("s")).select(*keys, "s.position", "s.label", "s.value")


def violin(df: DataFrame, column: str) -> DataFrame:
    """Box statistics (part ``box``: label, value) and the density outline
    (part ``outline``: x, value) in one table (part, position, label, x, value)."""
    box = _box_rows(boxplot(df, [column]), []).select(
        F.lit("box").alias("part"), "position", "label", F.lit(None).cast("double").alias("x"), "value")
    outline = kde(df, column).select(
        F.lit("outline").alias("part"), F.col("point").alias("position"),
        F.lit(None).cast("string").alias("label"), "x", F.col("density").alias("value"))
    return box.unionByName(outline)


def auto_charts(df: DataFrame, target: str | None = None, pair_bins: int = 20) -> DataFrame:
    """Every automatic chart of a dataset as one long table (chart, column,
    position, label, lower, upper, value): hist_<col> (automatic bins), kde_<col>
    (lower = upper = x, value = density), box_<col>, count_<col>, pair (column and
    label are the two columns, position = x bin, lower = y bin), heatmap (Pearson)
    and, with a categorical ``target``, boxby_<col> (label = group: statistic).
    Quartiles are computed once for histograms and boxes."""
    from .correlation import correlation_matrix
    num, cat = numeric_columns(df), categorical_columns(df)
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    parts = []

    def add(rows: DataFrame, chart, column, position=F.lit(None).cast("long"), label=text, lower=none, upper=none, value=none):
        parts.append(rows.select(chart.alias("chart"), column.alias("column"), position.cast("long").alias("position"),
                                 label.alias("label"), lower.cast("double").alias("lower"),
                                 upper.cast("double").alias("upper"), value.cast("double").alias("value")))

    if num:
        box = boxplot(df, num)
        known = box.select("column", "iqr")
        add(_box_rows(box, ["column"]), F.concat(F.lit("box_"), "column"), F.col("column"), F.col("position"),
            F.col("label"), value=F.col("value"))
        for c in num:
            add(histogram_auto(df, c, known.where(F.col("column") == c).select("iqr")), F.lit(f"hist_{c}"), F.lit(c),
                F.col("bin"), lower=F.col("lower"), upper=F.col("upper"), value=F.col("count"))
            add(kde(df, c), F.lit(f"kde_{c}"), F.lit(c), F.col("point"), lower=F.col("x"), upper=F.col("x"),
                value=F.col("density"))
        add(pair_grid(df, num, pair_bins), F.lit("pair"), F.col("x_col"), F.col("x_bin"), F.col("y_col"),
            lower=F.col("y_bin"), value=F.col("count"))
        if len(num) > 1:
            add(correlation_matrix(df, num), F.lit("heatmap"), F.col("column1"), F.col("j"), F.col("column2"),
                value=F.col("correlation"))
        if target in cat:
            by = _box_rows(boxplot(df, num, [target]), [target, "column"]).where(F.col(target).isNotNull())
            add(by, F.concat(F.lit("boxby_"), "column"), F.col("column"), F.col("position"),
                F.concat(F.col(target).cast("string"), F.lit(": "), F.col("label")), value=F.col("value"))
    if cat:
        add(value_counts(df, cat), F.concat(F.lit("count_"), "column"), F.col("column"), label=F.col("value"),
            value=F.col("count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numeric_card(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, std, skewness, min, max of one column."""
    mom = numeric_moments(df, [column])
    med = quantiles(df, [column], [0.5], wide=True).withColumnRenamed("q_0", "median")
    return mom.join(med, "column").select("column", "mean", "median", "std", "skewness",
                                          "min", "max")
