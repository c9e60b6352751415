"""Buckets of the Kendall decomposition."""
import math

import numpy as np

from tabsight.operators import kendall


def test_buckets_come_from_distinct_values(spark, monkeypatch):
    """Equal runs of the points' positions, a value in more than one run on its own; only distinct
    values are sorted."""
    rng = np.random.default_rng(2)
    pts = [(g, float(a), float(b), 1.0) for g in "pq" for a, b in sorted({(int(min(x, 6)), int(y)) for x, y in zip(rng.exponential(3, 300), rng.integers(0, 90, 300), strict=True)})]
    df = spark.createDataFrame(pts, "g string, a double, b double, w double")
    sorted_rows, counts = [], kendall.running_counts
    monkeypatch.setattr(kendall, "running_counts", lambda d, *a: sorted_rows.append(d.count()) or counts(d, *a))
    sizes = df.groupBy("g").count().withColumnRenamed("count", "__s")
    got = {(r["g"], r["a"]): r["ba"] for r in kendall._rank_buckets(df, sizes, "a", 5, "ba").collect()}
    assert sorted_rows == [len({(g, a) for g, a, _, _ in pts})]
    for g in "pq":
        values = np.sort([a for h, a, _, _ in pts if h == g])
        run = np.arange(len(values)) // math.ceil(len(values) / 5)
        for v in np.unique(values):
            low, high = run[values == v].min(), run[values == v].max()
            assert got[g, v] == 2 * low + (high > low)
