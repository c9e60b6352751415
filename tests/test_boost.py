"""Second-order boosting against a direct recursion over the rows."""
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tabsight.ml import boost


def naive_tree(x, g, h, depth, lam, least, gamma):
    """Node by node over all thresholds; returns leaf values -G/(H+lam) for each row."""
    out = np.empty(len(g))

    def grow(rows, level):
        G, H = g[rows].sum(), h[rows].sum()
        best = (1e-9, None)
        if level < depth:
            for f in range(x.shape[1]):
                v = x[rows, f]
                known = np.unique(x[~np.isnan(x[:, f]), f])
                for cut in [*((known[1:] + known[:-1]) / 2), math.inf]:
                    for left in (False, True):
                        go = np.where(np.isnan(v), left, v <= cut)
                        GL, HL = g[rows][go].sum(), h[rows][go].sum()
                        if HL < least or H - HL < least or not go.any() or go.all():
                            continue
                        gain = (GL ** 2 / (HL + lam) + (G - GL) ** 2 / (H - HL + lam) - G ** 2 / (H + lam)) / 2 - gamma
                        if gain > best[0] * (1 + 1e-8):
                            best = (gain, go)
        if best[1] is None:
            out[rows] = -G / (H + lam)
        else:
            grow(rows[best[1]], level + 1)
            grow(rows[~best[1]], level + 1)

    grow(np.arange(len(g)), 0)
    return out


def naive(x, y, kind, rounds, depth, rate, lam=1.0, least=1.0, gamma=0.0):
    if kind == "regression":
        s = np.full(len(y), y.mean())
        for _ in range(rounds):
            s += rate * naive_tree(x, s - y, np.ones(len(y)), depth, lam, least, gamma)
        return s[None]
    k = len(np.unique(y))
    if k == 2:
        s = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-s))
            s += rate * naive_tree(x, p - y, p * (1 - p), depth, lam, least, gamma)
        return s[None]
    s = np.full((k, len(y)), 0.5)
    for _ in range(rounds):
        p = np.exp(s) / np.exp(s).sum(axis=0)
        s = s + np.stack([rate * naive_tree(x, p[c] - (y == c), 2 * p[c] * (1 - p[c]), depth, lam, least, gamma) for c in range(k)])
    return s


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(160, 4))
    x[:, 1] = np.round(x[:, 1], 1)
    x[:, 3] = 1.0  # constant
    x[rng.random(160) < 0.2, 2] = np.nan
    y = x[:, 0] * 2 + (x[:, 1] > 0.3) - np.nan_to_num(x[:, 2], nan=2.0) + rng.normal(size=160) * 0.1
    return x, y


def frame(spark, x, y):
    rows = [(i, Vectors.dense(r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, ["k", "features", "label"])


@pytest.mark.parametrize(("kind", "classes"), [("regression", 0), ("classification", 2), ("classification", 3)])
def test_predictions_equal_the_recursion(spark, table, kind, classes, monkeypatch):
    monkeypatch.setattr(boost, "BLOCK_ROWS", 50)
    monkeypatch.setattr(boost, "FOLD", 3)
    monkeypatch.setattr(boost, "TASK_VALUES", 150)
    x, y = table
    if classes:
        y = np.digitize(y, np.quantile(y, np.arange(1, classes) / classes)).astype(float)
    rounds = 7 if classes < 3 else 4
    model = boost.BoostedTrees(kind, rounds, 3, 0.3).fit(frame(spark, x, y).repartition(3))
    want = naive(x, y, kind, rounds, 3, 0.3)
    assert np.allclose(model.scores(x), want, atol=1e-8)
    got = {r["k"]: r["prediction"] for r in model.transform(frame(spark, x, y)).collect()}
    expected = want[0] if not classes else (want[0] > 0) if classes == 2 else want.argmax(axis=0)
    assert np.allclose([got[i] for i in range(len(y))], expected, atol=1e-8)
    assert model.weights[0] > model.weights[3] == 0 and math.isclose(sum(model.weights), 1)


def test_parameters(spark, table):
    x, y = table
    kwargs = dict(lam=5.0, least=12.0, gamma=0.4)
    model = boost.BoostedTrees("regression", 3, 4, 0.5, True, 5.0, 0.4, 12.0).fit(frame(spark, x, y))
    assert np.allclose(model.scores(x), naive(x, y, "regression", 3, 4, 0.5, **kwargs), atol=1e-8)
    few = boost.BoostedTrees("regression", 3, 4, 0.5, max_bins=8).fit(frame(spark, x, y))
    assert all(len(c) <= 9 for c in boost.cut_points(few_rows(spark, x), "x", 4, 8))
    assert ((few.scores(x)[0] - y) ** 2).mean() < 0.5 * y.var()


def few_rows(spark, x):
    return spark.createDataFrame([(list(map(float, r)),) for r in x], "x array<double>")


def test_several_classes_from_shared_gradients(spark):
    """K trees a round: squared-error splits of the residuals, Newton leaves; log-loss falls."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 3))
    y = np.digitize(x[:, 0] + 0.5 * x[:, 1], [-0.6, 0.6]).astype(float)
    model = boost.BoostedTrees("classification", 8, 2, 0.3, newton=False).fit(frame(spark, x, y))
    share = np.array([(y == c).mean() for c in range(3)])
    s, losses = np.repeat(np.log(share)[:, None], len(y), axis=1), []
    for t in range(8):
        p = np.exp(s) / np.exp(s).sum(axis=0)
        res = (y == np.arange(3)[:, None]) - p
        step = np.empty_like(s)
        for c in range(3):
            fit = naive_tree(x, -res[c], np.ones(len(y)), 2, 0.0, 1.0, 0.0)  # leaf means: rows of a leaf agree
            for leaf in np.unique(np.round(fit, 12)):
                rows = np.round(fit, 12) == leaf
                r = res[c, rows]
                step[c, rows] = 0.3 * (2 / 3) * r.sum() / (np.abs(r) * (1 - np.abs(r))).sum()
        s = s + step
        p = np.exp(s) / np.exp(s).sum(axis=0)
        losses.append(-np.log(p[y.astype(int), np.arange(len(y))]).mean())
    assert np.allclose(model.scores(x), s, atol=1e-7)
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.6 * losses[0]


def test_small_and_awkward_tables(spark):
    one = boost.BoostedTrees("classification", 2, 2).fit(frame(spark, np.ones((5, 2)), np.full(5, 7.0)))
    assert {r["prediction"] for r in one.transform(frame(spark, np.ones((5, 2)), np.zeros(5))).collect()} == {7.0}
    gone = boost.BoostedTrees("regression", 2, 2).fit(frame(spark, np.full((4, 1), np.nan), np.array([1.0, 2, 3, 4])))
    assert np.allclose(gone.scores(np.full((1, 1), np.nan)), 2.5)
    with pytest.raises(ValueError):
        boost.BoostedTrees("regression").fit(frame(spark, np.ones((1, 1)), np.ones(1)).limit(0))
    with pytest.raises(ValueError):
        boost.BoostedTrees("ranking")


def test_tasks_are_no_more_than_cores(spark, monkeypatch):
    """What a level shuffles grows with the tasks, so they don't grow with the rows."""
    monkeypatch.setattr(boost, "TASK_VALUES", 1)
    seen, loaded = [], boost.BoostedTrees._loaded
    monkeypatch.setattr(boost.BoostedTrees, "_loaded", staticmethod(lambda *a: seen.append((x := loaded(*a)).getNumPartitions()) or x))
    cores = spark.sparkContext.defaultParallelism
    df = spark.createDataFrame([(Vectors.dense([float(i)]), float(i % 3)) for i in range(40 * cores)], ["features", "label"]).repartition(3 * cores)
    boost.BoostedTrees("regression", 1, 1).fit(df)
    assert seen and max(seen) <= cores
