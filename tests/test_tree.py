"""Exact trees against a direct recursion, split by tasks and by Spark."""
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tabsight.ml import estimators, tree


def naive(x, y, depth, least, classes):
    """Predictions by trying every threshold of every feature."""
    out = np.empty(len(y))

    def score(rows):
        if classes:
            return sum((y[rows] == c).sum() ** 2 for c in range(classes)) / len(rows)
        return (y[rows] - y.mean()).sum() ** 2 / len(rows)

    def grow(rows, level):
        best = (None, None)
        if level < depth and len(rows) >= least and len(np.unique(y[rows])) > 1:
            for f in range(x.shape[1]):
                v = np.unique(x[rows, f])
                for a, b in zip(v[:-1], v[1:], strict=True):
                    cut = a + (b - a) / 2 if a + (b - a) / 2 < b else a
                    low, high = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    s = score(low) + score(high)
                    if best[0] is None or s > best[0] * (1 + 1e-9) + 1e-300:
                        best = (s, (low, high))
        if best[1] is None:
            out[rows] = np.bincount(y[rows].astype(int)).argmax() if classes else y[rows].mean()
        else:
            for part in best[1]:
                grow(part, level + 1)

    grow(np.arange(len(y)), 0)
    return out


def frame(spark, x, y):
    return spark.createDataFrame([(i, Vectors.dense(r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], ["k", "features", "label"])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(220, 3))
    x[:, 1] = np.round(x[:, 1], 1)
    x[:, 2] = rng.integers(0, 2, 220)
    return x, x[:, 0] ** 2 + (x[:, 1] > 0) * 2 + x[:, 2] * x[:, 0] + rng.normal(size=220) * 0.05 + 100


@pytest.mark.parametrize("values", [tree.VALUES, 90, 0])
@pytest.mark.parametrize("classes", [0, 2, 4])
def test_trees_equal_the_recursion(spark, data, monkeypatch, values, classes):
    """In one task, by Spark for large nodes, and by Spark alone."""
    monkeypatch.setattr(tree, "VALUES", values)
    x, y = data
    if classes:
        y = np.digitize(y, np.quantile(y, np.arange(1, classes) / classes)).astype(float)
    kind = "classification" if classes else "regression"
    depth = 4 if values else 2
    model = tree.ExactTree(kind, depth, 9).fit(frame(spark, x, y).repartition(3))
    assert np.allclose(model.predict(x), naive(x, y, depth, 9, classes), atol=1e-9)
    got = {r["k"]: r["prediction"] for r in model.transform(frame(spark, x, y)).collect()}
    assert np.allclose([got[i] for i in range(len(y))], model.predict(x))
    assert model.depth <= depth and abs(sum(model.weights) - 1) < 1e-9


def test_depth_beyond_thirty_and_full_growth(spark):
    """Alternating classes, which only splits near an end get any purer."""
    x = np.arange(60.0)[:, None]
    y = np.arange(60.0) % 2
    deep = tree.ExactTree("classification").fit(frame(spark, x, y))
    assert deep.depth > 30 and (deep.predict(x) == y).all()
    assert tree.ExactTree("classification", 31).fit(frame(spark, x, y)).depth == 31
    assert estimators.validate_params("decision_tree", {"max_depth": 50, "min_samples_split": 4}) == {"max_depth": 50, "min_samples_split": 4}
    with pytest.raises(ValueError):
        estimators.validate_params("decision_tree", {"max_depth": 50, "max_bins": 64})


def test_no_gain_at_first_is_no_end(spark):
    x = np.array([(a, b) for a in (0.0, 1.0) for b in (0.0, 1.0)] * 5)
    y = np.logical_xor(x[:, 0], x[:, 1]).astype(float) + 3
    model = tree.ExactTree("classification", 2).fit(frame(spark, x, y))
    assert (model.predict(x) == y).all() and model.labels == [3.0, 4.0]


def test_least_rows_and_missing_values(spark):
    x, y = np.array([[1.0], [2.0], [3.0], [np.nan], [np.nan]]), np.array([0.0, 0, 0, 9, 9])
    model = tree.ExactTree("regression", None, 5).fit(frame(spark, x, y))
    assert model.predict(x).tolist() == [0, 0, 0, 9, 9] and model.tree.cut[0] == 3.0
    assert tree.ExactTree("regression", None, 6).fit(frame(spark, x, y)).predict(x).tolist() == [3.6] * 5
    assert tree.ExactTree("regression").fit(frame(spark, np.ones((3, 1)), np.arange(3.0))).predict(np.ones((1, 1))) == [1.0]
    with pytest.raises(ValueError):
        tree.ExactTree("regression").fit(frame(spark, x, y).limit(0))
    with pytest.raises(ValueError):
        tree.ExactTree("regression", 3, 1)


def test_a_level_of_large_nodes_is_one_shuffle(spark, data, monkeypatch):
    """A level writes nothing, and its lists are dealt once: by bucket, with equal values of many
    rows as one line."""
    monkeypatch.setattr(tree, "VALUES", 0)
    stored = []
    monkeypatch.setattr(tree, "_stored", lambda df, f=tree._stored: stored.append(df.columns) or f(df))
    x, y = np.stack((np.repeat([0.0, 1, 2, 3], 500), np.arange(2000.0) % 7), axis=1), np.repeat([5.0, 1, 1, 9], 500)
    model = tree.ExactTree("regression", 3).fit(frame(spark, x, y).repartition(5))
    assert stored == [["x", "y"]] and np.allclose(model.predict(x), y)


@pytest.mark.parametrize("sums", [1, 2_000_000])
def test_nodes_in_parts_and_single_values(spark, data, monkeypatch, sums):
    """Nodes whose sums don't fit at once, small chunks, and a feature with one value."""
    for name, v in (("VALUES", 0), ("SUMS", sums), ("CHUNK", 40)):
        monkeypatch.setattr(tree, name, v)
    x, y = np.concatenate((np.ones((220, 1)), data[0]), axis=1), data[1]
    model = tree.ExactTree("regression", 3, 9).fit(frame(spark, x, y).repartition(3))
    assert np.allclose(model.predict(x), naive(x, y, 3, 9, 0), atol=1e-9)
