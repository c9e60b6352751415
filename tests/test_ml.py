import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.ml import estimators as est
from tabsight.ml import evaluate as ev
from tabsight.ml import prep, runs
from tabsight.ml.knn import knn_predict
from tabsight.ml.train import train


def test_split_exact_size_and_disjoint(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    s = prep.split(df, "k", 0.2, 42, limit=10).cache()    # small limit: prefix narrowing
    assert s.where("is_test").count() == math.ceil(0.2 * 1003)
    assert s.count() == 1003
    again = prep.split(df, "k", 0.2, 42)
    assert s.join(again, ["k", "is_test"]).count() == 1003   # deterministic


def test_folds_balanced(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "k long, label int")
    f = prep.assign_folds(df, 5, "k", "label")
    per = {r["fold"]: r["count"] for r in f.groupBy("fold").count().collect()}
    assert sum(per.values()) == 100 and max(per.values()) - min(per.values()) <= 3
    r = prep.assign_folds(df.drop("label"), 3, "k")
    sizes = sorted(r["count"] for r in r.groupBy("fold").count().collect())
    assert sizes == [33, 33, 34]


def test_label_encode_sorted_with_missing(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "k long, c string")
    enc, _ = prep.label_encode(df, ["c"])
    got = {r["k"]: r["c"] for r in enc.collect()}
    assert got == {1: 1, 2: 2, 3: 0, 4: 1}           # a, b, nan


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    tr, _, _ = prep.standardize(df, None, ["x"])
    xs = sorted(r["x"] for r in tr.collect())
    ref = (np.array([1, 2, 3, 4]) - 2.5) / np.std([1, 2, 3, 4])
    assert xs == pytest.approx(ref.tolist())


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(2)
    xtr, xte = rng.normal(size=(300, 4)), rng.normal(size=(60, 4))
    ytr = (xtr[:, 0] + xtr[:, 1] > 0).astype(int)
    tr = spark.createDataFrame([(i, [float(v) for v in x], int(y)) for i, (x, y) in
                                enumerate(zip(xtr, ytr))], "k long, f array<double>, y int")
    te = spark.createDataFrame([(1000 + i, [float(v) for v in x], 0) for i, x in enumerate(xte)],
                               "k long, f array<double>, y int")
    got = {r["k"]: r["prediction"] for r in knn_predict(tr, te, "k", "f", "y", 5, block=16).collect()}
    for i, x in enumerate(xte):
        d = np.sqrt(((xtr - x) ** 2).sum(axis=1))
        nn = np.lexsort((np.arange(300), d))[:5]
        votes = np.bincount(ytr[nn], minlength=2)
        assert got[1000 + i] == float(np.argmax(votes))


def test_metrics_by_hand(spark):
    pred = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0), (2.0, 1.0)],
                                 "label double, prediction double")
    m = ev.clf_metrics(pred).first()
    assert m["accuracy"] == pytest.approx(3 / 5)
    # per class p/r: 0: 1/1, 1/2 ; 1: 2/4, 2/2 ; 2: 0 (no prediction), 0
    assert m["precision"] == pytest.approx((2 * 1 + 2 * 0.5 + 0) / 5)
    assert m["recall"] == pytest.approx((2 * 0.5 + 2 * 1 + 0) / 5)
    cm = ev.confusion_matrix(pred).collect()
    assert len(cm) == 9 and sum(r["count"] for r in cm) == 5
    rep = {r["class"]: r for r in ev.classification_report(pred).collect()}
    assert rep["2"]["f1_score"] == 0.0 and rep["accuracy"]["f1_score"] == pytest.approx(0.6)
    reg = ev.reg_metrics(spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)],
                                               "label double, prediction double")).first()
    assert reg["mse"] == pytest.approx(1 / 6) and reg["r2_score"] == pytest.approx(1 - 0.5 / 2)


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 3))
    y = 1.5 + x @ np.array([2.0, -1.0, 0.5]) + rng.normal(scale=0.1, size=400)
    pdf = pd.DataFrame(x, columns=["x1", "x2", "x3"]).assign(y=y, k=range(400))
    return pdf, spark.createDataFrame(pdf)


def test_linear_and_ridge_closed_form(linear):
    pdf, df = linear
    res = train(df, "y", "linear_regression", "{}", "regression", key="k", run_cv=False)
    coef = res.model.stages[-1].coefficients.toArray()
    assert coef == pytest.approx([2.0, -1.0, 0.5], abs=0.05)
    # ridge: sklearn objective ||y - Xw - b||^2 + alpha ||w||^2 on the training rows
    tr_keys = {r["k"] for r in prep.split(df.select("k"), "k").where(~F.col("is_test")).collect()}
    t = pdf[pdf.k.isin(tr_keys)]
    X = t[["x1", "x2", "x3"]].to_numpy()
    Xc, yc = X - X.mean(0), t.y.to_numpy() - t.y.mean()
    w = np.linalg.solve(Xc.T @ Xc + 1.0 * np.eye(3), Xc.T @ yc)
    rr = train(df, "y", "ridge", '{"alpha": 1.0}', "regression", key="k", run_cv=False)
    assert rr.model.stages[-1].coefficients.toArray() == pytest.approx(w, abs=1e-6)


def test_train_classification_end_to_end(spark, linear):
    _, df = linear
    df = df.withColumn("cls", F.when(F.col("y") > 1.5, "hi").otherwise("lo")).drop("y")
    res = train(df, "cls", "logistic_regression", '{"C": 1.0}', "classification", key="k",
                run_cv=True)
    assert res.metrics.first()["accuracy"] > 0.9
    assert res.cv_scores.count() == 5
    assert res.train_size + res.test_size == 400
    assert res.feature_importance.first()["feature"] == "x1"


def test_params_and_catalogue():
    assert est.parse_params("not json") == {}
    assert est.model_params("random_forest", {"n_estimators": "7"})["n_estimators"] == 7
    with pytest.raises(ValueError):
        est.validate_params("random_forest", {"max_depth": 50})
    assert "decision_tree" in est.available_models("regression")
    with pytest.raises(est.UnknownModelError):
        est.model_params("adaboost", {})


def test_run_registry(spark, tmp_path):
    path = str(tmp_path / "runs")
    m = spark.createDataFrame([(0.9, 0.8)], "accuracy double, f1_score double")
    e = spark.createDataFrame([(2.0, 0.5)], "mse double, r2_score double")
    runs.clear_runs(spark, path)
    runs.record_run(spark, runs.run_row(m, "knn", "classification", "y", {}, "r1"), path)
    runs.record_run(spark, runs.run_row(e, "ridge", "regression", "y", {}, "r2"), path)
    allr = runs.load_runs(spark, path)
    assert allr.count() == 2
    s = {r["run_id"]: r["value"] for r in runs.model_summary(allr).collect()}
    assert s == {"r1": 0.9, "r2": 0.5}
    cmp = {r["run_id"]: r for r in runs.model_comparison(allr).collect()}
    assert cmp["r2"]["best_mse"] and cmp["r1"]["best_accuracy"]


def test_epsilon_svr_reaches_the_optimum(spark):
    from pyspark.ml.feature import VectorAssembler

    from tabsight.ml.svr import EpsilonSVR
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 2))
    y = x @ np.array([1.0, -2.0]) + 0.5 + rng.normal(scale=0.3, size=150)
    df = spark.createDataFrame([(float(a), float(b), float(v)) for (a, b), v in zip(x, y)], "a double, b double, label double")
    m = EpsilonSVR(c=1.0, epsilon=0.1).fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df))

    def cost(w, b):
        return w @ w / (2 * 150) + np.maximum(0, np.abs(x @ w + b - y) - 0.1).mean()

    best = cost(m.weights, m.intercept)
    for _ in range(3000):  # no nearby or random point is better
        step = rng.normal(size=3) * 10 ** rng.uniform(-4, 0)
        assert cost(m.weights + step[:2], m.intercept + step[2]) >= best - 1e-5


def test_polynomial_kernel_features_are_exact(spark):
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6, 3))
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double"))
    rows = est.PolynomialKernelFeatures("features", "k", 3, 3, 0.7).transform(df).collect()
    z, u = np.array([r["k"].toArray() for r in rows]), np.array([[r["a"], r["b"], r["c"]] for r in rows])
    assert np.allclose(z @ z.T, (0.7 * u @ u.T) ** 3)


def test_unknown_kernel_and_folds(spark, linear):
    _, df = linear
    with pytest.raises(ValueError):
        train(df.withColumn("y", (F.col("y") > 1).cast("int")), "y", "svm", {"kernel": "sigmoid"}, "classification", key="k", run_cv=False)
    with pytest.raises(ValueError):
        prep.assign_folds(df, 1, "k")
    res = train(df, "y", "linear_regression", {"cv_folds": 7}, "regression", key="k")
    assert res.cv_scores.count() == 7


def test_svr_training_and_dates(spark, linear):
    _, df = linear
    df = df.withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k").cast("int") % 9))
    res = train(df, "y", "svr", {"kernel": "linear"}, "regression", key="k", run_cv=False)
    assert res.metrics.first()["r2_score"] > 0.97 and "day" in res.feature_names
    assert res.feature_importance.first()["feature"] == "x1"


def test_split_and_knn_with_repeated_and_text_keys(spark):
    df = spark.createDataFrame([(f"k{i % 4}", float(i)) for i in range(100)], "k string, x double")
    assert prep.split(df, "k").where("is_test").count() == 20
    tr = spark.createDataFrame([("a", 0.1, 0), ("a", 0.2, 1), ("c", 0.3, 1)], "k string, x double, y int")
    te = spark.createDataFrame([("q", 0.0, 0), ("q", 0.0, 0)], "k string, x double, y int")
    got = knn_predict(tr, te, "k", ["x"], "y", 3).collect()
    assert [(r["k"], r["prediction"]) for r in got] == [("q", 1.0)] * 2


def test_split_reads_keys_where_they_cost_less(spark):
    keys = spark.createDataFrame([(i % 70 if i % 9 else None,) for i in range(100)], "k int")
    dear = keys.withColumn("x", F.assert_true(F.lit(False)).cast("string"))  # raises when read
    want = sorted(map(str, prep.split(keys, "k").collect()))
    got = prep.split(dear.where(F.col("x").isNull()), "k", keys_of=keys)
    with pytest.raises(Exception, match="is not true"):
        got.collect()
    assert sorted(map(str, prep.split(keys.where("true"), "k", keys_of=keys).collect())) == want


@pytest.mark.parametrize("nulls", [0, 10, 90, 100])
def test_split_keeps_rows_with_null_keys(spark, nulls):
    df = spark.createDataFrame([(None if i < nulls else i % 60, float(i)) for i in range(100)], "k long, x double").repartition(3)
    cut = prep.split(df, "k").collect()
    assert sorted(r["x"] for r in cut) == [float(i) for i in range(100)]
    assert sum(r["is_test"] for r in cut) == 20 and all(r["is_test"] is not None for r in cut)
    assert sorted((r["x"], r["is_test"]) for r in prep.split(df.repartition(5), "k").collect()) == sorted((r["x"], r["is_test"]) for r in cut)


def test_training_without_a_key_counts_equal_rows(spark):
    df = spark.createDataFrame([(float(i % 3), float(i % 3) * 2) for i in range(90)], "x double, y double") \
        .withColumn("y", F.col("y").cast("int"))
    res = train(df, "y", "decision_tree", "{}", "classification", run_cv=False)
    assert (res.train_size, res.test_size) == (72, 18) and res.metrics.first()["accuracy"] == 1.0


def test_knn_cells_and_blocks_against_brute_force(spark):
    rng = np.random.default_rng(8)
    xtr = np.concatenate([rng.normal(size=(200, 3)), np.zeros((100, 3))])  # a hot point
    ytr = rng.integers(0, 3, 300)
    xte = np.concatenate([rng.normal(size=(30, 3)), np.zeros((3, 3))])
    tr = spark.createDataFrame([(i, [float(v) for v in x], int(y)) for i, (x, y) in enumerate(zip(xtr, ytr))], "k long, f array<double>, y int")
    te = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(xte)], "k long, f array<double>")
    for k in (1, 4, 400):
        got = {r["k"]: r["prediction"] for r in knn_predict(tr, te, "k", "f", "y", k, task="regression", block=16, pivots=8).collect()}
        for i, x in enumerate(xte):
            d = np.sqrt(((xtr - x) ** 2).sum(axis=1))
            near = np.lexsort((np.arange(300), d))[:k]
            assert got[i] == pytest.approx(ytr[near].mean())


@pytest.mark.parametrize("alpha", [0.0, 7.5])
def test_fold_scores_equal_separate_fits(spark, alpha):
    from tabsight.ml.train import linear_fold_scores
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3)) * [1, 10, 0.1] + [5, 1e4, 0]
    x[:, 2] = x[:, 0] * 2 if alpha == 0 else x[:, 2]  # least squares of dependent columns: the shortest solution
    y, fold = x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=90) + 1e5, np.arange(90) % 4
    fold[fold == 3] = 1
    y[fold == 2] = 8.0  # no spread, so no score
    rows = spark.createDataFrame([(int(k), float(t), *map(float, r)) for k, t, r in zip(fold, y, x, strict=True)],
                                 "fold int, label double, a double, b double, c double").repartition(3)
    got = linear_fold_scores(rows, ["a", "b", "c"], 4, alpha)
    for k in range(2):
        tr, va = fold != k, fold == k
        mx, my = x[tr].mean(axis=0), y[tr].mean()
        xc, yc = x[tr] - mx, y[tr] - my
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc) if alpha else np.linalg.lstsq(xc, yc, rcond=None)[0]
        e = y[va] - my - (x[va] - mx) @ w
        assert got[k] == pytest.approx(1 - (e ** 2).sum() / ((y[va] - y[va].mean()) ** 2).sum(), rel=1e-6)
    assert got[2:] == [None, None]


def test_svr_sums_up_a_tree(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    from tabsight.ml import svr
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 2))
    y = x @ [1.5, -2.0] + 0.5
    df = spark.createDataFrame([(Vectors.dense(r), float(t)) for r, t in zip(x, y, strict=True)], ["features", "label"])
    flat = svr.EpsilonSVR(1.0, 0.01).fit(df.repartition(2))
    monkeypatch.setattr(svr, "FAN_IN", 3)
    tree = svr.EpsilonSVR(1.0, 0.01).fit(df.repartition(11))
    assert np.allclose(flat.weights, tree.weights, atol=1e-3) and np.allclose(tree.weights, [1.5, -2.0], atol=0.05)


def test_knn_holds_a_slice_of_the_pairs():
    import tracemalloc

    import pyarrow as pa

    from tabsight.ml.knn import _nearest
    rng = np.random.default_rng(5)
    xtr, xte = rng.normal(size=(4096, 8)), rng.normal(size=(3000, 8))
    xtr[10:14] = xtr[10]  # ties go to the smaller id

    def batch(side, ids, x):
        n = len(x)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(n, "i4")), pa.array(np.zeros(n, "i8")), pa.array(np.full(n, side, "i4")), pa.array(ids),
             pa.array(list(x), pa.list_(pa.float64())), pa.array(ids % 3 * 1.0)], names=["cell", "sub", "side", "id", "x", "y"])
    batches = [batch(0, np.arange(4096), xtr), batch(1, np.arange(3000), np.r_[xtr[10:11], xte[1:]])]
    tracemalloc.start()
    out = pa.Table.from_batches(_nearest(3)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # all pairs of the batch take 98 MB an array
    got = out.column("train_id").to_numpy().reshape(3000, 3)
    assert got[0].tolist() == [10, 11, 12]
    for i in range(1, 3000, 250):
        d = np.sqrt(((xtr - xte[i]) ** 2).sum(axis=1))
        assert got[i].tolist() == np.lexsort((np.arange(4096), d))[:3].tolist()


def test_knn_with_infinite_and_huge_features():
    from tabsight.ml.knn import _closest
    b = np.array([[1.0], [np.inf], [1e200], [3.0], [np.nan]])
    rows, cols, dist = _closest(np.array([[2.0], [1e200]]), b, (b * b).sum(axis=1), np.arange(5), 2)
    assert rows.tolist() == [0, 0, 1, 1] and cols.tolist() == [0, 3, 2, 0] and dist[:3].tolist() == [1.0, 1.0, 0.0]


def test_svr_tasks_compute_the_kernel_features(spark):
    from pyspark.ml.linalg import Vectors

    from tabsight.ml import svr
    from tabsight.ml.estimators import RandomFourierFeatures
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(Vectors.dense(r), float(np.sin(r[0]))) for r in x], ["features", "label"])
    kernel = RandomFourierFeatures("features", "kfeatures", 20, 2, 0.5)
    stored = svr.EpsilonSVR(features_col="kfeatures").fit(kernel.transform(df))
    mapped = svr.EpsilonSVR(features_col="kfeatures").fit(df, "features", kernel.mapped())
    assert np.allclose(stored.weights, mapped.weights, atol=1e-6) and np.isclose(stored.intercept, mapped.intercept, atol=1e-6)


def test_svr_rows_are_dealt_by_their_values(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    from tabsight.ml import svr
    df = spark.createDataFrame([(Vectors.dense([float(i)]), 2.0 * i) for i in range(40)], ["features", "label"]).coalesce(1)
    seen = []
    monkeypatch.setattr(svr, "TASK_VALUES", 10)
    monkeypatch.setattr(svr, "_minimise", lambda f, start, *_: start)
    monkeypatch.setattr(svr._Sums, "__call__", lambda self, *a: None)
    sums = svr._Sums.__init__
    monkeypatch.setattr(svr._Sums, "__init__", lambda self, rows, *a: (sums(self, rows, *a), seen.append(self.partitions))[0])
    svr.EpsilonSVR().fit(df)
    assert 4 in seen


def test_svr_halves_are_tried_in_one_pass():
    from tabsight.ml.svr import _minimise
    passes = []

    def f(points):
        passes.append(len(points))
        return [(float(50 * p @ p), 100 * p) for p in points]
    assert np.allclose(_minimise(f, np.array([1.0]), 100, 1e-6), 0)
    assert passes[:4] == [1, 1, 4, 4]  # the start, a whole step, its halves to 1/16, to 1/256


def test_svr_steps_do_not_depend_on_the_scale_of_the_loss():
    from tabsight.ml.svr import _minimise
    curve, slope, passes = np.array([1e-6, 2e-7]), np.array([1e-4, -5e-5]), []

    def f(points):
        passes.append(len(points))
        return [(float(p @ (curve * p) / 2 - slope @ p), curve * p - slope) for p in points]
    x = _minimise(f, np.zeros(2), 100, 1e-7)
    assert len(passes) < 20 and np.abs(curve * x - slope).max() <= 1e-7


def test_svr_packs_rows_into_blocks(spark, monkeypatch):
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    from tabsight.ml import svr
    rng = np.random.default_rng(7)
    x, y, points = rng.normal(size=(100, 3)), rng.normal(size=100), rng.normal(size=(2, 4))
    rows = spark.createDataFrame([(Vectors.dense(r), float(t)) for r, t in zip(x, y, strict=True)], ["features", "y"]) \
        .select(vector_to_array("features").alias("x"), "y").coalesce(1)
    monkeypatch.setattr(svr, "BLOCK_BYTES", 7 * 32)
    monkeypatch.setattr(svr, "HELD_VALUES", 3 * 16)
    packed = svr._packed(rows, 3)
    assert [len(r["z"]) // 32 for r in packed.collect()] == [7] * 14 + [2]
    got = svr._Sums(packed, 100, 3, 3, 1.0, 0.1)(points, 0.5)
    for p, (value, grad) in zip(points, got, strict=True):
        loss, s = svr.smooth_loss(x @ p[:-1] + p[-1] - y, 0.1, 0.5)
        assert value == pytest.approx(loss.mean() + p[:-1] @ p[:-1] / 200)
        assert np.allclose(grad, np.r_[s @ x + p[:-1], s.sum()] / 100)


def test_fourier_features_are_cosines():
    kernel = est.RandomFourierFeatures("features", "k", 50, 3, 0.5)
    x = np.random.default_rng(8).normal(size=(3000, 3)) * 10.0 ** np.arange(3)  # more than one block, angles to hundreds
    assert np.abs(kernel.mapped()(x) - 0.2 * np.cos(x @ kernel.w + kernel.b)).max() < 1e-12
    assert kernel.mapped()(x[:0]).shape == (0, 50)


def test_svr_predicts_without_storing_features(spark):
    from pyspark.ml.linalg import Vectors

    from tabsight.ml.svr import SVRModel
    rng = np.random.default_rng(9)
    x, w = rng.normal(size=(30, 2)), rng.normal(size=20)
    df = spark.createDataFrame([(Vectors.dense(r),) for r in x], ["features"])
    kernel = est.RandomFourierFeatures("features", "kfeatures", 20, 2, 0.5)
    wide = kernel.transform(df)
    own = SVRModel(w, 0.5, "kfeatures", "features", kernel.mapped()).transform(wide)
    stored = SVRModel(w, 0.5, "kfeatures").transform(wide)
    want = kernel.mapped()(x) @ w + 0.5
    for out in (own, stored):
        assert np.allclose([r["prediction"] for r in out.collect()], want)
    assert np.allclose([r["kfeatures"].toArray() for r in own.collect()], kernel.mapped()(x))
    plan = own.select("prediction")._jdf.queryExecution().optimizedPlan().toString()
    assert "kfeatures" not in plan and plan.count("EvalPython") == 1
    assert "Python" not in wide.select("features")._jdf.queryExecution().optimizedPlan().toString()


def test_forest_rows_are_dealt_by_their_values(spark):
    from tabsight.ml import train as t
    df = spark.range(40).coalesce(1)
    assert t._dealt(df, 3 * t.FOREST_VALUES - 1).rdd.getNumPartitions() == 3
    assert t._dealt(df, 100 * t.FOREST_VALUES).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert t._dealt(df, 5) is df
