"""Model catalogue (M7), hyperparameter parsing (M6) and MLlib estimators
(E1-E11) with the reference's defaults mapped to Spark parameters.

Mappings (documented approximations are marked):
* logistic_regression: L2 with regParam = 1 / (C n), no internal standardisation.
* decision_tree: exact thresholds, any depth, min_samples_split as itself (``tree.py``);
  with ``max_bins`` given, the binned trees of MLlib.
* random_forest, binned trees: depth <= 30 (MLlib limit); min_samples_split m
  -> minInstancesPerNode = max(1, ceil(m / 2)) (approximate).
* svm: linear -> LinearSVC(regParam = 1 / (C n), columns as they are); poly -> the
  features of the homogeneous kernel (gamma x.x')^degree, exactly, + LinearSVC; rbf -> random Fourier features (Rahimi & Recht 2007)
  + LinearSVC (approximate kernel); multi-class via OneVsRest.
* gradient_boosting: GBT; for > 2 classes the joint K trees a round of ``boost.py``.
* xgboost: second-order boosting of ``boost.py`` (reg_lambda 1, gamma 0, min_child_weight 1).
* ridge: normal equations, regParam = alpha * sigma_y / n (population sigma_y).
* lasso: elasticNetParam = 1, regParam = alpha.
* svr: the epsilon-insensitive loss (epsilon 0.1), see ``svr.py``, over the same
  feature maps as svm.
* knn: exact, see ``knn.py`` (not an MLlib estimator).
* forests and boosting: ``max_bins`` (default 256) candidate thresholds a column: splits
  of columns with more distinct values are approximate. Categorical codes are ordered numbers.
* ``n_features`` (default 200) random Fourier features; ``max_iter`` of svm 100.
* solver tolerances follow the reference library defaults (1e-4 logistic,
  1e-3 support vector machines).
"""

from __future__ import annotations

import json
import math
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, OneVsRest, RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boost import BoostedTrees
from .svr import EpsilonSVR
from .tree import ExactTree

# The reference's model catalogue and default hyperparameters.
CLASSIFIERS = {
    "logistic_regression": "Logistic Regression",
    "random_forest": "Random Forest",
    "svm": "Support Vector Machine",
    "gradient_boosting": "Gradient Boosting",
    "xgboost": "XGBoost",
    "knn": "K-Nearest Neighbors",
    "decision_tree": "Decision Tree",
}
REGRESSORS = {
    "linear_regression": "Linear Regression",
    "ridge": "Ridge Regression",
    "lasso": "Lasso Regression",
    "random_forest": "Random Forest",
    "gradient_boosting": "Gradient Boosting",
    "xgboost": "XGBoost",
    "svr": "Support Vector Regression",
    "decision_tree": "Decision Tree",
}
DEFAULTS = {
    "logistic_regression": {"C": 1.0, "max_iter": 1000, "random_state": 42},
    "random_forest": {"n_estimators": 100, "max_depth": 10, "min_samples_split": 2,
                      "random_state": 42},
    "svm": {"C": 1.0, "kernel": "rbf", "gamma": "scale", "random_state": 42},
    "gradient_boosting": {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1,
                          "random_state": 42},
    "xgboost": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "random_state": 42},
    "knn": {"n_neighbors": 5, "weights": "uniform"},
    "decision_tree": {"max_depth": 10, "min_samples_split": 2, "random_state": 42},
    "linear_regression": {},
    "ridge": {"alpha": 1.0, "random_state": 42},
    "lasso": {"alpha": 1.0, "random_state": 42},
    "svr": {"C": 1.0, "kernel": "rbf", "gamma": "scale"},
}
#: Parameters that have no default in the reference's catalogue but are taken.
EXTRA = {
    "logistic_regression": {"tol": 1e-4},
    "svm": {"tol": 1e-3, "degree": 3, "max_iter": 100, "n_features": 200},
    "svr": {"epsilon": 0.1, "degree": 3, "max_iter": 100, "n_features": 200},
    **{m: {"max_bins": 256} for m in ("random_forest", "gradient_boosting")},
    "decision_tree": {"max_bins": 0},
    "xgboost": {"max_bins": 256, "reg_lambda": 1.0, "gamma": 0.0, "min_child_weight": 1.0},
}
#: Estimators of this library: ``fit`` gives a model with ``transform``.
OWN = (EpsilonSVR, BoostedTrees, ExactTree)
KERNELS = ("linear", "poly", "rbf")
SCALED = ("svm", "svr", "knn", "logistic_regression")
MAX_DEPTH = 30


class UnknownModelError(ValueError):
    pass


def available_models(problem_type: str) -> dict[str, str]:
    """M7: name -> label for a problem type."""
    if problem_type == "classification":
        return dict(CLASSIFIERS)
    if problem_type == "regression":
        return dict(REGRESSORS)
    raise ValueError(f"unknown problem type {problem_type!r}")


def parse_params(hyperparameter: str | dict | None) -> dict:
    """M6: JSON text (or dict) -> dict; malformed JSON -> {}."""
    if isinstance(hyperparameter, dict):
        return dict(hyperparameter)
    if not hyperparameter:
        return {}
    try:
        out = json.loads(hyperparameter)
    except (json.JSONDecodeError, TypeError):
        return {}
    return out if isinstance(out, dict) else {}


def model_params(model_name: str, given: dict) -> dict:
    """Defaults of ``model_name`` overridden by ``given`` (typed like the defaults)."""
    if model_name not in DEFAULTS:
        raise UnknownModelError(f"Unknown model: {model_name}")
    out = {**EXTRA.get(model_name, {}), **DEFAULTS[model_name]}
    for k, v in given.items():
        if k in out and v is not None and not isinstance(out[k], str):
            out[k] = type(out[k])(v)
        else:
            out[k] = v
    return out


def validate_params(model_name: str, params: dict) -> dict:
    """Keep the keys the model knows; reject out-of-range depths."""
    known = model_params(model_name, {})
    clean = {k: v for k, v in params.items() if k in known}
    depth = clean.get("max_depth")
    if depth is not None and int(depth) > MAX_DEPTH and not _exact(model_name, clean):
        raise ValueError(f"max_depth {depth} exceeds the supported maximum {MAX_DEPTH}")
    return clean


def _exact(model_name: str, params: dict) -> bool:
    return model_name == "decision_tree" and not params.get("max_bins")


class PolynomialKernelFeatures(Transformer):
    """x (vector) -> the features whose inner product is (gamma x.x')^degree: all
    monomials of that degree, weighted by the root of their multinomial count.
    There are C(d + degree - 1, degree) of them (45,760 for 64 columns, degree 3)."""

    def __init__(self, input_col: str, output_col: str, dim: int, degree: int, gamma: float):
        super().__init__()
        self.index = np.array(list(combinations_with_replacement(range(dim), degree)))
        counts = [math.factorial(degree) / math.prod(math.factorial(c) for c in Counter(t).values())
                  for t in self.index.tolist()]
        self.scale = np.sqrt(np.array(counts) * gamma ** degree)
        self.input_col, self.output_col = input_col, output_col

    def mapped(self):
        """The map of a matrix of rows, without this object."""
        index, scale = self.index, self.scale
        return lambda x: x[:, index].prod(axis=2) * scale

    def _transform(self, df: DataFrame) -> DataFrame:
        return _map_vectors(df, self.input_col, self.output_col, self.mapped())


def _map_vectors(df: DataFrame, input_col: str, output_col: str, f) -> DataFrame:
    """A vector column through ``f`` (a matrix of rows to a matrix) in Arrow batches; where
    nothing reads the new column, it is not computed."""
    from ..session import ship_package
    ship_package(df.sparkSession)

    def run(v: pa.Array) -> pa.Array:
        x = v.flatten().to_numpy(zero_copy_only=False)
        out = f(x.reshape(len(v), len(x) // max(1, len(v)))) if len(v) else np.zeros((0, 0))
        return pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], pa.array(out.ravel()))

    mapped = F.arrow_udf(run, T.ArrayType(T.DoubleType()))(vector_to_array(F.col(input_col)))
    return df.withColumn(output_col, array_to_vector(mapped))


#: sin(pi t) / t as a polynomial of t^2, to 5e-16 where |t| <= 1/2.
SINE = np.array([(-1) ** k * math.pi ** (2 * k + 1) / math.factorial(2 * k + 1) for k in range(10)])


def _cosines(w: np.ndarray, b: np.ndarray, size: float, held: int = 64_000):
    """x -> size cos(x w + b), by size - 2 size sin(angle / 2)^2: a few array operations on the
    fraction of a turn, ``held`` values at once; np.cos takes three times as long."""
    turn, shift, n = w / (2 * math.pi), b / (2 * math.pi), len(b)
    coefs, step = SINE * math.sqrt(2 * size), max(1, held // max(1, n))

    def run(x):
        out = np.empty((len(x), n))
        for at in range(0, len(x), step):
            s = out[at:at + step]
            t = x[at:at + step] @ turn
            t += shift
            u = np.rint(t)
            t -= u
            np.multiply(t, t, out=u)
            np.multiply(u, coefs[-1], out=s)
            for c in coefs[-2:0:-1]:
                s += c
                s *= u
            s += coefs[0]
            s *= t
            s *= s
            np.subtract(size, s, out=s)
        return out
    return run


class RandomFourierFeatures(Transformer):
    """x (vector) -> sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi).

    Applied on Arrow batches (numpy matrix product)."""

    def __init__(self, input_col: str, output_col: str, n_features: int, dim: int, gamma: float,
                 seed: int = 42):
        super().__init__()
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(dim, n_features))
        self.b = rng.uniform(0.0, 2.0 * math.pi, size=n_features)
        self.input_col, self.output_col, self.n = input_col, output_col, n_features

    def mapped(self):
        """The map of a matrix of rows, without this object."""
        return _cosines(self.w, self.b, math.sqrt(2.0 / self.n))

    def _transform(self, df: DataFrame) -> DataFrame:
        return _map_vectors(df, self.input_col, self.output_col, self.mapped())


def gamma_scale(train: DataFrame, features_col: str, d: int) -> float:
    """gamma='scale' = 1 / (n_features * Var(X)) over all training values."""
    arr = train.select(F.explode(vector_to_array(features_col)).alias("v"))
    var = arr.agg(F.var_pop("v")).first()[0] or 0.0
    return 1.0 / (d * var) if var > 0 else 1.0


def build(model_name: str, problem_type: str, params: dict, n_train: int, n_classes: int,
          features_col: str = "features", label_col: str = "label",
          y_std: float | None = None):
    """Return a configured MLlib estimator (or a marker for custom models)."""
    p = model_params(model_name, params)
    depth = int(p.get("max_depth", 5)) if "max_depth" in p else None
    if _exact(model_name, p) and problem_type in ("classification", "regression"):
        return ExactTree(problem_type, depth, int(p["min_samples_split"]), features_col, label_col)
    if depth is not None and depth > MAX_DEPTH:
        raise ValueError(f"max_depth {depth} exceeds the supported maximum {MAX_DEPTH}")
    seed = int(p.get("random_state", 42))
    common = {"featuresCol": features_col, "labelCol": label_col}
    bins = {"maxBins": int(p.get("max_bins", 256))}
    if model_name == "xgboost" and problem_type in ("classification", "regression"):
        return BoostedTrees(problem_type, int(p["n_estimators"]), depth, float(p["learning_rate"]), True, float(p["reg_lambda"]),
                            float(p["gamma"]), float(p["min_child_weight"]), int(p["max_bins"]), features_col, label_col)
    if model_name == "gradient_boosting" and n_classes > 2:
        return BoostedTrees(problem_type, int(p["n_estimators"]), depth, float(p["learning_rate"]), False,
                            max_bins=int(p["max_bins"]), features_col=features_col, label_col=label_col)
    min_inst = max(1, math.ceil(int(p.get("min_samples_split", 2)) / 2))
    if problem_type == "classification":
        if model_name == "logistic_regression":
            return LogisticRegression(regParam=1.0 / (float(p["C"]) * n_train), elasticNetParam=0.0,
                                      standardization=False, maxIter=int(p["max_iter"]),
                                      tol=float(p["tol"]), **common)
        if model_name == "random_forest":
            return RandomForestClassifier(numTrees=int(p["n_estimators"]), maxDepth=depth,
                                          minInstancesPerNode=min_inst, seed=seed, **bins,
                                          featureSubsetStrategy="sqrt", **common)
        if model_name == "decision_tree":
            return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=min_inst, seed=seed, **bins,
                                          **common)
        if model_name == "gradient_boosting":
            return GBTClassifier(maxIter=int(p["n_estimators"]), maxDepth=depth,
                                 stepSize=float(p["learning_rate"]), seed=seed, **bins, **common)
        if model_name == "svm":
            svc = LinearSVC(regParam=1.0 / (float(p["C"]) * n_train), standardization=False,
                            maxIter=int(p["max_iter"]), tol=float(p["tol"]), **common)
            return svc if n_classes <= 2 else OneVsRest(classifier=svc, **common)
        if model_name == "knn":
            return ("knn", int(p["n_neighbors"]), str(p["weights"]))
    elif problem_type == "regression":
        if model_name == "linear_regression":
            return LinearRegression(regParam=0.0, solver="normal", **common)
        if model_name == "ridge":
            reg = float(p["alpha"]) * (y_std or 1.0) / n_train
            return LinearRegression(regParam=reg, elasticNetParam=0.0, solver="normal",
                                    standardization=False, **common)
        if model_name == "lasso":
            return LinearRegression(regParam=float(p["alpha"]), elasticNetParam=1.0,
                                    standardization=False, maxIter=1000, **common)
        if model_name == "random_forest":
            return RandomForestRegressor(numTrees=int(p["n_estimators"]), maxDepth=depth,
                                         minInstancesPerNode=min_inst, seed=seed, **bins,
                                         featureSubsetStrategy="all", **common)
        if model_name == "decision_tree":
            return DecisionTreeRegressor(maxDepth=depth, minInstancesPerNode=min_inst, seed=seed, **bins,
                                         **common)
        if model_name == "gradient_boosting":
            return GBTRegressor(maxIter=int(p["n_estimators"]), maxDepth=depth,
                                stepSize=float(p["learning_rate"]), seed=seed, **bins, **common)
        if model_name == "svr":
            return EpsilonSVR(float(p["C"]), float(p["epsilon"]), int(p["max_iter"]), features_col=features_col,
                              label_col=label_col)
    raise UnknownModelError(f"Unknown model {model_name!r} for {problem_type!r}")


def kernel_features(model_name: str, params: dict, train: DataFrame, d: int,
                    features_col: str = "features"):
    """Feature map for kernel SVM/SVR: None (linear), PolynomialKernelFeatures (poly)
    or RandomFourierFeatures (rbf)."""
    if model_name not in ("svm", "svr"):
        return None
    p = model_params(model_name, params)
    kernel = str(p.get("kernel", "rbf"))
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}; known: {', '.join(KERNELS)}")
    if kernel == "linear":
        return None
    g = p.get("gamma", "scale")
    gamma = gamma_scale(train, features_col, d) if g == "scale" else (
        1.0 / d if g == "auto" else float(g))
    if kernel == "poly":
        return PolynomialKernelFeatures(features_col, "kfeatures", d, int(p["degree"]), gamma)
    return RandomFourierFeatures(features_col, "kfeatures", int(p["n_features"]), d, gamma,
                                 int(p.get("random_state", 42)))
