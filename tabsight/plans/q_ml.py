"""ML plans: preparation (M1-M5), estimators (E1-E11), evaluation and runs
(V1-V12). Evaluation is proven on predictions SQL can reproduce: exact kNN
(E6) on embeddings and one-feature least squares (E8) on part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..ml import estimators as est
from ..ml import evaluate as ev
from ..ml import prep, runs
from ..ml.knn import knn_predict
from ..ml.train import train
from .data import EVENTS_NULLS_SQL, events_with_nulls, table
from .registry import query


def _split_sql(src: str, key: str, cols: str = "*", frac: float = 0.2, seed: int = 42) -> str:
    return f"""(SELECT {cols}, h, row_number() OVER (ORDER BY h, {key})
      <= ceil({frac} * count(*) OVER ()) AS is_test
    FROM (SELECT *, md5('{seed}:' || CAST({key} AS VARCHAR)) AS h FROM {src}))"""


# ---------------------------------------------------------------- M1-M5

@query("label_encode", """
SELECT o_orderkey,
  CAST(dense_rank() OVER (ORDER BY coalesce(o_orderstatus, 'nan')) - 1 AS INTEGER) AS o_orderstatus,
  CAST(dense_rank() OVER (ORDER BY coalesce(o_orderpriority, 'nan')) - 1 AS INTEGER)
    AS o_orderpriority
FROM orders""")
def q_label_encode(spark, sf):
    """M1: sorted-label codes of the text columns of orders."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return prep.label_encode(o, ["o_orderstatus", "o_orderpriority"])[0]


@query("impute_mean", f"""
SELECT event_id, round(coalesce(value, avg(value) OVER ()), 6) AS value FROM {EVENTS_NULLS_SQL}""")
def q_impute_mean(spark, sf):
    """M2: NULL values replaced by the mean of the whole column."""
    e = events_with_nulls(spark, sf).select("event_id", "value")
    return prep.impute_mean(e, ["value"])


@query("encode_target", """
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY coalesce(p_brand, 'nan')) - 1 AS INTEGER) AS p_brand
FROM part""")
def q_encode_target(spark, sf):
    """M3: a text target as 0-based codes."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    enc, mapping = prep.encode_target(p, "p_brand")
    return enc


@query("split", f"SELECT o_orderkey, is_test FROM {_split_sql('orders', 'o_orderkey', 'o_orderkey')}")
def q_split(spark, sf):
    """M4: exactly ceil(0.2 n) test rows, smallest md5('42:' || key)."""
    o = table(spark, sf, "orders").select("o_orderkey")
    return prep.split(o, "o_orderkey", 0.2, 42)


@query("standardize", f"""
WITH s AS {_split_sql('part', 'p_partkey', 'p_partkey, p_size, p_retailprice')},
st AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2,
         stddev_pop(p_retailprice) AS s2 FROM s WHERE NOT is_test)
SELECT p_partkey, is_test,
  round((p_size - m1) / CASE WHEN s1 IS NULL OR s1 = 0 THEN 1 ELSE s1 END, 6) AS p_size,
  round((p_retailprice - m2) / CASE WHEN s2 IS NULL OR s2 = 0 THEN 1 ELSE s2 END, 6)
    AS p_retailprice
FROM s, st""")
def q_standardize(spark, sf):
    """M5: z-scores with population std fitted on the training part only."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double"),
                                        "p_retailprice")
    s = prep.split(p, "p_partkey")
    tr, te, _ = prep.standardize(s.where(~F.col("is_test")), s.where(F.col("is_test")),
                                 ["p_size", "p_retailprice"])
    return tr.unionByName(te)


@query("cv_folds", f"""
SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY h, vec_id) - 1) % 5
  AS INTEGER) AS fold
FROM {_split_sql('embeddings', 'vec_id', 'vec_id, label')} WHERE NOT is_test""")
def q_cv_folds(spark, sf):
    """V7 stratified folds (round robin per class in split order) on the train part."""
    e = prep.split(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id")
    tr = e.where(~F.col("is_test")).drop("is_test")
    return prep.assign_folds(tr, 5, "vec_id", "label")


@query("cv_folds_regression", f"""
WITH t AS (SELECT p_partkey, row_number() OVER (ORDER BY h, p_partkey) - 1 AS z,
             count(*) OVER () AS n
           FROM {_split_sql('part', 'p_partkey', 'p_partkey')} WHERE NOT is_test),
u AS (SELECT *, n // 5 + 1 AS big, n // 5 AS small, n % 5 AS nbig FROM t)
SELECT p_partkey, CAST(CASE WHEN z < big * nbig THEN z // big
  ELSE nbig + (z - big * nbig) // small END AS INTEGER) AS fold FROM u""")
def q_cv_folds_regression(spark, sf):
    """V7 contiguous folds (first n mod k one row larger) on the train part."""
    p = prep.split(table(spark, sf, "part").select("p_partkey"), "p_partkey")
    tr = p.where(~F.col("is_test")).drop("is_test")
    return prep.assign_folds(tr, 5, "p_partkey")


# ---------------------------------------------------------------- E6 kNN + V1-V3

_EMB_SPLIT = _split_sql("embeddings", "vec_id", "vec_id, label, CAST(embedding AS DOUBLE[]) AS x")
#: the same rows with each feature standardised by the training part
_EMB_SCALED = f"""(WITH s AS {_EMB_SPLIT},
u AS (SELECT vec_id, label, is_test, i, x[i] AS v FROM s, range(1, 65) r(i)),
m AS (SELECT i, avg(v) AS mu, stddev_pop(v) AS sd FROM u WHERE NOT is_test GROUP BY i)
SELECT vec_id, label, is_test, list((v - mu) / CASE WHEN sd IS NULL OR sd = 0 THEN 1 ELSE sd END ORDER BY i) AS x
FROM u JOIN m USING (i) GROUP BY vec_id, label, is_test)"""


def _knn_sql(k: int = 5, s: str = _EMB_SPLIT) -> str:
    return f"""(WITH t AS {s},
d AS (SELECT a.vec_id AS id, b.vec_id AS nid, b.label AS nlabel,
        list_distance(a.x, b.x) AS dist FROM t a JOIN t b ON a.is_test AND NOT b.is_test),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS rk
      FROM d) WHERE rk <= {k}),
v AS (SELECT id, nlabel, count(*) AS c FROM k GROUP BY id, nlabel),
p AS (SELECT id, nlabel AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY id
      ORDER BY c DESC, nlabel) AS r FROM v) WHERE r = 1)
SELECT t.vec_id, CAST(t.label AS DOUBLE) AS label, CAST(p.prediction AS DOUBLE) AS prediction
FROM t JOIN p ON t.vec_id = p.id)"""


def _knn_spark(spark, sf, k=5):
    e = prep.split(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), "vec_id")
    tr = e.where(~F.col("is_test"))
    te = e.where(F.col("is_test"))
    pred = knn_predict(tr, te, "vec_id", "embedding", "label", k)
    return te.select("vec_id", F.col("label").cast("double").alias("label")).join(pred, "vec_id")


@query("knn_predict", f"SELECT * FROM {_knn_sql(5)}")
def q_knn_predict(spark, sf):
    """Exact 5-NN (Euclidean, ties by key, vote ties by label) on embeddings."""
    return _knn_spark(spark, sf, 5)


def _stats_sql(pred: str) -> str:
    return f"""c AS (SELECT label AS a, prediction AS p, count(*) AS n FROM {pred} GROUP BY ALL),
pa AS (SELECT a AS cls, sum(n) AS support, sum(CASE WHEN a = p THEN n ELSE 0 END) AS tp
       FROM c GROUP BY a),
pp AS (SELECT p AS cls, sum(n) AS predicted FROM c GROUP BY p),
s AS (SELECT coalesce(pa.cls, pp.cls) AS cls, CAST(coalesce(support, 0) AS DOUBLE) AS support,
        CAST(coalesce(tp, 0) AS DOUBLE) AS tp, CAST(coalesce(predicted, 0) AS DOUBLE) AS predicted
      FROM pa FULL JOIN pp ON pa.cls = pp.cls),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS prec,
        CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rec FROM s),
f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1
      FROM m)"""


def _clf_metrics_sql(pred: str) -> str:
    return f"""WITH {_stats_sql(pred)}
SELECT round(sum(tp) / sum(support), 6) AS accuracy,
  round(sum(prec * support) / sum(support), 6) AS precision,
  round(sum(rec * support) / sum(support), 6) AS recall,
  round(sum(f1 * support) / sum(support), 6) AS f1_score FROM f"""


@query("clf_metrics", _clf_metrics_sql(_knn_sql(5)))
def q_clf_metrics(spark, sf):
    """V1 on the kNN predictions."""
    return ev.clf_metrics(_knn_spark(spark, sf, 5))


@query("confusion_matrix", f"""
WITH p AS {_knn_sql(5)},
l AS (SELECT label AS l FROM p UNION SELECT prediction FROM p),
g AS (SELECT a.l AS actual, b.l AS predicted FROM l a, l b),
c AS (SELECT label AS actual, prediction AS predicted, count(*) AS count FROM p GROUP BY ALL)
SELECT g.actual, g.predicted, coalesce(c.count, 0) AS count FROM g LEFT JOIN c
  ON g.actual = c.actual AND g.predicted = c.predicted""")
def q_confusion_matrix(spark, sf):
    """V2 full grid over the label union."""
    return ev.confusion_matrix(_knn_spark(spark, sf, 5))


@query("classification_report", f"""
WITH {_stats_sql(_knn_sql(5))}
SELECT CAST(CAST(cls AS BIGINT) AS VARCHAR) AS class, round(prec, 6) AS precision,
  round(rec, 6) AS recall, round(f1, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', round(avg(prec), 6), round(avg(rec), 6), round(avg(f1), 6),
  CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(prec * support) / sum(support), 6),
  round(sum(rec * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM f""")
def q_classification_report(spark, sf):
    """V3 per-class report with accuracy, macro and weighted rows."""
    return ev.classification_report(_knn_spark(spark, sf, 5))


# ---------------------------------------------------------------- E8 + V4-V6

def _part_split_sql():
    return _split_sql("part", "p_partkey",
                      "p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y")


def _lin_sql(x: str = "x") -> str:
    return f"""(WITH s AS {_part_split_sql()},
c AS (SELECT regr_slope(y, {x}) AS slope, regr_intercept(y, {x}) AS intercept FROM s
      WHERE NOT is_test)
SELECT p_partkey, y AS label, intercept + slope * {x} AS prediction FROM s, c WHERE is_test)"""


def _lin_spark(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"),
                                        F.col("p_retailprice").alias("label"))
    s = prep.split(p, "p_partkey")
    va = VectorAssembler(inputCols=["x"], outputCol="features")
    tr = va.transform(s.where(~F.col("is_test")))
    model = LinearRegression(regParam=0.0, solver="normal").fit(tr)
    pred = model.transform(va.transform(s.where(F.col("is_test"))))
    return model, pred.select("p_partkey", "label", "prediction")


@query("linreg_one_feature", f"""
WITH s AS {_part_split_sql()}
SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept,
  count(*) AS n_train FROM s WHERE NOT is_test""")
def q_linreg_one_feature(spark, sf):
    """MLlib least squares equals SQL regr_slope / regr_intercept."""
    model, _ = _lin_spark(spark, sf)
    n = prep.split(table(spark, sf, "part").select("p_partkey"), "p_partkey") \
        .where(~F.col("is_test")).count()
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept), n)],
                                 "slope double, intercept double, n_train long")


@query("reg_metrics", f"""
WITH p AS {_lin_sql()}, m AS (SELECT avg(label) AS mu FROM p)
SELECT round(avg((label - prediction) ^ 2), 6) AS mse,
  round(sqrt(avg((label - prediction) ^ 2)), 6) AS rmse,
  round(avg(abs(label - prediction)), 6) AS mae,
  round(1 - sum((label - prediction) ^ 2) / sum((label - mu) ^ 2), 6) AS r2_score FROM p, m""")
def q_reg_metrics(spark, sf):
    """V4 on the least-squares test predictions."""
    return ev.reg_metrics(_lin_spark(spark, sf)[1])


@query("pred_vs_actual", f"""
SELECT p_partkey, round(label, 6) AS actual, round(prediction, 6) AS predicted FROM {_lin_sql()}""")
def q_pred_vs_actual(spark, sf):
    """V5 actual and predicted values of all test rows."""
    return ev.pred_vs_actual(_lin_spark(spark, sf)[1], "p_partkey")


@query("residuals", f"""
SELECT p_partkey, round(label, 6) AS actual, round(prediction, 6) AS predicted,
  round(label - prediction, 6) AS residual FROM {_lin_sql()}""")
def q_residuals(spark, sf):
    """V6 residuals of all test rows."""
    return ev.residuals(_lin_spark(spark, sf)[1], "p_partkey")


def _resid_hist_sql() -> str:
    from .q_charts import _hist_sql
    src = f"(SELECT label - prediction AS residual FROM {_lin_sql()})"
    return _hist_sql(src, "residual", "30")


@query("residual_hist", _resid_hist_sql())
def q_residual_hist(spark, sf):
    """V6 30-bin residual histogram."""
    return ev.residual_hist(_lin_spark(spark, sf)[1], "p_partkey")


# ---------------------------------------------------------------- V10-V12

def _runs_spark(spark, sf):
    knn5 = ev.clf_metrics(_knn_spark(spark, sf, 5))
    knn1 = ev.clf_metrics(_knn_spark(spark, sf, 1))
    lin = ev.reg_metrics(_lin_spark(spark, sf)[1])
    rows = [runs.run_row(knn5, "knn", "classification", "label", {"n_neighbors": 5}, "run_knn5"),
            runs.run_row(knn1, "knn", "classification", "label", {"n_neighbors": 1}, "run_knn1"),
            runs.run_row(lin, "linear_regression", "regression", "p_retailprice", {}, "run_lin")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _runs_sql() -> str:
    def clf(k, rid):
        return f"""SELECT '{rid}' AS run_id, 'knn' AS model_name, 'classification' AS problem_type,
          accuracy, precision, recall, f1_score, CAST(NULL AS DOUBLE) AS mse,
          CAST(NULL AS DOUBLE) AS rmse, CAST(NULL AS DOUBLE) AS mae, CAST(NULL AS DOUBLE) AS r2_score
          FROM ({_clf_metrics_sql(_knn_sql(k))})"""
    reg = f"""SELECT 'run_lin' AS run_id, 'linear_regression' AS model_name,
      'regression' AS problem_type, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
      CAST(NULL AS DOUBLE), mse, rmse, mae, r2_score FROM (WITH p AS {_lin_sql()},
      m AS (SELECT avg(label) AS mu FROM p) SELECT round(avg((label - prediction) ^ 2), 6) AS mse,
      round(sqrt(avg((label - prediction) ^ 2)), 6) AS rmse,
      round(avg(abs(label - prediction)), 6) AS mae,
      round(1 - sum((label - prediction) ^ 2) / sum((label - mu) ^ 2), 6) AS r2_score FROM p, m)"""
    return f"({clf(5, 'run_knn5')} UNION ALL {clf(1, 'run_knn1')} UNION ALL {reg})"


_MET = ["accuracy", "precision", "recall", "f1_score", "mse", "rmse", "mae", "r2_score"]


@query("model_summary", f"""
SELECT run_id, model_name, problem_type,
  CASE WHEN problem_type = 'classification' THEN 'accuracy' ELSE 'r2_score' END AS primary_metric,
  CASE WHEN problem_type = 'classification' THEN accuracy ELSE r2_score END AS value,
  CASE WHEN problem_type = 'classification' THEN 'label' ELSE 'p_retailprice' END AS target
FROM {_runs_sql()}""")
def q_model_summary(spark, sf):
    """V11 primary metric per run (kNN k=5, k=1 and least squares)."""
    return runs.model_summary(_runs_spark(spark, sf))


@query("model_comparison", f"""
WITH r AS {_runs_sql()},
b AS (SELECT problem_type, {', '.join(f"{'max' if m in runs.HIGHER_IS_BETTER else 'min'}({m}) AS b_{m}" for m in _MET)}
      FROM r GROUP BY problem_type)
SELECT run_id, model_name, r.problem_type, {', '.join(_MET)},
  {', '.join(f"coalesce({m} IS NOT NULL AND {m} = b_{m}, FALSE) AS best_{m}" for m in _MET)}
FROM r JOIN b ON r.problem_type = b.problem_type""")
def q_model_comparison(spark, sf):
    """V12 one row per run; best marked by max (min for error metrics)."""
    return runs.model_comparison(_runs_spark(spark, sf), _MET)


@query("model_runs", f"""
SELECT run_id, model_name, problem_type, target, metric, value FROM (
  SELECT run_id, model_name, problem_type,
    CASE WHEN problem_type = 'classification' THEN 'label' ELSE 'p_retailprice' END AS target, {', '.join(_MET)}
  FROM {_runs_sql()}) UNPIVOT (value FOR metric IN ({', '.join(_MET)}))""")
def q_model_runs(spark, sf):
    """Record the runs in the registry table and read them back, metrics flat."""
    from ..sources.ingest import scratch_path
    path = scratch_path(spark, "runs")
    runs.clear_runs(spark, path)
    runs.record_run(spark, _runs_spark(spark, sf), path)
    return runs.load_runs(spark, path).select("run_id", "model_name", "problem_type", "target",
                                              F.explode("metrics").alias("metric", "value"))


# ---------------------------------------------------------------- E1-E11 fits (rows checks)

def _emb_features(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}")
                                         for i in range(64)])


def _train_query(model_name, problem_type="classification", binary=False, params="{}",
                 cv=False, regression_src=False):
    def fn(spark, sf):
        if regression_src:
            df = table(spark, sf, "orders")
            res = train(df, "o_totalprice", model_name, params, "regression", key="o_orderkey",
                        run_cv=cv)
        else:
            df = _emb_features(spark, sf)
            if binary:
                df = df.withColumn("label", (F.col("label") < 5).cast("int"))
            res = train(df, "label", model_name, params, problem_type, key="vec_id", run_cv=cv)
        m = res.metrics
        return m.select(F.lit(model_name).alias("model_name"), F.lit(res.train_size).alias("train_size"),
                        F.lit(res.test_size).alias("test_size"), "*")
    fn.__doc__ = f"E: fit {model_name} ({problem_type}) and score the test part (rows check)."
    return fn


_TRAIN_SQL = {"train_knn": f"""
SELECT 'knn' AS model_name, (SELECT CAST(count_if(NOT is_test) AS INTEGER) FROM {_EMB_SPLIT}) AS train_size,
  (SELECT CAST(count_if(is_test) AS INTEGER) FROM {_EMB_SPLIT}) AS test_size, m.*
FROM ({_clf_metrics_sql(_knn_sql(5, _EMB_SCALED))}) m"""}

for _name, _kw in {
    "train_logistic_regression": dict(model_name="logistic_regression"),
    "train_decision_tree": dict(model_name="decision_tree"),
    "train_random_forest": dict(model_name="random_forest", binary=True),
    "train_gradient_boosting": dict(model_name="gradient_boosting", binary=True),
    "train_xgboost": dict(model_name="xgboost", binary=True),
    "train_xgboost_classes": dict(model_name="xgboost", params='{"n_estimators": 10, "max_depth": 3, "max_bins": 32}'),
    "train_gradient_boosting_classes": dict(model_name="gradient_boosting", params='{"n_estimators": 10, "max_bins": 32}'),
    "train_xgboost_regressor": dict(model_name="xgboost", regression_src=True, params='{"n_estimators": 20, "max_depth": 4}'),
    "train_svm_linear": dict(model_name="svm", binary=True, params='{"kernel": "linear"}'),
    "train_svm_rbf": dict(model_name="svm", binary=True),
    "train_knn": dict(model_name="knn"),
    "train_linear_regression": dict(model_name="linear_regression", regression_src=True),
    "train_ridge": dict(model_name="ridge", regression_src=True),
    "train_lasso": dict(model_name="lasso", regression_src=True),
    "train_random_forest_regressor": dict(model_name="random_forest", regression_src=True),
    "train_decision_tree_regressor": dict(model_name="decision_tree", regression_src=True),
    "train_gbt_regressor": dict(model_name="gradient_boosting", regression_src=True),
    "train_svr": dict(model_name="svr", regression_src=True),
}.items():
    query(_name, _TRAIN_SQL.get(_name))(_train_query(**_kw))


def _part_one_feature(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")


def _one_feature_sql(slope: str) -> str:
    """Slope and intercept of a penalised line on the training part, from its moments."""
    return f"""
WITH s AS {_part_split_sql()},
m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy
      FROM s WHERE NOT is_test),
w AS (SELECT *, {slope} AS w FROM m)
SELECT round(w, 6) AS slope, round(my - w * mx, 6) AS intercept FROM w"""


def _one_feature(spark, sf, model, params):
    res = train(_part_one_feature(spark, sf), "p_retailprice", model, params, "regression", key="p_partkey", run_cv=False)
    line = res.model.stages[-1]
    return spark.createDataFrame([(float(line.coefficients[0]), float(line.intercept))], "slope double, intercept double")


@query("ridge_one_feature", _one_feature_sql("sxy / (sxx + 50.0)"))
def q_ridge_one_feature(spark, sf):
    """The ridge line of one feature in closed form, alpha = 50."""
    return _one_feature(spark, sf, "ridge", {"alpha": 50.0})


@query("lasso_one_feature", _one_feature_sql("sign(sxy) * greatest(abs(sxy) / n - 2.0, 0) / (sxx / n)"))
def q_lasso_one_feature(spark, sf):
    """The lasso line of one feature by soft threshold, alpha = 2."""
    return _one_feature(spark, sf, "lasso", {"alpha": 2.0})


@query("tree_stump", f"""
WITH s AS {_part_split_sql()},
c AS (SELECT x, count(*) AS n, sum(y) AS t FROM s WHERE NOT is_test GROUP BY x),
a AS (SELECT sum(n) AS n, sum(t) AS t FROM c),
k AS (SELECT x, sum(n) OVER (ORDER BY x) AS ln, sum(t) OVER (ORDER BY x) AS lt FROM c),
g AS (SELECT ln, lt, a.n - ln AS rn, a.t - lt AS rt FROM k, a WHERE a.n > ln
      ORDER BY lt * lt / ln + (a.t - lt) * (a.t - lt) / (a.n - ln) DESC LIMIT 1)
SELECT CAST(ln AS BIGINT) AS n, round(lt / ln, 6) AS prediction FROM g
UNION ALL SELECT CAST(rn AS BIGINT), round(rt / rn, 6) FROM g""")
def q_tree_stump(spark, sf):
    """A regression tree of depth 1 finds the split of least squared error."""
    from ..ml.prep import split as cut
    part = _part_one_feature(spark, sf)
    res = train(part, "p_retailprice", "decision_tree", {"max_depth": 1}, "regression", key="p_partkey", run_cv=False)
    rows = cut(part.withColumn("p_size", F.col("p_size").cast("double")), "p_partkey").where(~F.col("is_test"))
    return res.model.transform(rows.withColumn("label", F.col("p_retailprice"))) \
        .groupBy("prediction").agg(F.count(F.lit(1)).alias("n")).select("n", "prediction")


def _tree_level(source: str, out: str) -> str:
    """The rows of ``source`` (a, b, y, node) with the children of each node's best split:
    the greatest sum of squared sums over counts, then the first feature, then the least value."""
    return f"""
{out}_v AS (SELECT node, 0 AS f, a AS v, y FROM {source} UNION ALL SELECT node, 1, b, y FROM {source}),
{out}_g AS (SELECT node, f, v, count(*) AS n, sum(y) AS t FROM {out}_v GROUP BY ALL),
{out}_r AS (SELECT node, f, v, sum(n) OVER w AS ln, sum(t) OVER w AS lt, sum(n) OVER (PARTITION BY node, f) AS n,
  sum(t) OVER (PARTITION BY node, f) AS t, lead(v) OVER (PARTITION BY node, f ORDER BY v) AS following
  FROM {out}_g WINDOW w AS (PARTITION BY node, f ORDER BY v)),
{out}_s AS (SELECT node, f, v, row_number() OVER (PARTITION BY node ORDER BY lt * lt / ln + (t - lt) * (t - lt) / (n - ln) DESC, f, v) AS k
  FROM {out}_r WHERE following IS NOT NULL),
{out} AS (SELECT a, b, y, 2 * s.node + CASE WHEN CASE WHEN f = 0 THEN a ELSE b END <= v THEN 1 ELSE 2 END AS node
  FROM {source} s JOIN {out}_s x ON x.node = s.node AND x.k = 1)"""


@query("tree_two_levels", f"""
WITH s AS {_part_split_sql()},
r0 AS (SELECT x AS a, p_partkey % 13 AS b, y - (SELECT avg(y) FROM s WHERE NOT is_test) AS y, 0 AS node FROM s WHERE NOT is_test),
{_tree_level('r0', 'r1')}, {_tree_level('r1', 'r2')}
SELECT count(*) AS n, round(avg(y) + (SELECT avg(y) FROM s WHERE NOT is_test), 6) AS prediction FROM r2 GROUP BY node""")
def q_tree_two_levels(spark, sf):
    """A regression tree of depth 2 over two features has the leaves of two levels of
    exact best splits."""
    from ..ml.prep import split as cut
    part = _part_one_feature(spark, sf).withColumn("b", F.col("p_partkey") % 13)
    res = train(part, "p_retailprice", "decision_tree", {"max_depth": 2}, "regression", key="p_partkey", run_cv=False)
    rows = cut(part.withColumn("p_size", F.col("p_size").cast("double")), "p_partkey").where(~F.col("is_test"))
    return res.model.transform(rows).groupBy("prediction").agg(F.count(F.lit(1)).alias("n")).select("n", "prediction")


@query("boosting_log_loss")
def q_boosting_log_loss(spark, sf):
    """Ten classes boosted jointly; the log-loss of the training rows after each round."""
    from pyspark.ml.feature import VectorAssembler

    from ..ml.boost import BoostedModel, BoostedTrees
    rows = VectorAssembler(inputCols=[f"f{i}" for i in range(64)], outputCol="features").transform(_emb_features(spark, sf))
    model = BoostedTrees("classification", 12, 3, 0.1, newton=False, max_bins=32).fit(rows.select("features", "label"))
    out = None
    for t in range(len(model.rounds) + 1):
        part = BoostedModel(model.rounds[:t], model.base, model.classes, model.k, model.d, "features")
        at = F.array_position(F.array(*[F.lit(c) for c in model.classes]), F.col("label").cast("double")).cast("int")
        total = F.aggregate("raw", F.lit(0.0), lambda s, v: s + F.exp(v))
        loss = part.transform(rows.select("features", "label")).agg(F.avg(F.log(total) - F.element_at("raw", at)).alias("log_loss")) \
            .select(F.lit(t).alias("round"), "log_loss")
        out = loss if out is None else out.unionByName(loss)
    return out


def _cv_sql(slope: str) -> str:
    """R squared of five folds of a line with the given slope."""
    return f"""
WITH t AS (SELECT *, row_number() OVER (ORDER BY h, p_partkey) - 1 AS z, count(*) OVER () AS n
           FROM {_part_split_sql()} WHERE NOT is_test),
u AS (SELECT x, y, CAST(CASE WHEN z < (n // 5 + 1) * (n % 5) THEN z // (n // 5 + 1)
        ELSE n % 5 + (z - (n // 5 + 1) * (n % 5)) // (n // 5) END AS INTEGER) AS fold FROM t),
f AS (SELECT k.fold, {slope} AS w, avg(y) - {slope} * avg(x) AS b
      FROM (SELECT DISTINCT fold FROM u) k JOIN u ON u.fold <> k.fold GROUP BY k.fold),
m AS (SELECT fold, avg(y) AS mu FROM u GROUP BY fold),
r AS (SELECT u.fold, 1 - sum((y - b - w * x) ^ 2) / sum((y - mu) ^ 2) AS score
      FROM u JOIN f USING (fold) JOIN m USING (fold) GROUP BY u.fold)
SELECT fold, round(score, 6) AS score, round(avg(score) OVER (), 6) AS mean,
  round(sqrt(avg(score * score) OVER () - (avg(score) OVER ()) ^ 2), 6) AS std FROM r"""


@query("cv_scores_ridge", _cv_sql("(covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 5000.0))"))
def q_cv_scores_ridge(spark, sf):
    """V7: R squared of each of 5 folds of a ridge line, alpha = 5000, from one scan."""
    return train(_part_one_feature(spark, sf), "p_retailprice", "ridge", {"alpha": 5000.0}, "regression",
                 key="p_partkey", run_cv=True).cv_scores


@query("cv_scores", _cv_sql("regr_slope(y, x)"))
def q_cv_scores(spark, sf):
    """V7: R squared of each of 5 folds, least squares on one feature."""
    return train(_part_one_feature(spark, sf), "p_retailprice", "linear_regression", "{}", "regression",
                 key="p_partkey", run_cv=True).cv_scores


@query("feature_importance")
def q_feature_importance(spark, sf):
    """V8/V9: tree importances, descending (top 15 shown by callers)."""
    res = train(table(spark, sf, "orders"), "o_totalprice", "decision_tree", "{}", "regression", key="o_orderkey",
                run_cv=False)
    return res.feature_importance
