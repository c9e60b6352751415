"""Evaluation (V1-V6): every metric is an aggregate over (label, prediction)
counts; the label set is the sorted union of actual and predicted labels
(bounded by the number of classes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.charts import histogram
from ..operators.profile import with_scalars


def _div0(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_stats(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class of the label union: tp, support, predicted, precision, recall, f1."""
    counts = pred.groupBy(F.col(label).alias("a"), F.col(prediction).alias("p")) \
        .agg(F.count(F.lit(1)).alias("n"))
    per_a = counts.groupBy(F.col("a").alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("a") == F.col("p"), F.col("n"))
                                           .otherwise(0)).alias("tp"))
    per_p = counts.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    s = (per_a.join(per_p, "cls", "full")
         .select("cls", F.coalesce("support", F.lit(0)).cast("bigint").alias("support"),
                 F.coalesce("tp", F.lit(0)).cast("bigint").alias("tp"),
                 F.coalesce("predicted", F.lit(0)).cast("bigint").alias("predicted")))
    p = _div0(F.col("tp"), F.col("predicted"))
    r = _div0(F.col("tp"), F.col("support"))
    return (s.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1_score", _div0(2 * F.col("precision") * F.col("recall"),
                                          F.col("precision") + F.col("recall"))))


def clf_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """V1: accuracy and support-weighted precision, recall, F1 (zero division -> 0)."""
    s = class_stats(pred, label, prediction)
    return s.agg((F.sum("tp") / F.sum("support")).alias("accuracy"),
                 (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
                 (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
                 (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("f1_score"))


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                     full_grid: bool = True) -> DataFrame:
    """V2: (actual, predicted, count) over the label union. ``full_grid=False``
    leaves out the zeros: the grid has as many rows as classes squared, so targets
    with very many classes want the cells that occur only."""
    counts = pred.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("count"))
    if not full_grid:
        return counts
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("l")).distinct()
    grid = labels.select(F.col("l").alias("actual")).crossJoin(labels.select(F.col("l").alias("predicted")))
    return (grid.join(counts, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def _cls_name(c):
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def classification_report(pred: DataFrame, label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """V3: per class precision/recall/f1/support, then accuracy, macro avg and
    weighted avg rows (``class`` is a string)."""
    s = class_stats(pred, label, prediction)
    per = s.select(_cls_name(F.col("cls")).alias("class"), "precision", "recall", "f1_score",
                   "support")
    tot = s.agg(F.sum("support").alias("total"), (F.sum("tp") / F.sum("support")).alias("acc"),
                F.avg("precision").alias("mp"), F.avg("recall").alias("mr"),
                F.avg("f1_score").alias("mf"),
                (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1_score"),
                     F.col("total").alias("support"))
    mac = tot.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                     F.col("mr").alias("recall"), F.col("mf").alias("f1_score"),
                     F.col("total").alias("support"))
    wei = tot.select(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                     F.col("wr").alias("recall"), F.col("wf").alias("f1_score"),
                     F.col("total").alias("support"))
    return per.unionByName(acc).unionByName(mac).unionByName(wei)


def reg_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """V4: mse, rmse, mae, r2_score (1 - SSE/SST about the test mean)."""
    e = F.col(label) - F.col(prediction)
    mean = pred.agg(F.avg(label).alias("__mu"))
    j = with_scalars(pred, mean)
    return (j.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                  F.sum(e * e).alias("sse"), F.sum((F.col(label) - F.col("__mu")) ** 2).alias("sst"))
            .select("mse", F.sqrt("mse").alias("rmse"), "mae",
                    F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).alias("r2_score")))


def pred_vs_actual(pred: DataFrame, key: str, n: int | None = None, label: str = "label",
                   prediction: str = "prediction") -> DataFrame:
    """V5: actual and predicted values of the test rows; with ``n`` the first n by key."""
    out = pred.select(key, F.col(label).alias("actual"), F.col(prediction).alias("predicted"))
    return out if n is None else out.orderBy(key).limit(n)


def reference_line(pred: DataFrame, label: str = "label", prediction: str = "prediction"):
    """V5 line ends: min and max over actual and predicted."""
    return pred.agg(F.least(F.min(label), F.min(prediction)).alias("lo"),
                    F.greatest(F.max(label), F.max(prediction)).alias("hi"))


def residuals(pred: DataFrame, key: str, label: str = "label",
              prediction: str = "prediction") -> DataFrame:
    """V6: actual - predicted for every test row."""
    return pred.select(key, F.col(label).alias("actual"), F.col(prediction).alias("predicted"),
                       (F.col(label) - F.col(prediction)).alias("residual"))


def residual_hist(pred: DataFrame, key: str, bins: int = 30, label: str = "label",
                  prediction: str = "prediction") -> DataFrame:
    """V6 histogram of residuals (all test rows)."""
    return histogram(residuals(pred, key, label, prediction), "residual", bins)


def top_importances(importance: DataFrame, k: int = 15) -> DataFrame:
    """V9: the k largest feature importances."""
    return importance.orderBy(F.desc("importance"), "feature").limit(k)
