"""Run registry (V10) and run comparison.

Runs are rows of a Parquet table in the warehouse, or below a given path:
run_id, model_name, problem_type, target, metrics (map), params (JSON)."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = ("run_id string, model_name string, problem_type string, target string, "
              "metrics map<string,double>, params string")
HIGHER_IS_BETTER = ("accuracy", "precision", "recall", "f1_score", "r2_score")
LOWER_IS_BETTER = ("mse", "rmse", "mae")


def runs_path(spark: SparkSession) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tabsight_runs"


def run_row(metrics: DataFrame, model_name: str, problem_type: str, target: str,
            params: dict | None = None, run_id: str | None = None) -> DataFrame:
    """One run as a one-row DataFrame built from a one-row metrics frame."""
    names = metrics.columns
    return metrics.select(
        F.lit(run_id or uuid.uuid4().hex).alias("run_id"), F.lit(model_name).alias("model_name"),
        F.lit(problem_type).alias("problem_type"), F.lit(target).alias("target"),
        F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])
        .alias("metrics"),
        F.lit(json.dumps(params or {}, sort_keys=True)).alias("params"))


def record_run(spark: SparkSession, run: DataFrame, path: str | None = None) -> None:
    """V10 append."""
    run.write.mode("append").parquet(path or runs_path(spark))


def load_runs(spark: SparkSession, path: str | None = None) -> DataFrame:
    try:
        return spark.read.schema(RUN_SCHEMA).parquet(path or runs_path(spark))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # no run recorded yet
        return spark.createDataFrame([], RUN_SCHEMA)


def clear_runs(spark: SparkSession, path: str | None = None) -> None:
    """V10 clear: replace with an empty table."""
    spark.createDataFrame([], RUN_SCHEMA).write.mode("overwrite").parquet(path or runs_path(spark))


def model_summary(runs: DataFrame) -> DataFrame:
    """Primary metric per run (accuracy, or R^2 for regression)."""
    primary = F.when(F.col("problem_type") == "classification", F.lit("accuracy")) \
        .otherwise(F.lit("r2_score"))
    return runs.select("run_id", "model_name", "problem_type", "target",
                       primary.alias("primary_metric"),
                       F.element_at("metrics", primary).alias("value"))


def model_comparison(runs: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """One row per run, one column per metric, ``best_<metric>`` marks the
    best run per problem type (max, or min for error metrics)."""
    metrics = metrics or list(HIGHER_IS_BETTER + LOWER_IS_BETTER)
    wide = runs.select("run_id", "model_name", "problem_type",
                       *[F.element_at("metrics", F.lit(m)).alias(m) for m in metrics])
    best = wide.groupBy("problem_type").agg(
        *[(F.max(m) if m in HIGHER_IS_BETTER else F.min(m)).alias(f"__b_{m}") for m in metrics])
    j = wide.join(best, "problem_type", "left")
    return j.select("run_id", "model_name", "problem_type", *metrics,
                    *[(F.col(m).isNotNull() & (F.col(m) == F.col(f"__b_{m}"))).alias(f"best_{m}")
                      for m in metrics])
