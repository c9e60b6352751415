"""Named analysis plans over the driver tables: each registered query builds a
Spark DataFrame from ``(spark, sf_dir)`` and, where SQL can state the answer,
carries the equivalent DuckDB SQL used as the correctness oracle."""

from .registry import ORACLE, QUERIES, query  # noqa: F401
from . import q_ingest, q_profile, q_stats, q_charts, q_ml, q_tools  # noqa: F401,E402
