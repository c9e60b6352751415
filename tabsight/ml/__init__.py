"""Supervised learning on Spark: preparation, MLlib estimators, exact kNN,
evaluation, cross-validation and a run registry."""
