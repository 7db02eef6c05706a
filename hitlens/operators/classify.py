"""Multinomial site classifier."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.sql import DataFrame


def fit_classifier(
    features: DataFrame, label: str = "domain_index", max_iter: int = 100, depth: int = 2
) -> LogisticRegressionModel:
    """Distributed fit; raise ``depth`` (tree levels of the gradient sum) with many classes."""
    return LogisticRegression(
        featuresCol="features",
        labelCol=label,
        family="multinomial",
        maxIter=max_iter,
        aggregationDepth=depth,
    ).fit(features)
