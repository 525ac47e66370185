"""Saving and loading fitted tree ensembles."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel

_KINDS = {
    "RandomForestRegressionModel": RandomForestRegressionModel,
    "GBTRegressionModel": GBTRegressionModel,
}


def save_model(model, path: str) -> str:
    """Write a fitted ensemble to ``path`` and return the path."""
    model.write().overwrite().save(path)
    return path


def model_kind(spark, path: str) -> str:
    """Class name recorded in the saved model's metadata."""
    meta = spark.read.json(f"{path.rstrip('/')}/metadata").select("class").first()
    return meta[0].rsplit(".", 1)[-1]


def load_model(spark, path: str):
    """Load a fitted ensemble; the kind is read from the saved metadata."""
    return _KINDS[model_kind(spark, path)].load(path)
