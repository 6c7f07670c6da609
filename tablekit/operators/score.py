"""Scoring: align a table to a model's features, predict, format."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablekit.functions.columns import col, numeric_or_zero


def align(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """keep... and the training features in training order; absent or unparsable values are 0.0."""
    return df.select(*[col(c) for c in keep], *[numeric_or_zero(df, c).alias(c) for c in features])


def format_confidence(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Confidence = the highest class probability as xx.xx%."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import VectorUDT

    value = col(probability)
    if isinstance(df.schema[probability].dataType, VectorUDT):
        value = vector_to_array(value)
    return df.withColumn("Confidence", F.format_string("%.2f%%", F.array_max(value) * 100))


def predict(model, df: DataFrame) -> DataFrame:
    """df with prediction (class name or number) and, for classifiers that have one, probability."""
    return model.transform(df)


def score_batch(model, df: DataFrame) -> DataFrame:
    """The original columns plus Prediction and, where the model gives probabilities, Confidence."""
    scored = model.transform(df)
    result = scored.withColumn("Prediction", F.col("prediction"))
    if "probability" in scored.columns:
        result = format_confidence(result)
        return result.select(*[col(c) for c in df.columns], "Prediction", "Confidence")
    return result.select(*[col(c) for c in df.columns], "Prediction")


def preview(df: DataFrame, order_by: list[str], n: int = 100) -> DataFrame:
    """The first n rows by key, for display only."""
    return df.orderBy(*[col(c) for c in order_by]).limit(n)
