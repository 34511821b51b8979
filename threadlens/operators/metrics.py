"""Class counts and model quality, each in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def mean_squared_error(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg(F.pow(F.col(label) - F.col(prediction), F.lit(2))).alias("mse"))


def error_rates(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of each class that is predicted otherwise; NULL for a class without rows."""
    wrong = F.col(label) != F.col(prediction)

    def share(value: float):
        is_class = F.col(label) == value
        return F.count_if(is_class & wrong) / F.nullif(F.count_if(is_class), F.lit(0))

    return df.agg(share(0.0).alias("false_positive"), share(1.0).alias("false_negative"))
