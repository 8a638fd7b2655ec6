"""Three-class signal labels from forward returns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.quantiles import exact_quantiles


@dataclass(frozen=True)
class Thresholds:
    lower: float | None
    upper: float | None


def fit_thresholds(features: DataFrame, column: str = "future_return",
                   lower: float = 0.30, upper: float = 0.70) -> Thresholds:
    """Percentiles over every ticker and date of ``features``.

    The reference takes them over train and test rows together; pass only training rows to keep
    the test rows out of them.
    """
    return Thresholds(*exact_quantiles(features, column, [lower, upper]))


def add_signal_label(features: DataFrame, t: Thresholds, column: str = "future_return") -> DataFrame:
    """1 at or above the upper threshold, else -1 at or below the lower one, else 0 (also for null)."""
    r = F.col(column)
    return features.withColumn("signal_label", F.when(r >= F.lit(t.upper), 1)
                               .when(r <= F.lit(t.lower), -1).otherwise(0))


def class_index(label: Column) -> Column:
    """Labels -1, 0, 1 as classes 0, 1, 2."""
    return (label + 1).cast("int")
