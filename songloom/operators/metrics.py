"""Error measures of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _squared(label: str, prediction: str) -> Column:
    gap = F.col(label).cast("double") - F.col(prediction).cast("double")
    return gap * gap


def _is_usable(label: str, prediction: str) -> Column:
    value = F.col(prediction)
    return F.col(label).isNotNull() & value.isNotNull() & ~F.isnan(value)


def _usable(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.filter(_is_usable(label, prediction))


def rmse(df: DataFrame, label: str = "listen_count", prediction: str = "prediction") -> DataFrame:
    """Root mean squared error; rows without a usable prediction are left out."""
    usable = _usable(df, label, prediction)
    return usable.agg(F.sqrt(F.avg(_squared(label, prediction))).alias("rmse"))


def rmse_and_pairs(df: DataFrame, label: str = "listen_count", prediction: str = "prediction") -> DataFrame:
    """:func:`rmse`, and how many rows there are, usable or not."""
    squared = F.when(_is_usable(label, prediction), _squared(label, prediction))
    return df.agg(F.sqrt(F.avg(squared)).alias("rmse"), F.count(F.lit(1)).alias("pairs"))


def mse(
    df: DataFrame,
    label: str = "listen_count",
    prediction: str = "prediction",
    by: str | None = None,
) -> DataFrame:
    """Mean squared error, over everything or per batch."""
    usable = _usable(df, label, prediction)
    groups = [by] if by else []
    return usable.groupBy(*groups).agg(F.avg(_squared(label, prediction)).alias("mse"))
