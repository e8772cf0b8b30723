"""Distinct rows where the first one counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unused


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row for each value of keys (nulls are equal), the first by order. Rank filters of this form are cut down
    before they are exchanged."""
    rank = unused(df, "_rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order))).filter(F.col(rank) == 1).drop(rank)


def top(df: DataFrame, keys: list[str], order: list[str | Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)
