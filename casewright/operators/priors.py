"""Distributions of outcomes by key, and back-off between them by support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distribution(df: DataFrame, by: list[str], value: str = "y") -> DataFrame:
    """Counts, zero rate, and percentiles over the positive values (over all if none is positive) and over all; exact, linear between ranks."""
    v = F.col(value)
    positive = F.when(v > 0, v)
    some = lambda q: F.coalesce(F.percentile(positive, F.lit(q)), F.percentile(v, F.lit(q)))
    out = df.groupBy(*by).agg(
        F.count("*").alias("train_count"), F.count_if(v > 0).alias("positive_count"), F.count_if(v <= 0).alias("zero_count"),
        some(0.5).alias("median"), some(0.25).alias("p25"), some(0.75).alias("p75"), some(0.1).alias("p10"), some(0.9).alias("p90"), F.percentile(v, F.lit(0.5)).alias("median_all"),
    )
    rounded = [F.round(c, 6).alias(c) for c in ("median", "p25", "p75", "p10", "p90", "median_all")]
    return out.select(*by, "train_count", "positive_count", "zero_count", F.round(F.col("zero_count") / F.col("train_count"), 6).alias("zero_rate"), *rounded, F.round(F.col("p75") - F.col("p25"), 6).alias("iqr"))


def weighted_global(table: DataFrame, columns: list[str], count: str = "train_count") -> DataFrame:
    """Means of the buckets' values weighted by their counts, null if a value is missing."""
    n = F.col(count)
    each = [F.when(F.bool_and(F.col(c).isNotNull()), F.round(F.sum(F.col(c) * n) / F.sum(n), 6)).alias(c) for c in columns]
    return table.agg(F.sum(n).alias(count), *each)


def back_off(levels: list[tuple[str, Column, Column]], enough: int) -> tuple[Column, Column, Column]:
    """Name, value and support of the first level with enough support, else of the last one available, else nothing.

    ``levels``: name, value and support, null where a level does not exist.
    """
    def pick(part) -> Column:
        out = None
        for level in levels:
            condition = level[2] >= enough
            out = F.when(condition, part(level)) if out is None else out.when(condition, part(level))
        for level in reversed(levels):
            out = out.when(level[2].isNotNull(), part(level))
        return out

    return pick(lambda x: F.lit(x[0])), pick(lambda x: x[1]), pick(lambda x: x[2])
