"""Joins on overlapping sets, with a strict date order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_join(targets: DataFrame, refs: DataFrame, set_col: str = "articles", date_col: str = "judgment_date", id_col: str = "case_id") -> DataFrame:
    """``target_id, ref_id, shared``: references strictly earlier than a target that share a member of its set.

    Sets are exploded and joined on the member, an equi-join with the date condition beside it, where a
    condition on arrays would be a nested loop. Counting the pairs gives the size of the intersection.
    Rows with a null set, date or id have no pairs; nobody is its own reference. Sets must be distinct.
    """
    left = targets.select(F.col(id_col).alias("target_id"), F.col(date_col).alias("target_date"), F.explode(set_col).alias("member"))
    right = refs.select(F.col(id_col).alias("ref_id"), F.col(date_col).alias("ref_date"), F.explode(set_col).alias("member"))
    return left.join(right, "member").filter("ref_date < target_date and ref_id != target_id").groupBy("target_id", "ref_id").agg(F.count("*").alias("shared"))


def jaccard(shared: Column, left: Column, right: Column) -> Column:
    """Of two sets by the sizes of both and of the intersection; 0 where both are empty."""
    union = left + right - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))
