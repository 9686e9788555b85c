"""Connected components of a graph of links, by DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import Workspace


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """``node, comp`` for each node of ``edges`` (columns a, b): the smallest node that links reach.

    Each round gives a node the smallest label among its neighbours and itself, then the label of that
    label. Rounds are written, so no lineage grows; their number is about the logarithm of the longest
    chain. Labels are aggregated before they are shuffled, and a node with very many links is an ordinary
    join key whose rows can be split.
    """
    both = ws.keep(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    labels = ws.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        next_ = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        next_ = ws.keep(next_.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")), f"{name}-{turn}")
        labels = next_.select("node", "comp")
        if not next_.filter("comp != old").head(1):
            return labels
