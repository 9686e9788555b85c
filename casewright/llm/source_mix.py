"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / quality, an exponential variable whose rate is the document's quality
weight, u coming from a digest of seed and id, so reruns and retries agree. Sorted by key within a
source, documents are a weighted sample without replacement in order of drawing. A source's target
is filled by complete epochs first; the rest goes to the first documents in key order whose prefix
sum of sizes comes nearest to it.

No source is sorted in one task: keys are counted in ``buckets`` ranges of their source, running
sums over the counts give each range its start, and only rows of one range are sorted together.

Defined results: null texts and texts without words have size 0 and are taken 0 times; a null source
is a source of its own, sorted last; rows with the same id and equal keys are told apart by their
size, else they are alike; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import Workspace, bounded_batches, fresh

#: ASCII characters that are neither letters nor white space.
MARKS = bytes(c for c in range(128) if not (chr(c).isalpha() or chr(c).isspace()))


def measure(texts: pd.Series) -> pd.DataFrame:
    """Stretches without white space, and a rate from 0.5 to 2: the share of letters and white space, low for symbol noise.

    Python's C string functions count words here several times faster than Java's regular expressions.
    """
    size, quality = np.zeros(len(texts), np.int64), np.ones(len(texts))
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        size[i] = len(raw.split())
        quality[i] = 0.5 + 1.5 * len(raw.translate(None, MARKS)) / max(1, len(raw))
    return pd.DataFrame({"size": size, "quality": quality})


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``; there is a row for each source.

    Targets are min(most x size, level x weight), with one level for all: capped sources are those with
    the least room for their weight. Putting the excess out again by weight ends at the same targets.
    The windows go over the table of sources, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    some = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(some, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("room", F.col("cap") / F.col("weight"))
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(1))
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    level = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "level"))).over(all_rows)["level"]
    target = F.when(F.col("room") < F.coalesce(level, F.lit(float("inf"))), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(df: DataFrame, ws: Workspace, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, buckets: int = 4096, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality_col: str | None = None, whole: bool = False) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken``, a row for each document.

    The document at which a budget ends gives only the words that are left, or with ``whole`` all or none.
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf("size long, quality double")
    def measured(texts: pd.Series) -> pd.DataFrame:
        return measure(texts)

    docs = df.select(df[id_col].alias("doc_id"), df[source_col].alias("source"), measured(df[text_col]).alias("m"), (df[quality_col] if quality_col else F.lit(None)).cast("double").alias("given"))
    docs = docs.select("doc_id", "source", F.col("m.size").alias("size"), F.coalesce("given", "m.quality").alias("quality"))
    docs = docs.select("doc_id", "source", "size", (-F.log(uniform(F.col("doc_id"), seed)) / F.greatest("quality", F.lit(1e-9))).alias("key"))
    docs = docs.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor(F.col("key") * (buckets / 16.0))).cast("int"))
    docs = docs.withColumn("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))  # never null: joins need no second exchange
    docs = ws.keep(docs, "measured")  # texts are read once

    counts = docs.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("start", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
    sizes = counts.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sizes.withColumn("source", F.when(F.col("source") != "", F.substring("source", 2, 2**31 - 1))), weights, share, most)
    targets = targets.withColumn("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    plan = counts.join(targets, "source").select("source", "bucket", "start", "source_size", "target")

    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(plan, ["source", "bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    placed = placed.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    left = F.floor(F.col("rest") - F.col("start") - F.col("within"))
    more = F.when(left >= F.col("size") / 2, F.col("size")).otherwise(0) if whole else F.greatest(F.lit(0), F.least(F.col("size"), left))
    source = F.when(F.col("source") != "", F.substring("source", 2, 2**31 - 1))
    return placed.select("doc_id", "size", source.alias("source"), "source_size", "target", (F.col("size") * F.col("epochs") + more).cast("long").alias("taken"))


def mixed_documents(df: DataFrame, ws: Workspace, text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, whole documents only; rows alike in all columns share their turns."""
    key, times, turn = fresh(df, "_key", "_times", "_turn")
    marked = df.withColumn(key, F.sha1(F.to_json(F.struct(*df.columns)).cast("binary")))
    taken = mix(marked, ws, id_col=key, text_col=text_col, source_col=source_col, whole=True, **how)
    # rows of one key are alike in all columns: one of them is repeated for all
    taken = taken.filter("size > 0").groupBy(F.col("doc_id").alias(key)).agg(F.sum((F.col("taken") / F.col("size")).cast("long")).alias(times), F.count("*").alias(turn))
    alone = marked.join(taken.filter(F.col(turn) == 1).drop(turn), key)
    alike = marked.join(taken.filter(F.col(turn) > 1).drop(turn), key).dropDuplicates([key])
    return alone.unionByName(alike).filter(F.col(times) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*df.columns)
