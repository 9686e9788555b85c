"""Idempotent ingestion: merges, plans, resumption, and the same over Structured Streaming.

Watermarks and event-time windows are extensions of the batch operators, not part of what they replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def row_hash(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def merge_actions(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, action``: added, unchanged, updated or kept (only in the old table)."""
    a = old.select(F.col(key).alias("old_key"), row_hash(*columns).alias("old_hash"))
    b = new.select(F.col(key).alias("new_key"), row_hash(*columns).alias("new_hash"))
    action = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "kept").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("updated")
    return a.join(b, F.col("old_key") == F.col("new_key"), "full_outer").select(F.coalesce("old_key", "new_key").alias(key), action.alias("action"))


def merged(old: DataFrame, new: DataFrame, key: str, columns: list[str], overwrite: bool = False) -> DataFrame:
    """The old table with new rows added and, if allowed, changed ones replaced; else a change is an error when the plan runs."""
    actions = merge_actions(old, new, key, columns)
    if not overwrite:
        actions = actions.withColumn("action", F.when(F.col("action") == "updated", F.raise_error(F.lit("a known row differs and overwriting is off"))).otherwise(F.col("action")))
    fresh = new.join(actions.filter(F.col("action").isin("added", "updated")).select(key), key, "left_semi")
    return old.join(actions.filter(F.col("action").isin("unchanged", "kept")).select(key), key, "left_semi").unionByName(fresh.select(*old.columns))


def update_plan(index: DataFrame, known: DataFrame, key: str, date: str, since: Column, until: Column, meta: list[str], document: str, known_outside: bool = False) -> DataFrame:
    """``key, action`` for rows in the half-open window, and with ``known_outside`` for known rows whose metadata changed.

    New: add_candidate; changed metadata: review_metadata_revision; changed document: review_document_revision;
    known without document hash: metadata_unchanged_source_unverified; else unchanged.
    """
    k = known.select(F.col(key).alias("k_key"), row_hash(*meta).alias("k_meta"), F.col(document).alias("k_document"))
    rows = index.select(key, since.alias("since"), until.alias("until"), F.col(date).alias("when"), row_hash(*meta).alias("meta"), F.col(document).alias("document")).join(k, F.col(key) == F.col("k_key"), "left")
    action = (
        F.when(F.col("k_key").isNull(), "add_candidate").when(F.col("meta") != F.col("k_meta"), "review_metadata_revision")
        .when(F.col("document").isNull() | F.col("k_document").isNull(), "metadata_unchanged_source_unverified").when(F.col("document") != F.col("k_document"), "review_document_revision").otherwise("unchanged")
    )
    rows = rows.withColumn("action", action).withColumn("inside", (F.col("when") >= F.col("since")) & (F.col("when") < F.col("until")))
    wanted = F.col("inside") | (F.lit(known_outside) & (F.col("action") == "review_metadata_revision"))
    return rows.filter(wanted).select(key, "action")


def pending(todo: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """What has no success in the log; partial and failed runs do not count as done."""
    return todo.join(log.filter("status = 'success'").select(key), key, "left_anti")


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def rolling_count(df: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """For each row the number of rows of its key in the window that ends with it."""
    window = Window.partitionBy(key).orderBy(F.unix_micros(F.col(time).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return df.withColumn("in_window", F.count("*").over(window))


def timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """With a watermark; times without a zone are read in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def stream_unique(events: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """A stream without repeats of a key within the watermark."""
    return timed(events, time, late).dropDuplicatesWithinWatermark([key])


def stream_windows(events: DataFrame, time: str, width: str, late: str, by: str) -> DataFrame:
    """Counts by event-time window and key; late rows are dropped after the watermark."""
    return timed(events, time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


def run_to_end(stream: DataFrame, spark: SparkSession, target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into Parquet, and return the result; starting it again resumes after what it has done."""
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.parquet(target)


def upsert_stream(stream: DataFrame, key: str, order: str, root: str, checkpoint: str) -> str:
    """Keep the latest row of each key in versioned folders under ``root``; a batch that is run again writes its own version anew.

    Returns the path of the last version.
    """
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/v={number - 1}")
        exists = number > 0 and path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        rows = batch.unionByName(spark.read.parquet(f"{root}/v={number - 1}")) if exists else batch
        latest(rows, key, [F.desc(order)]).write.mode("overwrite").parquet(f"{root}/v={number}")
        last.append(number)

    last: list[int] = []
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return f"{root}/v={last[-1]}" if last else root
