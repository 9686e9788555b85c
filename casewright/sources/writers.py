"""Sinks: tables and JSON without undefined numbers, nested cells, fan-out, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(df: DataFrame) -> DataFrame:
    """Not-a-number and infinite values are errors when the plan runs."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            c = F.when(bad, F.raise_error(F.lit(f"{f.name} is not finite")).cast(f.dataType)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def flat_cells(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    nested = T.ArrayType | T.MapType | T.StructType
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str) -> None:
    flat_cells(df).write.mode("errorifexists").csv(path, header=True, escape='"')


def write_jsonl(df: DataFrame, path: str) -> None:
    finite(df).write.mode("errorifexists").json(path, ignoreNullFields=False)


def write_by_split(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("errorifexists").partitionBy(split).json(path)


def write_layers(df: DataFrame, path: str, status: str, group: str) -> None:
    """Complete results by group; all others to ``quarantine``."""
    done = F.col(status) == "complete"
    df.filter(done).write.partitionBy(group).json(f"{path}/cases")
    df.filter(~F.coalesce(done, F.lit(False))).write.partitionBy(group).json(f"{path}/quarantine")


def append_problems(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upserted(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Existing rows at their places, replaced where they come anew, then the others of ``new``; a repeated key on either side is an error when the plan runs.

    ``order`` is a column of numbers that both sides have; places of added rows follow the existing ones'.
    """
    from casewright.operators.joins import unique

    last = existing.agg(F.coalesce(F.max(order), F.lit(-1)).alias("_last"))
    old = unique(existing, [key], "existing").select(F.col(key).alias("_key"), F.col(order).alias("_place"), F.struct(*existing.columns).alias("_old"))
    fresh = unique(new, [key], "new").select(F.col(key).alias("_fresh"), F.col(order).alias("_turn"), F.struct(*existing.columns).alias("_new"))
    rows = old.join(fresh, F.col("_key") == F.col("_fresh"), "full_outer").crossJoin(F.broadcast(last))  # one row
    place = F.coalesce("_place", F.col("_last") + 1 + F.col("_turn"))
    row = F.coalesce("_new", "_old")
    return rows.select(*[place.cast(existing.schema[c].dataType).alias(c) if c == order else row[c].alias(c) for c in existing.columns])


def write_file(spark: SparkSession, path: str, content: str) -> None:
    """One small file, replaced at once: written beside its place, then renamed over it, on whatever file system it is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    system = place.getFileSystem(conf)
    out = system.create(part, True)
    try:
        out.write(bytearray(content.encode()))
        out.hsync()
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf)
    modes = spark.sparkContext._gateway.new_array(rename, 1)
    modes[0] = rename.OVERWRITE
    context.rename(context.makeQualified(part), context.makeQualified(place), modes)


def predictions(df: DataFrame, key: str, truth: str, guess: str, threshold: float = 0.5) -> DataFrame:
    """Prediction rows as they are published: id, split, target, prediction, and both as positive or not."""
    flag = lambda c: (F.col(c) > threshold).cast("int")
    return df.select("split", F.col(key).cast("string").alias("itemid"), F.col(truth).alias("target_award_eur"), F.col(guess).alias("predicted_award_eur"), flag(truth).alias("target_positive"), flag(guess).alias("predicted_positive"))


def write_distribution(df: DataFrame, path: str, keys: list[str]) -> None:
    """A prior table as one CSV file sorted by its keys; such tables have a row for each bucket."""
    flat_cells(df).orderBy(*keys).coalesce(1).write.mode("errorifexists").csv(path, header=True, escape='"', nullValue="", emptyValue="")


def summary(counts: DataFrame, title: str, limit: int = 200) -> str:
    """A Markdown table of a summary's rows, ``limit`` of them at most."""
    rows = counts.limit(limit).collect()
    lines = [f"# {title}", "", "| " + " | ".join(counts.columns) + " |", "|" + "-|" * len(counts.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows)]) + "\n"


def planned_copies(files: DataFrame, manifest: DataFrame, allowed: tuple[str, ...], blocked: tuple[str, ...] = ()) -> DataFrame:
    """``path, reason``: which files of a release go into a bundle; others with the reason (not listed, digest, kind, blocked)."""
    from casewright.operators.contract import inventory

    bad = inventory(files, manifest).select("path", F.col("problem").alias("reason"))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rest = files.select("path").join(bad, "path", "left_anti")
    reason = F.when(~suffix.isin(*allowed), "kind")
    for b in blocked:
        reason = reason.when(F.contains("path", F.lit(b)), "blocked")
    return rest.select("path", reason.alias("reason")).unionByName(bad)


def write_traces(traces: DataFrame, answers: DataFrame, path: str, key: str) -> None:
    """Traces and predictions of a run, each as JSON lines; a prediction without a trace, or a trace without one, stops the plan."""
    both = traces.select(key).distinct().withColumn("_t", F.lit(True)).join(answers.select(key).distinct().withColumn("_a", F.lit(True)), key, "full_outer")
    gap = both.filter("_t is null or _a is null").agg(F.count("*").alias("n"), F.min(F.col(key).cast("string")).alias("first")).head()
    if gap["n"]:
        raise ValueError(f"{gap['n']} cases have only a trace or only a prediction, first {gap['first']}")
    write_jsonl(traces, f"{path}/traces")
    write_jsonl(answers, f"{path}/predictions")
