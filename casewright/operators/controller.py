"""State, evidence and gates of a controller that answers case by case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame, key: str) -> DataFrame:
    """``key, path, value``: scalar leaves of all columns as text, structs by dotted path; walks the schema, not the data."""
    leaves: list[tuple[str, Column]] = []

    def walk(prefix: str, column: Column, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind:
                walk(f"{prefix}.{f.name}", column.getField(f.name), f.dataType)
        else:
            leaves.append((prefix, F.to_json(column) if isinstance(kind, T.ArrayType | T.MapType) else column.cast("string")))

    for f in df.schema:
        if f.name != key:
            walk(f.name, F.col(f"`{f.name}`"), f.dataType)
    pairs = F.array(*[F.struct(F.lit(p).alias("path"), c.alias("value")) for p, c in leaves])
    return df.select(key, F.inline(pairs)).filter("value is not null and value != ''")


def within_budget(rows: DataFrame, by: list[str], order: list[str], text: str, most: int) -> DataFrame:
    """Texts in order up to a number of characters in all; the one at the limit is cut."""
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("_before", before).filter(F.col("_before") < most)
    return out.withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(most) - F.col("_before")).cast("int"))).drop("_before")


def blocked_columns(df: DataFrame, fragments: tuple[str, ...]) -> list[str]:
    """Columns whose name contains a fragment."""
    return [c for c in df.columns if any(f in c.lower() for f in fragments)]


def leakage(flat: DataFrame, fragments: tuple[str, ...], pattern: str) -> DataFrame:
    """Paths that should not be visible, with the reason: their name or their value."""
    named = F.col("path").rlike("(?i)" + "|".join(fragments))
    reason = F.when(named, "forbidden_name").when(F.col("value").rlike(pattern), "forbidden_value")
    return flat.withColumn("reason", reason).filter("reason is not null").drop("value")


def missing_actions(trace: DataFrame, key: str, action: str, required: tuple[str, ...]) -> DataFrame:
    """Required actions, in their order, that a trace lacks."""
    done = trace.groupBy(key).agg(F.collect_set(action).alias("_done"))
    return done.select(key, F.array_except(F.array(*[F.lit(r) for r in required]), "_done").alias("missing"))


def recommendation(zero: Column, positive: Column, stated: Column) -> Column:
    """From the numbers of indicators for and against a zero outcome, and whether a reason for zero is stated."""
    return (
        F.when(stated, "zero_plausible").when((zero > 0) & (positive > 0), "ambiguous").when(zero > 0, "zero_plausible")
        .when(positive > 0, "positive_plausible").otherwise("insufficient_evidence")
    )


def gated(prediction: Column, leak: Column, cap: Column, capped: Column) -> tuple[Column, Column]:
    """Status and value of a final prediction: refused with a leak, undefined or negative; capped by the claim where that applies."""
    bad = prediction.isNull() | F.isnan(prediction) | (prediction < 0) | (F.abs(prediction) == float("inf"))
    status = F.when(leak, "leakage").when(bad, "invalid").otherwise("accepted")
    return status, F.when(~leak & ~bad, F.when(capped & cap.isNotNull(), F.least(prediction, cap)).otherwise(prediction))


def route(members: DataFrame, key: str, member: str, modules: DataFrame, generic: str) -> DataFrame:
    """Distinct modules of a case by its members; members without one go to the generic module."""
    return members.join(modules, member, "left").select(key, F.coalesce("module", F.lit(generic)).alias("module")).distinct()


def segments(rows: DataFrame, by: list[str], order: str, starts: Column, name: str = "segment") -> DataFrame:
    """A running number that grows at each row that starts a segment."""
    return rows.withColumn(name, F.sum(starts.cast("long")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def with_neighbours(rows: DataFrame, by: list[str], order: str, hit: Column) -> DataFrame:
    """Rows that hit, and the rows next to them."""
    near = F.max(F.coalesce(hit, F.lit(False))).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-1, 1))
    return rows.withColumn("_near", near).filter("_near").drop("_near")
