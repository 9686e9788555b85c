"""Joins that state what they rely on: keys that must be unique, rows that must have a partner, columns that must agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``df``, with an error when the plan runs if a key occurs twice or is null. One aggregation by the keys, which a join on them reuses."""
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest) if rest else F.lit(1)).alias("_row"))
    bad = F.col("_n") > 1
    for k in keys:
        bad = bad | F.col(k).isNull()
    message = F.concat(F.lit(f"{label}: key not unique at "), F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]))
    rows = rows.withColumn("_n", F.when(bad, F.raise_error(message).cast("long")).otherwise(F.col("_n"))).filter("_n = 1")
    return rows.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def key_violations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``rule, n, first_key``: keys that occur twice on a side, or on one side only, in one pass over both."""
    sides = left.select(F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(F.col(key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    counts = sides.groupBy("k").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    rules = {"left_duplicate": F.col("l") > 1, "right_duplicate": F.col("r") > 1, "left_only": F.col("r") == 0, "right_only": F.col("l") == 0}
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return counts.select("k", F.explode(found).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"), F.min("k").alias("first_key"))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides joined on a key that is unique on each; columns of ``right`` beside it must have names of their own."""
    clash = [c for c in right.columns if c != key and c in left.columns]
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    return unique(left, [key], "left").join(unique(right, [key], "right"), key)


def with_texts(labels: DataFrame, cases: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Every row of ``labels``, with its case and text where there are any, and ``problem``: ``no_case``, ``no_text`` or none."""
    c = unique(cases, [key], "cases").withColumn("_case", F.lit(True))
    t = unique(texts.select(key, text), [key], "texts")
    rows = labels.join(c, key, "left").join(t, key, "left")
    empty = F.coalesce(F.trim(text), F.lit("")) == ""
    return rows.withColumn("problem", F.when(F.col("_case").isNull(), "no_case").when(empty, "no_text")).drop("_case")


def target_differences(supplied: DataFrame, canonical: DataFrame, key: str, value: str, split: str, require_all: bool = True) -> DataFrame:
    """``key, problem``: supplied ids that are not canonical, canonical ones not supplied, and values or splits that differ."""
    a = supplied.select(F.col(key).alias("a"), F.col(value).alias("av"), F.col(split).alias("asp"))
    b = canonical.select(F.col(key).alias("b"), F.col(value).alias("bv"), F.col(split).alias("bsp"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    rules = {"unknown_id": F.col("b").isNull(), "missing_id": F.col("a").isNull() & F.lit(require_all), "value_differs": both & ~F.col("av").eqNullSafe(F.col("bv")), "split_differs": both & ~F.col("asp").eqNullSafe(F.col("bsp"))}
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("key"), F.explode(found).alias("problem"))


def star(base: DataFrame, dimensions: list[tuple[DataFrame, list[str], str]]) -> DataFrame:
    """``base`` with each dimension (table, keys, prefix) joined on the left; keys must be unique there. Rows of ``base`` stay as many."""
    for df, keys, prefix in dimensions:
        rest = [c for c in df.columns if c not in keys]
        base = base.join(unique(df, keys, prefix).select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in rest], F.lit(True).alias(f"has_{prefix}")), keys, "left")
        base = base.withColumn(f"has_{prefix}", F.coalesce(f"has_{prefix}", F.lit(False)))
    return base


def merged_metadata(first: DataFrame, second: DataFrame, key: str, columns: list[str], policy: str = "error") -> DataFrame:
    """Both tables' rows column by column: what only one side knows is taken, and ``conflicts`` lists columns in which they differ.

    Conflicts take the ``first`` or the ``second`` side, or (``error``) stop the plan when it runs. Empty texts count as unknown.
    """
    if policy not in ("error", "first", "second"):
        raise ValueError("policy is error, first or second")
    known = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    a = first.select(F.col(key).alias("_a"), *[known(F.col(c)).alias(f"a_{c}") for c in columns])
    b = second.select(F.col(key).alias("_b"), *[known(F.col(c)).alias(f"b_{c}") for c in columns])
    differ = lambda c: F.col(f"a_{c}") != F.col(f"b_{c}")
    conflicts = F.array_compact(F.array(*[F.when(differ(c), F.lit(c)) for c in columns]))
    if policy == "error":
        conflicts = F.when(F.size(conflicts) > 0, F.raise_error(F.concat(F.lit("metadata differs: "), F.array_join(conflicts, ","))).cast("array<string>")).otherwise(conflicts)
    sides = ("b_", "a_") if policy == "second" else ("a_", "b_")
    pick = [F.coalesce(*[F.col(s + c) for s in sides]).alias(c) for c in columns]
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), *pick, conflicts.alias("conflicts"))


def same_multisets(first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, same``: whether both tables hold the same rows of ``columns`` for the key, in any order and as often.

    Rows are counted, not collected: a key's rows differ if one of its distinct rows has different counts.
    """
    rows = first.select(key, *columns, F.lit(1).alias("_d")).unionByName(second.select(key, *columns, F.lit(-1).alias("_d")))
    return rows.groupBy(key, *columns).agg(F.sum("_d").alias("_d")).groupBy(key).agg((F.max(F.abs("_d")) == 0).alias("same"))


def first_known(*candidates: Column) -> Column:
    """The first of several columns that is not null and not an empty list or text."""
    return F.coalesce(*[F.when(F.length(F.array_join(c, ""))  > 0, c) for c in candidates])
