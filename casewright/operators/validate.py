"""Rules as relations: violations are rows, and a contract holds if there are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key, rule`` for each row and rule whose condition is true; an unknown condition does not accuse."""
    found = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()]))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("rule"))


def duplicates(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """A violation for each key that occurs more than once."""
    return df.groupBy(*keys).count().filter("count > 1").select(F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"), F.lit(rule).alias("rule"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, rule: str) -> DataFrame:
    missing = child.select(F.col(child_key).alias("_k")).distinct().join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti")
    return missing.select(F.col("_k").cast("string").alias("key"), F.lit(rule).alias("rule"))


def id_difference(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``side, n, first_id``: ids only on one side, in one pass of a full join."""
    a = left.select(F.col(left_key).alias("a")).distinct()
    b = right.select(F.col(right_key).alias("b")).distinct()
    side = F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").otherwise("both")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"), F.min(F.coalesce("a", "b")).alias("first_id"))


def assert_none(found: DataFrame, what: str) -> None:
    """Raise with some examples if a violation exists."""
    some = found.limit(5).collect()
    if some:
        raise ValueError(f"{what}: " + "; ".join(f"{r['rule']} at {r['key']}" for r in some))


def assert_columns(df: DataFrame, required: list[str], forbidden: tuple[str, ...] = ()) -> None:
    """At plan time: all required columns are there and no name contains a forbidden fragment."""
    missing = [c for c in required if c not in df.columns]
    blocked = [c for c in df.columns if any(f in c.lower() for f in forbidden)]
    if missing or blocked:
        raise ValueError(f"missing columns {missing}, forbidden columns {blocked}")


def collapse(df: DataFrame, source: str) -> DataFrame:
    """Equal rows (but for ``source``) once, with their number and sorted sources, keyed by a hash of the canonical row."""
    columns = sorted(c for c in df.columns if c != source)
    text = F.to_json(F.struct(*columns))
    return df.withColumn("row_hash", F.sha2(text, 256)).groupBy("row_hash", *columns).agg(F.count("*").alias("copies"), F.array_join(F.array_sort(F.collect_set(source)), ";").alias("sources"))


def promote(candidates: DataFrame, allocations: DataFrame, key: str, target: str, amount: str) -> DataFrame:
    """Reviewed candidates: which are promoted and why the others are not.

    ``candidates``: key, target, coverage (complete, partial, none_found, unknown) and status. Allocations
    beyond the target block a case, complete coverage asks for equality, and allocations without coverage
    are refused.
    """
    sums = allocations.groupBy(key).agg(F.sum(amount).alias("allocated"), F.count("*").alias("n_allocations"))
    rows = candidates.join(sums, key, "left").withColumn("allocated", F.coalesce("allocated", F.lit(0))).withColumn("n_allocations", F.coalesce("n_allocations", F.lit(0)).cast("long"))
    reasons = F.array_compact(F.array(
        F.when(F.col("status") != "reviewed", F.lit("not_reviewed")), F.when(F.col("allocated") > F.col(target), F.lit("allocations_exceed_target")),
        F.when((F.col("coverage") == "complete") & (F.col("allocated") != F.col(target)), F.lit("complete_coverage_differs")),
        F.when(F.col("coverage").isin("none_found", "unknown") & (F.col("n_allocations") > 0), F.lit("allocations_without_coverage")),
    ))
    return rows.withColumn("reasons", F.array_join(reasons, ";")).withColumn("promoted", F.size(reasons) == 0)
