"""Awards by head: sums, claims against awards, cross-checks, and who a beneficiary label means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions.normalize import ordinal_index

HEADS = ("non_pecuniary", "pecuniary", "costs")


def sums_by_head(rows: DataFrame, key: str, head: str = "head", amount: str = "amount") -> DataFrame:
    """A column for each head, null without rows, and the total of those present."""
    each = [F.sum(F.when(F.col(head) == h, F.col(amount))).alias(h) for h in HEADS]
    return rows.groupBy(key).agg(*each).withColumn("total", _present_sum([F.col(h) for h in HEADS]))


def _present_sum(parts: list[Column]) -> Column:
    some = F.coalesce(*parts).isNotNull()
    return F.when(some, sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)))


def resolved(value: Column, per_applicant: Column) -> Column:
    """An award as stated, else as the sum over applicants."""
    return F.coalesce(value, per_applicant)


def single_currency_total(rows: DataFrame, key: str, amount: str, currency: str) -> DataFrame:
    """The original total only if all amounts are known and in one currency."""
    ok = (F.countDistinct(currency) == 1) & F.bool_and(F.col(amount).isNotNull())
    return rows.groupBy(key).agg(F.when(ok, F.sum(amount)).alias("original_total"), F.when(ok, F.first(currency)).alias("currency"))


def claim_status(claimed: Column, awarded: Column, leave_to_court: Column, comparable: Column, tolerance: float) -> Column:
    """How an award stands to what was claimed."""
    return (
        F.when(awarded.isNull(), "no_award").when(claimed.isNull() & ~leave_to_court, F.when(awarded <= tolerance, "pass_no_claim_zero_award").otherwise("fail_no_claim_positive_award"))
        .when(leave_to_court, "pass_leave_to_court").when(~comparable, "review_explicit_amount_uncomparable")
        .when(awarded <= claimed + tolerance, "pass_award_leq_claim").otherwise("fail_award_exceeds_claim")
    )


def cross_check(a: Column, b: Column, tolerance: float, other_currency: Column | None = None) -> Column:
    """Two extractions of one amount."""
    out = F.when(a.isNull() & b.isNull(), "both_missing")
    if other_currency is not None:
        out = out.when(a.isNull() & other_currency, "llm_only_non_eur")
    return out.when(a.isNull(), "validator_missing").when(b.isNull(), "llm_missing").when(F.abs(a - b) <= tolerance, "match").otherwise("mismatch")


def joint_rows(rows: DataFrame, key: str, head: str, amount: str, index: str) -> DataFrame:
    """Equal amounts to all applicants of a case become one joint row."""
    sizes = rows.groupBy(key).agg(F.countDistinct(index).alias("_all"))
    same = rows.groupBy(key, head, amount).agg(F.countDistinct(index).alias("n"), F.min(index).alias("first"))
    return same.join(sizes, key).withColumn("joint", (F.col("n") == F.col("_all")) & (F.col("n") > 1)).drop("_all")


def resolve_beneficiaries(labels: DataFrame, people: DataFrame, key: str, given: str | None = None) -> DataFrame:
    """``labels`` (key, label) with the applicant's index: the ``given`` one, else an ordinal in the label, else the full name, else a surname that only one has.

    ``people``: key, index, name. Surnames that several share resolve nobody.
    """
    low = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    names = people.select(key, F.col("index").alias("_by_name"), low(F.col("name")).alias("_name")).dropDuplicates([key, "_name"])
    surname = F.element_at(F.split(low(F.col("name")), " "), -1)
    surnames = people.withColumn("_surname", surname).groupBy(key, "_surname").agg(F.countDistinct("index").alias("_n"), F.min("index").alias("_by_surname")).filter("_n = 1").drop("_n")
    rows = labels.withColumn("_name", low(F.col("label"))).withColumn("_surname", F.element_at(F.split(F.col("_name"), " "), -1))
    out = rows.join(names, [key, "_name"], "left").join(surnames, [key, "_surname"], "left")
    number, stated = ordinal_index(F.col("label")), F.col(given) if given else F.lit(None).cast("int")
    how = F.when(stated.isNotNull(), "index").when(number.isNotNull(), "ordinal").when(F.col("_by_name").isNotNull(), "name").when(F.col("_by_surname").isNotNull(), "surname").otherwise("unresolved")
    return out.withColumn("how", how).withColumn("index", F.coalesce(stated, number, F.col("_by_name"), F.col("_by_surname")).cast("int")).drop("_name", "_surname", "_by_name", "_by_surname")


def padded(counts: DataFrame, key: str, n: str, overlay: DataFrame, index: str, columns: list[str]) -> DataFrame:
    """A row for each of a case's ``n`` places, with the overlay's values where there are some."""
    base = counts.select(key, F.explode(F.sequence(F.lit(1), F.greatest(F.col(n), F.lit(1)).cast("int"))).alias(index))
    return base.join(overlay.select(key, index, *columns), [key, index], "left")
