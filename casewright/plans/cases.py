"""The case view: orders as cases, their line items as applicants, part brands as article codes.

Amounts are integers of a ten-thousandth until they are divided once, so sums do not depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_UNTIL, VALIDATION_UNTIL, OOD_FROM = "1999-07-01", "2000-01-01", "2000-10-01"

#: The same relation in SQL: common table expressions to put in front of a query.
CASES_SQL = f"""
    amounts AS (
        SELECT l_orderkey AS case_id, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, CAST(round(l_quantity) AS BIGINT) AS quantity,
               CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS amount4
        FROM lineitem),
    totals AS (
        SELECT case_id, count(*) AS n_applicants, sum(CASE WHEN l_returnflag = 'R' THEN amount4 ELSE 0 END) AS y4,
               count(DISTINCT l_suppkey) AS n_applications
        FROM amounts GROUP BY case_id),
    articles AS (
        SELECT DISTINCT case_id, p_brand AS article FROM amounts JOIN part ON l_partkey = p_partkey),
    article_counts AS (SELECT case_id, count(*) AS n_articles FROM articles GROUP BY case_id),
    cases AS (
        SELECT o_orderkey AS case_id, CAST(o_orderdate AS DATE) AS judgment_date, n_name AS country, r_name AS region,
               o_orderpriority AS importance, o_orderstatus AS formation, o_orderpriority = '1-URGENT' AS is_grand, c_acctbal AS acctbal,
               coalesce(n_applicants, 0) AS n_applicants, coalesce(n_applications, 0) AS n_applications, coalesce(n_articles, 0) AS n_articles,
               CAST(coalesce(y4, 0) AS DOUBLE) / 10000 AS y,
               CASE WHEN CAST(o_orderdate AS DATE) < DATE '{TRAIN_UNTIL}' THEN 'train'
                    WHEN CAST(o_orderdate AS DATE) < DATE '{VALIDATION_UNTIL}' THEN 'validation' ELSE 'test' END AS split,
               CASE WHEN CAST(o_orderdate AS DATE) >= DATE '{OOD_FROM}' THEN 'OOD'
                    WHEN CAST(o_orderdate AS DATE) >= DATE '{VALIDATION_UNTIL}' THEN 'ID' END AS test_view
        FROM orders
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN totals ON totals.case_id = o_orderkey LEFT JOIN article_counts ON article_counts.case_id = o_orderkey)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as applicants, with the amount in ten-thousandths."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        F.round("l_quantity").cast("long").alias("quantity"), (cents("l_extendedprice") * (100 - cents("l_discount"))).alias("amount4"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, article``, distinct."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("article"))
    return amounts(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey")).select("case_id", "article").distinct()


def split_of(date: Column) -> Column:
    return F.when(date < F.lit(TRAIN_UNTIL).cast("date"), "train").when(date < F.lit(VALIDATION_UNTIL).cast("date"), "validation").otherwise("test")


def cases(spark: SparkSession, sf_dir: str, among: DataFrame | None = None) -> DataFrame:
    """One row per case; ``articles`` is a sorted array, null where the case has no line items. ``among``: ids (``case_id``) beyond which no case is wanted."""
    only = (lambda df: df) if among is None else (lambda df: df.join(among.select("case_id").hint("shuffle_hash"), "case_id", "left_semi"))
    # one pass over the line items; a case's own items, suppliers and articles are few
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("article"))
    totals = only(amounts(spark, sf_dir)).join(part, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("case_id").agg(
        F.count("*").alias("n_applicants"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("amount4")).otherwise(0)).alias("y4"), F.size(F.collect_set("l_suppkey")).alias("n_applications"),
        F.array_sort(F.collect_set("article")).alias("articles"),
    ).withColumn("articles", F.when(F.size("articles") > 0, F.col("articles")))
    # nations and regions are dimensions of fixed size
    place = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey"))
    date = F.col("o_orderdate").cast("date")
    view = F.when(date >= F.lit(OOD_FROM).cast("date"), "OOD").when(date >= F.lit(VALIDATION_UNTIL).cast("date"), "ID")
    rows = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("case_id"), date.alias("judgment_date"), F.col("n_name").alias("country"), F.col("r_name").alias("region"),
        F.col("o_orderpriority").alias("importance"), F.col("o_orderstatus").alias("formation"), (F.col("o_orderpriority") == "1-URGENT").alias("is_grand"),
        F.col("c_acctbal").alias("acctbal"), split_of(date).alias("split"), view.alias("test_view"),
    )
    rows = only(rows).join(totals, "case_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select(
        "case_id", "judgment_date", "country", "region", "importance", "formation", "is_grand", "acctbal", zero("n_applicants"), zero("n_applications"),
        F.coalesce(F.size("articles"), F.lit(0)).cast("long").alias("n_articles"), "articles", (F.coalesce("y4", F.lit(0)).cast("double") / 10000).alias("y"), "split", "test_view",
    )
