"""Harvests in pages: fingerprints, continuity, a second pass, recovery from a journal, backfills and problem logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.streaming.ingest import row_hash


def pages(rows: DataFrame, page: str, key: str, columns: list[str]) -> DataFrame:
    """``page, n, first_id, last_id, fingerprint``: a page's rows, in the order of their keys, as one digest. Pages are of bounded size."""
    hashed = rows.select(page, F.col(key).alias("_k"), row_hash(key, *columns).alias("_h"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_h"))), lambda x: x["_h"]), "")
    return hashed.groupBy(page).agg(F.count("*").alias("n"), F.min("_k").alias("first_id"), F.max("_k").alias("last_id"), F.sha2(ordered, 256).alias("fingerprint"))


def continuity(found: DataFrame, page: str = "page") -> DataFrame:
    """Adds ``start`` (rows on the pages before), ``continuous`` (it is where the page should start) and ``ordered`` (ids go on ascending).

    The window goes over pages, a small table beside the rows.
    """
    order = Window.orderBy(page)
    out = found.withColumn("start", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    out = out.withColumn("_before", F.lag("last_id").over(order))
    return out.withColumn("continuous", F.col("start") == F.col("expected_start")).withColumn("ordered", F.coalesce(F.col("first_id") > F.col("_before"), F.lit(True))).drop("_before")


def verified(first: DataFrame, second: DataFrame, page: str = "page") -> DataFrame:
    """``page, verified``: whether a second traversal gave the same page; a page that only one of them has is not."""
    b = second.select(F.col(page).alias("_p"), F.col("fingerprint").alias("_f"))
    both = first.join(b, first[page] == F.col("_p"), "full_outer")
    return both.select(F.coalesce(first[page], F.col("_p")).alias(page), F.coalesce(F.col("fingerprint") == F.col("_f"), F.lit(False)).alias("verified"))


def recovery(rows: DataFrame, journal: DataFrame, batch: str) -> DataFrame:
    """``rows`` with ``action``: those of committed batches stay, prepared ones are rolled forward, others are discarded."""
    states = journal.groupBy(F.col(batch).alias("_b")).agg(F.bool_or(F.col("state") == "committed").alias("_done"))
    out = rows.join(states, rows[batch] == F.col("_b"), "left")
    return out.withColumn("action", F.when(F.col("_b").isNull(), "discard").when(F.col("_done"), "keep").otherwise("roll_forward")).drop("_b", "_done")


def change(old: Column, new: Column) -> Column:
    """What a backfill did to a value; blank counts as empty."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(blank(old) & blank(new), "empty").when(blank(new), "became_empty").when(blank(old), "became_non_empty").when(old == new, "unchanged").otherwise("changed")


def problems(lines: DataFrame, line: str) -> DataFrame:
    """``itemid, records``: the problem records of each item by time, then number; lines that are not JSON objects are skipped."""
    record = F.from_json(line, "itemid string, ts long, no long, problem string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    whole = F.col(line).rlike(r"^\s*\{.*\}\s*$")
    rows = lines.filter(whole).select(record.alias("r")).filter("r.itemid is not null").select("r.*")
    return rows.groupBy("itemid").agg(F.array_sort(F.collect_list(F.struct("ts", "no", "problem"))).alias("records"))


def checkpointed(known: DataFrame, page: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, state`` of a new page's rows against what was harvested: ``new``, ``duplicate`` (same content) or ``conflict``."""
    a = known.select(F.col(key).alias("_a"), row_hash(*columns).alias("_ha"))
    b = page.select(F.col(key), row_hash(*columns).alias("_hb"))
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_ha") == F.col("_hb"), "duplicate").otherwise("conflict")
    return b.join(a, F.col(key) == F.col("_a"), "left").select(key, state.alias("state"))
