"""Pins, fingerprints and contracts of released tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digest(*columns: str | Column) -> Column:
    """SHA-256 of the columns as text, separated by a unit separator; null as the empty text."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def set_digest(df: DataFrame, columns: list[str | Column], digits: int = 2, name: str = "digest") -> DataFrame:
    """One row, ``n`` and a digest of the table that does not depend on the rows' order.

    Row digests are sorted and digested within ranges given by their first ``digits`` hexadecimal digits, then the ranges'
    digests: no task holds more than one range. More digits suit larger tables.
    """
    rows = df.select(row_digest(*columns).alias("h"))
    part = rows.groupBy(F.substring("h", 1, digits).alias("p")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: F.concat(x["p"], x["d"])), "")
    return part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(whole, 256).alias(name))


def cohort_pin(cases: DataFrame, key: str, metadata: list[str | Column], target: str, source: str | Column) -> DataFrame:
    """``field, n, digest``: four digests of a training cohort, of its ids, metadata, targets and label sources."""
    out = None
    for field, columns in (("ids", [key]), ("metadata", [key, *metadata]), ("targets", [key, target]), ("provenance", [key, source])):
        one = set_digest(cases, columns).select(F.lit(field).alias("field"), "n", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def pin_differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """``field, same`` for every field of either pin."""
    a = expected.select("field", F.struct("n", "digest").alias("a"))
    b = found.select("field", F.struct("n", "digest").alias("b"))
    return a.join(b, "field", "full_outer").select("field", F.col("a").eqNullSafe(F.col("b")).alias("same"))


def reconciled(counts: DataFrame, sums: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """``rule, total, parts, ok``: whether each total is the sum of its parts, from ``name, n``."""
    n = lambda name: F.coalesce(F.max(F.when(F.col("name") == name, F.col("n"))), F.lit(0))
    rules = [F.struct(F.lit(rule).alias("rule"), n(total).cast("long").alias("total"), sum((n(p) for p in parts), F.lit(0)).cast("long").alias("parts")) for rule, (total, parts) in sums.items()]
    return counts.agg(F.array(*rules).alias("r")).select(F.inline("r")).withColumn("ok", F.col("total") == F.col("parts"))


def alignment(features: DataFrame, targets: DataFrame, key: str, order: str, value: str, binary: str) -> DataFrame:
    """``rule, n``: features and targets of a split that do not line up.

    Ids on one side, places that differ, targets that are negative or not finite, and binary labels that contradict them.
    """
    a = features.select(F.col(key).alias("a"), F.col(order).alias("oa"))
    b = targets.select(F.col(key).alias("b"), F.col(order).alias("ob"), F.col(value).cast("double").alias("v"), F.col(binary).alias("y"))
    sound = F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") >= 0) & (F.col("v") != float("inf"))
    rules = {
        "feature_without_target": F.col("b").isNull(), "target_without_feature": F.col("a").isNull(), "order": F.col("oa") != F.col("ob"),
        "target_not_sound": F.col("b").isNotNull() & ~sound, "binary": sound & (F.col("y") != (F.col("v") > 0).cast("int")),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.explode(found).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def inventory(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, problem``: files not listed, listed but not there, or with another digest; both tables are ``path, sha256``."""
    a = files.select(F.col("path").alias("a"), F.col("sha256").alias("found"))
    b = manifest.select(F.col("path").alias("b"), F.col("sha256").alias("listed"))
    problem = F.when(F.col("b").isNull(), "not_listed").when(F.col("a").isNull(), "not_there").when(F.col("found") != F.col("listed"), "digest_differs")
    unsafe = F.col("b").rlike(r"^/|(^|/)\.\.(/|$)|^$")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("path"), F.when(unsafe, "unsafe_path").otherwise(problem).alias("problem")).filter("problem is not null")


#: Fixed values of the label sources.
SOURCES = ("zero_reason", "amount_direct", "proxy_keep72")


def provenance(source: Column, missing: str = "available_from_supplied_y_source") -> tuple[Column, list[Column]]:
    """An aggregate: whether every row of a bucket names a known source; and counts by source, null unless all do."""
    known = F.coalesce(source, F.lit("")) != ""
    without = F.lit(missing if missing != "available_from_supplied_y_source" else "unavailable_missing_y_source")
    status = F.when(F.count("*") == 0, "unavailable_no_labeled_rows").when(~F.bool_and(known), without).when(~F.bool_and(source.isin(*SOURCES)), "unavailable_unrecognized_y_source_values").otherwise("available_from_supplied_y_source")
    counts = [F.when(status == "available_from_supplied_y_source", F.count_if(source == s)).alias(f"{s}_count") for s in SOURCES]
    return status, counts


def clean_distribution(rows: DataFrame, keys: list[str], numbers: list[str], count: str, order: str) -> DataFrame:
    """A stored distribution table as it is used: keys trimmed and in capitals, incomplete rows and empty buckets dropped, the last of a key."""
    out = rows.select(*[F.upper(F.trim(F.col(k).cast("string"))).alias(k) for k in keys], F.coalesce(F.col(count).try_cast("long"), F.lit(0)).alias(count), *[F.col(c).try_cast("double").alias(c) for c in numbers], order)
    use = F.col(count) > 0
    for c in numbers:
        use = use & F.col(c).isNotNull()
    for k in keys:
        use = use & (F.coalesce(k, F.lit("")) != "")
    return out.filter(use).groupBy(*keys).agg(F.max_by(F.struct(count, *numbers), order).alias("_r")).select(*keys, "_r.*")




def review_problems(reviews: DataFrame, cohort: DataFrame, checks: tuple[str, ...], rationales: tuple[str, ...], key: str = "case_id") -> DataFrame:
    """``key, problem`` of reviewed records that may not be exported.

    ``reviews``: key, split, amount, status, adjudicator, source_anchor, record_sha256, expected_sha256, checks (map of name
    to status), zero_rationale, target_status, correction_rationale; ``cohort``: key, split, amount.
    """
    own = cohort.select(F.col(key).alias("_k"), F.col("split").alias("_split"), F.col("amount").alias("_amount"))
    rows = reviews.join(own, F.col(key) == F.col("_k"), "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    passed = F.forall(F.array(*[F.lit(c) for c in checks]), lambda c: F.coalesce(F.element_at("checks", c).isin("pass", "not_applicable"), F.lit(False)))
    changed = F.col("amount") != F.col("_amount")
    rules = {
        "outside_cohort": F.col("_k").isNull(), "split_changed": F.col("split") != F.col("_split"), "not_accepted": F.coalesce(F.col("status") != "accepted", F.lit(True)) | blank("adjudicator") | blank("source_anchor"),
        "not_bound": ~F.col("record_sha256").eqNullSafe(F.col("expected_sha256")), "checks": ~passed | (F.size("checks") != len(checks)), "zero_without_rationale": (F.col("amount") == 0) & ~F.coalesce(F.col("zero_rationale").isin(*rationales), F.lit(False)),
        "change_without_rationale": changed & (F.coalesce(F.col("target_status") != "corrected_amount", F.lit(True)) | blank("correction_rationale")),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    repeated = reviews.groupBy(key).count().filter("count > 1").select(key, F.lit("repeated").alias("problem"))
    return rows.select(key, F.explode(found).alias("problem")).unionByName(repeated)


def archive_differences(archive: bytes, files: dict[str, bytes]) -> list[str]:
    """Members of a ZIP archive that differ from the given files, lack or add one, or have unsafe names."""
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        names = [n for n in z.namelist() if not n.endswith("/")]
        unsafe = [n for n in names if n.startswith("/") or ".." in n.split("/")]
        changed = [n for n in names if n in files and z.read(n) != files[n]]
    return sorted({*unsafe, *changed, *(set(names) ^ set(files)), *(n for n in names if names.count(n) > 1)})


def smoke(checks: dict[str, DataFrame]) -> DataFrame:
    """``check, problems, ok`` of a suite: each check is a relation of problems and passes if it is empty."""
    out = None
    for name, found in checks.items():
        one = found.agg(F.count("*").alias("problems")).select(F.lit(name).alias("check"), "problems", (F.col("problems") == 0).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out
