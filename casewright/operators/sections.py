"""Sections of documents: trees made flat, sections merged by canonical name, a profile of what a document has, and core rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import extract as E
from casewright.functions import normalize as N
from casewright.functions import text as X
from casewright.functions.normalize import strip

#: Fixed names of the canonical sections that a profile looks at.
NAMES = ("introduction", "procedure", "facts", "summary_intro", "assessment_summary", "relevant_law", "law", "article_41", "operative", "conclusion_misc")


def flattened(nodes: DataFrame, key: str, path: str = "path", content: str = "content") -> DataFrame:
    """``key, section, heading, text``: the text of each top-level node and all below it, depth first.

    ``path`` holds the places from the root down, so that sorting by it is a walk in depth. The text is aggregated
    for each top-level node, whose nodes are bounded by the document.
    """
    rows = nodes.select(key, F.col(path).alias("_p"), X.clean(F.coalesce(content, F.lit(""))).alias("_c"))
    parts = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("_p", "_c"))), lambda n: n["_c"] != ""), lambda n: n["_c"])
    out = rows.groupBy(key, F.element_at("_p", 1).alias("section")).agg(F.max(F.when(F.size("_p") == 1, F.col("_c"))).alias("heading"), parts.alias("_t"))
    return out.select(key, "section", "heading", X.clean(F.array_join("_t", "\n\n")).alias("text"))


def profiled(sections: DataFrame, key: str, name: Column | None = None) -> DataFrame:
    """One row a document from its sections (``key, section, heading, text``): merged texts by canonical name, and what they make of it.

    ``profile`` says what the document has (narrative, summary, law, conclusion or nothing known), ``facts_mode`` and
    ``reasoning_mode`` which texts stand for facts and for reasoning, ``compensation_method`` how that part was found.
    """
    rows = sections.withColumn("_name", X.heading_name(F.col("heading"), name)).filter(F.coalesce("text", F.lit("")) != "")
    merged = lambda n: X.clean(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_name") == n, F.struct("section", "text")))), lambda s: s["text"]), "\n\n"))
    out = rows.groupBy(key).agg(*[merged(n).alias(n) for n in NAMES], F.array_sort(F.collect_set("_name")).alias("names"))
    join = lambda *cs: X.clean(F.array_join(F.filter(F.array(*[F.col(c) for c in cs]), lambda t: t != ""), "\n\n"))
    found = E.compensation_part(F.col("law"))
    own = F.col("article_41") != ""
    out = out.withColumns({
        "compensation": F.when(own, F.col("article_41")).otherwise(found["text"]), "compensation_method": F.when(own, "section").otherwise(found["method"]),
        "_law": F.when(own, F.col("law")).otherwise(F.when(found["before"] != "", found["before"]).otherwise(F.col("law"))),
    })
    out = out.withColumns({"reasoning": join("relevant_law", "_law"), "_narrative": join("introduction", "procedure", "facts"), "_summary": join("summary_intro", "assessment_summary")})
    has = lambda *cs: F.greatest(*[F.col(c) != "" for c in cs], F.lit(False))
    profile = F.when(has("_narrative"), "narrative_rich").when(has("_summary"), "summary_mode").when(has("reasoning", "compensation"), "law_only").when(has("operative", "conclusion_misc"), "conclusion_only").otherwise("unknown")
    facts_mode = F.when(has("_narrative"), "narrative_sections").when(has("_summary"), "summary_intro_plus_assessment").when(has("reasoning", "compensation"), "law_fallback").otherwise("skip")
    reasoning_mode = F.when(has("reasoning"), "law_and_relevant_law").when(has("assessment_summary"), "assessment_summary_fallback").when(has("summary_intro"), "summary_intro_fallback").otherwise("empty")
    return out.withColumns({"profile": profile, "facts_mode": facts_mode, "reasoning_mode": reasoning_mode}).drop("_law", "_narrative", "_summary")


def core_rows(cases: DataFrame, key: str = "itemid") -> DataFrame:
    """The core row of a case's metadata, with the fields that are missing; what is not known stays null, never false.

    Columns read: docname, appno, doctypebranch, originatingbody_name, judgementdate, article, scl and representedby
    (lists), conclusion (array of type and article).
    """
    findings = F.filter("conclusion", lambda f: f["type"] == "violation")
    codes = F.array_distinct(F.transform(F.filter(findings, lambda f: F.coalesce(f["article"], F.lit("")) != ""), lambda f: f["article"]))
    codes_known = F.col("conclusion").isNotNull() & F.forall(findings, lambda f: F.coalesce(f["article"], F.lit("")) != "")
    numbers = N.application_numbers(F.coalesce("appno", F.lit("")))
    known = F.size(numbers) > 0
    body = E.decision_body(F.col("doctypebranch"), F.col("originatingbody_name"))
    grand = body == "Grand Chamber"
    several = F.when(known & codes_known, (F.size(numbers) > 1) & (F.size(codes) > 1))
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in ("article", "conclusion", "representedby", "scl")] + [F.when(~known, F.lit("application_numbers")), F.when(F.col("conclusion").isNotNull() & ~codes_known, F.lit("violated_article_codes"))]
    represented = F.exists("representedby", lambda x: ~F.upper(strip(x)).isin("", "N/A"))
    return cases.select(
        key, N.docname_applicant(F.col("docname")).alias("party_applicant"), N.docname_respondent(F.col("docname")).alias("party_respondent"), N.any_year(F.col("judgementdate")).alias("judgment_year"), body.alias("decision_body"), grand.alias("is_grand_chamber"),
        F.when(codes_known, codes).alias("violated_articles"), F.size(findings).alias("num_violations_found"), several.alias("several_applications_and_articles"), (grand | several).alias("challenging"), represented.alias("represented"),
        F.when(known, F.size(numbers)).alias("num_application_numbers"), F.array_compact(F.array(*missing)).alias("missing_fields"),
    )


def useful(c: Column, least: int = 40) -> Column:
    """Whether a text says something: not blank, not only a heading of a section that was left out."""
    x = strip(c)
    return F.coalesce((F.length(x) >= least) & ~X.looks_like_heading(x) & ~F.lower(x).isin("n/a", "none", "null", "not available"), F.lit(False))


def first_useful(*candidates: Column, least: int = 40) -> Column:
    """The first text of several that says something."""
    return F.coalesce(*[F.when(useful(c, least), c) for c in candidates])


def reconciled(awards: DataFrame, counts: DataFrame, key: str, index: str = "index", kind: str = "kind", n: str = "n_applicants") -> DataFrame:
    """``key, status, n_applicants, n_beneficiaries``: whether awards reach as many applicants as there are.

    Rows to others than applicants (``kind`` external) do not count. ``unknown`` without a number of applicants or without
    rows to applicants; else ``pass``, ``over`` or ``under``.
    """
    own = awards.filter(F.col(kind) != "external").groupBy(key).agg(F.count_distinct(index).alias("n_beneficiaries"))
    rows = counts.select(key, F.col(n).alias("n_applicants")).join(own, key, "left")
    reached = F.coalesce("n_beneficiaries", F.lit(0))
    status = F.when(F.col("n_applicants").isNull() | (F.col("n_applicants") <= 0) | F.col("n_beneficiaries").isNull(), "unknown").when(reached == F.col("n_applicants"), "pass").when(reached > F.col("n_applicants"), "over").otherwise("under")
    return rows.select(key, status.alias("status"), "n_applicants", reached.cast("long").alias("n_beneficiaries"))


def staged(stages: DataFrame, key: str, order: tuple[str, ...], needs: dict[str, tuple[str, ...]]) -> DataFrame:
    """``key, overall, first_failed, ran``: a case's stages (``key, stage, status``) taken together.

    A stage whose needs did not succeed counts as skipped whatever is recorded. ``complete`` if all succeeded, ``failed``
    if none did, else ``partial``; a stage's last record counts where there are several (``attempt``).
    """
    last = stages.groupBy(key, "stage").agg(F.max_by("status", "attempt").alias("status"))
    wide = last.groupBy(key).agg(*[F.max(F.when(F.col("stage") == s, F.col("status"))).alias(s) for s in order])
    for s in order:
        ready = F.lit(True)
        for need in needs.get(s, ()):
            ready = ready & (F.coalesce(need, F.lit("")) == "success")
        wide = wide.withColumn(s, F.when(ready, F.coalesce(s, F.lit("missing"))).otherwise("skipped"))
    done = sum(((F.col(s) == "success").cast("int") for s in order), F.lit(0))
    failed = F.coalesce(*[F.when(F.col(s) != "success", F.lit(s)) for s in order])
    overall = F.when(done == len(order), "complete").when(done == 0, "failed").otherwise("partial")
    return wide.select(key, overall.alias("overall"), failed.alias("first_failed"), done.alias("ran"))


def attempts(log: DataFrame, key: str, most: int = 3, transient: tuple[str, ...] = ("timeout", "rate_limit", "server")) -> DataFrame:
    """``key, outcome, attempts, tokens``: a retried call's history; only transient failures are tried again, and no more than ``most`` times.

    ``log``: key, attempt, error (null for success), tokens. Attempts after the last that counts are left out of the sum.
    """
    order = Window.partitionBy(key).orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max((F.col("error").isNull() | ~F.col("error").isin(*transient)).cast("int")).over(order), F.lit(0)) == 1
    rows = log.withColumn("_counts", ~ended & (F.col("attempt") <= most)).filter("_counts")
    last = F.max_by(F.struct("error"), "attempt")["error"]
    outcome = F.when(last.isNull(), "success").when(last.isin(*transient), "exhausted").otherwise("refused")
    return rows.groupBy(key).agg(outcome.alias("outcome"), F.count("*").alias("attempts"), F.sum("tokens").alias("tokens"))
