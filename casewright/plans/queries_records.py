"""Queries for projections, gates and packets made from records, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import normalize as N
from casewright.operators import boosting, contract, controller, priors, ranking, records, sections
from casewright.plans.cases import CASES_SQL, cases, table
from casewright.plans.queries import _BAND_SQL, _TRAIN_SQL, _distribution_sql, query


@query("""SELECT c_custkey AS case_id, c_mktsegment AS segment, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE abs(c_acctbal) END AS balance, CAST(c_nationkey AS DOUBLE) AS nation FROM customer""")
def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with their types: categories as text, numbers as doubles, ``unknown`` as null (every third balance here)."""
    i = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(i.alias("case_id"), F.col("c_mktsegment").alias("segment"), F.when(i % 3 == 0, "unknown").otherwise(F.abs("c_acctbal").cast("string")).alias("balance"), F.col("c_nationkey").cast("string").alias("nation"))
    return records.feature_frame(rows, ["segment"], ["balance", "nation"])


@query("""SELECT n_nationkey AS place, count(c_custkey) AS customers, round(avg(abs(c_acctbal)), 4) AS covariate, round(ln(1 + avg(abs(c_acctbal))), 6) AS log_covariate FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def external_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed covariates of a place, for every place and no other, and their logarithm."""
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("place")).agg(F.count("*").alias("customers"), F.avg(F.abs("c_acctbal")).alias("covariate"))
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place")).join(people.select("place"), "place", "left_semi")
    out = records.covariates(places, people, "place", ["customers", "covariate"])
    return out.select("place", "customers", F.round("covariate", 4).alias("covariate"), F.round(F.log1p("covariate"), 6).alias("log_covariate"))


@query(f"""WITH {CASES_SQL} SELECT case_id, 3 + CASE WHEN country <> '' THEN 1 ELSE 0 END + CASE WHEN test_view IS NOT NULL THEN 1 ELSE 0 END AS n, country FROM cases""")
def visible_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reference may show: columns whose name tells the outcome and empty values left out."""
    rows = cases(spark, sf_dir).select("case_id", "country", "region", "importance", "formation", "test_view", F.col("y").alias("y_amount"), F.lit("x").alias("claim_state"))
    out = records.without_fragments(rows)
    return out.select("case_id", F.size("features").alias("n"), F.col("features")["country"].alias("country"))


@query(f"""WITH {CASES_SQL} SELECT case_id, '{{"country":"' || country || '","importance":"' || importance || '","n_articles":' || n_articles || '}}' AS record FROM cases""")
def serialised_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON with sorted names, identity left out."""
    return records.serialised(cases(spark, sf_dir).select("case_id", "split", "test_view", "n_articles", "importance", "country"), "case_id")


@query(f"""WITH {CASES_SQL} SELECT case_id, 'system: Be exact.' || chr(10) || 'user: In ' || country || ', ' || n_applicants || ' applicants.' AS prompt FROM cases""")
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two templates filled with a case's values."""
    prompt = records.messages({"country": F.col("country"), "n": F.col("n_applicants")}, "Be exact.", "In {country}, {n} applicants.")
    return cases(spark, sf_dir).select("case_id", F.array_join(F.transform(prompt, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("prompt"))


@query("""WITH r AS (SELECT c_custkey AS case_id FROM customer), b AS (
        SELECT case_id, 'not_accepted' AS problem FROM r WHERE case_id % 7 = 0 AND case_id % 11 <> 0 UNION ALL SELECT case_id, 'no_hash' FROM r WHERE case_id % 13 = 0 AND case_id % 11 <> 0 UNION ALL SELECT case_id, 'no_text' FROM r WHERE case_id % 17 = 0 AND case_id % 11 <> 0 UNION ALL SELECT case_id, 'missing' FROM r WHERE case_id % 11 = 0)
    SELECT problem, count(*) AS n, min(case_id) AS first_id FROM b GROUP BY problem""")
def facts_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why facts may not be used, by reason (faults planted here)."""
    i = F.col("case_id")
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"))
    rows = wanted.filter(i % 11 != 0).select(
        "case_id", F.when(i % 7 != 0, "accepted_prediction_input").alias("review_status"), F.when(i % 13 != 0, F.sha2(i.cast("string"), 256)).otherwise("00").alias("source_document_sha256"), F.lit("p. 1").alias("source_anchor"), F.when(i % 17 != 0, "facts").otherwise(" ").alias("facts_text"),
    )
    return records.reviewed_facts(rows, wanted).groupBy("problem").agg(F.count("*").alias("n"), F.min("case_id").alias("first_id"))


@query("""WITH m AS (SELECT n_name AS module, n_nationkey AS k FROM nation) SELECT module, k % 3 <> 0 AND k % 4 <> 0 AS allowed, CASE WHEN k % 3 = 0 THEN 'mode' WHEN k % 4 = 0 THEN 'leakage_tier' END AS reason FROM m""")
def module_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which modules a mode may use, and why not (modes and tiers planted here)."""
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("module"), F.when(k % 3 == 0, F.array(F.lit("open"))).otherwise(F.array(F.lit("strict"), F.lit("open"))).alias("allowed_modes"), F.when(k % 4 == 0, "claim_aware").when(k % 4 == 1, "strict_safe").alias("leakage_tier"))
    return records.module_gate(rows, "strict", {"strict": ["strict_safe"], "open": ["strict_safe", "claim_aware"]})


@query("""SELECT CASE event_id % 4 WHEN 0 THEN 'list' WHEN 1 THEN 'text' WHEN 2 THEN 'none' ELSE 'broken' END AS kind, count(*) AS n, CAST(sum(CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END) AS BIGINT) AS items, count(CASE WHEN event_id % 4 = 3 THEN 1 END) AS issues,
    count(CASE WHEN event_id % 5 = 0 THEN 1 END) AS raw_findings FROM events GROUP BY 1""")
def normalised_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List metadata and typed findings read from the forms they come in (planted here)."""
    i = F.col("event_id")
    kind = F.when(i % 4 == 0, "list").when(i % 4 == 1, "text").when(i % 4 == 2, "none").otherwise("broken")
    rows = table(spark, sf_dir, "events").select(kind.alias("kind"), F.when(i % 4 == 0, '["a", "b"]').when(i % 4 == 1, "a; b;;c ").when(i % 4 == 2, " N/A").otherwise('["a", ').alias("scl"), F.when(i % 5 == 0, '[{"article": "3"}]').otherwise('[{"type": "violation", "article": "3"}]').alias("conclusion"))
    out = records.normalised_metadata(rows, ["scl"], "conclusion")
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("scl")), F.lit(0)).cast("long").alias("items"), F.count_if(F.exists("issues", lambda x: x.startswith("scl"))).alias("issues"), F.count("raw_findings").alias("raw_findings"))


@query("""SELECT event_id, '{"list": [{"k": ' || (props::JSON ->> 'k') || '}], "user": ' || user_id || '}' AS value, 'claim_note,list[0].award' AS removed FROM events""")
def sanitised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON without the keys that tell the outcome, at any depth, and the paths that went."""
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "claim_note": 1, "list": [{"k": '), k, F.lit(', "award": {"x": 2}}]}'))
    return table(spark, sf_dir, "events").select("event_id", records.sanitised(text, ["award", "claim"]).alias("s")).select("event_id", "s.value", F.array_join("s.removed", ",").alias("removed"))


@query("""SELECT CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '$.k: above 50' WHEN 2 THEN '$.name: required' ELSE '$.k: not integer' END AS problems, count(*) AS n FROM events GROUP BY 1""")
def schema_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with JSON results, by a schema (faults planted here)."""
    i = F.col("event_id")
    text = F.when(i % 4 == 0, '{"name": "a", "k": 5}').when(i % 4 == 1, '{"name": "a", "k": 51}').when(i % 4 == 2, '{"k": 5}').otherwise('{"name": "a", "k": "5"}')
    schema = {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "k": {"type": "integer", "maximum": 50}}}
    return table(spark, sf_dir, "events").groupBy(F.array_join(records.json_problems(text, schema), ";").alias("problems")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'true' ELSE '' END AS flag, CASE event_id % 3 WHEN 0 THEN 'a|b' WHEN 1 THEN 'one' ELSE '' END AS items FROM events""")
def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes and no, and lists of texts, however they were written (planted here)."""
    i = F.col("event_id")
    flag = F.when(i % 5 == 0, " Yes").when(i % 5 == 1, "FALSE").when(i % 5 == 2, "1").otherwise("maybe")
    items = F.when(i % 3 == 0, '["a", " ", "b", "a"]').when(i % 3 == 1, " one ")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(records.truth(flag).cast("string"), F.lit("")).alias("flag"), F.array_join(records.string_list(items), "|").alias("items"))


@query(f"""WITH {CASES_SQL}, r AS (SELECT a.case_id, l_returnflag AS head, l_linenumber AS o, l_linestatus = 'F' AS granted, CASE WHEN quantity % 2 = 0 THEN 'GBP' ELSE 'EUR' END AS cur, CASE WHEN quantity % 3 = 0 THEN quantity END AS orig, CASE WHEN quantity % 5 <> 0 THEN quantity END AS eur FROM amounts a),
    s AS (SELECT *, row_number() OVER (PARTITION BY case_id, head ORDER BY granted DESC, cur <> 'EUR' DESC, orig IS NOT NULL DESC, eur IS NOT NULL DESC, o, eur DESC NULLS LAST, orig DESC NULLS LAST) AS p FROM r)
    SELECT case_id, head, granted, cur AS original_currency FROM s WHERE p = 1""")
def best_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several readings of an award head the one that says most."""
    q = F.round("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("head"), F.col("l_linenumber").alias("o"), (F.col("l_linestatus") == "F").alias("granted"), F.when(q % 2 == 0, "GBP").otherwise("EUR").alias("original_currency"),
        F.when(q % 3 == 0, q).alias("original_amount"), F.when(q % 5 != 0, q).alias("eur_amount"),
    )
    return records.best_head(rows, ["case_id", "head"], "o").select("case_id", "head", "granted", "original_currency")


@query(f"""WITH {CASES_SQL} SELECT case_id, 'region.name' AS path, region AS value FROM cases WHERE case_id % 2 = 0 UNION ALL SELECT case_id, 'facts.country', country FROM cases WHERE case_id % 2 <> 0""")
def first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value, by a list of terms, among a state's paths."""
    view = cases(spark, sf_dir)
    rows = view.select("case_id", F.struct("country", "importance").alias("facts"), F.when(F.col("case_id") % 2 == 0, F.struct(F.col("region").alias("name"))).alias("region"))
    return records.first_value(controller.flatten(rows, "case_id"), "case_id", ["REGION", "country", "importance"])


@query(f"""WITH {CASES_SQL} SELECT case_id, 'facts.country' AS path, country[:12] AS value FROM cases UNION ALL SELECT case_id, 'facts.region', region[:12 - length(country)] FROM cases WHERE length(country) < 12""")
def target_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected paths of a target's state, in order, up to a number of characters."""
    rows = cases(spark, sf_dir).select("case_id", F.struct("country", "importance", "region").alias("facts"))
    return records.path_query(controller.flatten(rows, "case_id"), "case_id", ["facts.country", "region"], 12)


@query(f"""WITH {_TRAIN_SQL}, p AS ({_distribution_sql('train', 'country')}) SELECT c.case_id, c.split, c.n_articles, p.median AS prior_median, c.n_applicants > 100 OR c.n_applicants >= 21 AS large FROM cases c LEFT JOIN p ON p.country = c.country WHERE c.split = 'test'""")
def case_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a test case: its own fields, its prior and its structure, as one row."""
    view = cases(spark, sf_dir)
    test = view.filter("split = 'test'")
    prior = priors.distribution(view.filter("split = 'train'"), ["country"]).select("country", "median")
    parts = {"case": test.select("case_id", "split", "n_articles"), "prior": test.select("case_id", "country").join(prior, "country").select("case_id", "median"), "structure": test.select("case_id", N.aggregation_class(F.col("n_applicants"), F.col("n_applications")).alias("kind"))}
    out = records.states(parts, "case_id")
    return out.select("case_id", "case.split", "case.n_articles", F.col("prior.median").alias("prior_median"), F.col("structure.kind").isin("mass", "large").alias("large"))


@query(f"""WITH {CASES_SQL}, r AS (SELECT region, country, case_id, y, {_BAND_SQL} AS band, CASE WHEN n_applications <= 1 THEN '1' WHEN n_applications <= 5 THEN '2-5' ELSE '6-20' END AS own FROM cases WHERE split = 'train'),
    t AS (SELECT case_id, country, {_BAND_SQL} AS band, CASE WHEN n_applications <= 1 THEN '1' WHEN n_applications <= 5 THEN '2-5' ELSE '6-20' END AS own FROM cases WHERE split = 'test' AND case_id % 50 = 0),
    p AS (SELECT t.case_id AS target_id, r.case_id AS ref_id, row_number() OVER (PARTITION BY t.case_id ORDER BY CASE WHEN r.country = t.country THEN 1 ELSE 0 END DESC, CASE WHEN r.own = t.own THEN 1 ELSE 0 END DESC, r.y DESC, r.case_id) AS rank FROM t JOIN r ON r.band = t.band)
    SELECT target_id, ref_id, rank FROM p WHERE rank <= 8""")
def same_band_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training cases in the band of a target's applicants: the same country first, then the same band of applications, then by amount.

    Targets are the test cases whose id is divisible by 50. References are cut to eight for each class that a
    target can ask for before the join, so what is joined does not grow with the references.
    """
    view = cases(spark, sf_dir).withColumn("band", N.count_band(F.col("n_applicants"))).withColumn("own", N.count_band(F.col("n_applications")))
    refs = view.filter("split = 'train'").select(F.col("case_id").alias("ref_id"), F.col("country").alias("r_country"), "band", F.col("own").alias("r_own"), "y")
    order = [F.desc("y"), F.asc("ref_id")]
    # the best eight of (band, country, own), of which eight of every class together are the best of any coarser class
    few = ranking.top_k(refs, ["band", "r_country", "r_own"], order, 8, "_r").drop("_r")
    t = view.filter("split = 'test' and case_id % 50 = 0").select(F.col("case_id").alias("target_id"), "country", "band", "own")
    rows = t.join(few, "band")
    out = ranking.top_k(rows, ["target_id"], [F.desc((F.col("r_country") == F.col("country")).cast("int")), F.desc((F.col("r_own") == F.col("own")).cast("int")), *order], 8)
    return out.select("target_id", "ref_id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {CASES_SQL} SELECT CASE split WHEN 'train' THEN 'train' ELSE split END AS split, count(*) AS n FROM cases GROUP BY 1""")
def split_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits by any of their names (written in several ways here)."""
    i = F.col("case_id") % 2
    written = F.when(F.col("split") == "train", F.when(i == 0, " TRAIN").otherwise("training")).when(F.col("split") == "validation", F.when(i == 0, "val").otherwise("dev")).otherwise("test")
    return cases(spark, sf_dir).groupBy(records.split_name(written).alias("split")).agg(F.count("*").alias("n"))


# sections, stages and suites


@query("""SELECT o_orderkey AS doc, CASE o_orderkey % 5 WHEN 0 THEN 'narrative_rich' WHEN 1 THEN 'summary_mode' WHEN 2 THEN 'law_only' WHEN 3 THEN 'conclusion_only' ELSE 'unknown' END AS profile,
    CASE o_orderkey % 5 WHEN 0 THEN 'narrative_sections' WHEN 1 THEN 'summary_intro_plus_assessment' WHEN 2 THEN 'law_fallback' ELSE 'skip' END AS facts_mode, CASE o_orderkey % 5 WHEN 1 THEN 'summary_intro_fallback' WHEN 2 THEN 'law_and_relevant_law' ELSE 'empty' END AS reasoning_mode,
    CASE o_orderkey % 5 WHEN 2 THEN 'heading' END AS method, CASE o_orderkey % 5 WHEN 0 THEN 'facts' WHEN 1 THEN 'summary_intro' WHEN 2 THEN 'law' WHEN 3 THEN 'operative' ELSE 'unclassified' END AS names FROM orders""")
def document_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of sections made flat, merged by canonical name, and what kind of document they make (trees planted here)."""
    i = F.col("doc") % 5
    heading = F.when(i == 0, "THE FACTS").when(i == 1, "Subject matter of the case").when(i == 2, "THE LAW").when(i == 3, "For these reasons, the Court").otherwise("A")
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc")).select(
        "doc", F.inline(F.array(
            F.struct(F.array(F.lit(0), F.lit(1)).alias("path"), F.when(i == 2, "APPLICATION OF ARTICLE 41").otherwise("below").alias("content")), F.struct(F.array(F.lit(0)).alias("path"), heading.alias("content")),
            F.struct(F.array(F.lit(0), F.lit(0), F.lit(2)).alias("path"), F.lit("deep").alias("content")),
        )),
    )
    out = sections.profiled(sections.flattened(nodes, "doc"), "doc")
    return out.select("doc", "profile", "facts_mode", "reasoning_mode", F.col("compensation_method").alias("method"), F.array_join("names", ",").alias("names"))


@query("""SELECT c_custkey AS itemid, CASE WHEN c_custkey % 4 < 3 THEN 1990 + c_custkey % 30 ELSE 0 END AS judgment_year, CASE WHEN c_custkey % 3 = 0 THEN 'Grand Chamber' WHEN c_custkey % 3 = 1 THEN 'Committee' END AS decision_body,
    CASE WHEN c_custkey % 2 = 0 THEN '3;6' END AS violated, CASE WHEN c_custkey % 3 = 0 THEN 'true' WHEN c_custkey % 2 = 0 AND c_custkey % 5 > 0 THEN 'true' ELSE 'unknown' END AS challenging,
    concat_ws(',', CASE WHEN c_custkey % 7 = 0 THEN 'scl' END, CASE WHEN c_custkey % 5 = 0 THEN 'application_numbers' END, CASE WHEN c_custkey % 2 = 1 THEN 'violated_article_codes' END) AS missing FROM customer""")
def core_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core rows with what they lack; the hard selector is unknown where neither arm is known to hold (metadata planted here)."""
    i = F.col("itemid")
    finding = lambda article: F.struct(F.lit("violation").alias("type"), article.cast("string").alias("article"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("itemid")).select(
        "itemid", F.concat(F.lit("CASE OF X"), i.cast("string"), F.lit(" v. Y")).alias("docname"), F.when(i % 5 > 0, "12/34;56/78").alias("appno"), F.when(i % 3 == 0, "GRAND CHAMBER").when(i % 3 == 1, "COMMITTEE").alias("doctypebranch"), F.lit(None).cast("string").alias("originatingbody_name"),
        F.when(i % 4 < 3, F.concat(F.lit("1/2/"), (1990 + i % 30).cast("string"))).alias("judgementdate"), F.array(F.lit("3")).alias("article"), F.when(i % 7 > 0, F.array(F.lit("a"))).alias("scl"), F.array(F.lit("N/A")).alias("representedby"),
        F.array(finding(F.lit("3")), finding(F.when(i % 2 == 0, "6")), finding(F.lit("3"))).alias("conclusion"),
    )
    out = sections.core_rows(rows)
    return out.select("itemid", F.coalesce("judgment_year", F.lit(0)).cast("long").alias("judgment_year"), "decision_body", F.array_join("violated_articles", ";").alias("violated"), F.coalesce(F.col("challenging").cast("string"), F.lit("unknown")).alias("challenging"), F.array_join("missing_fields", ",").alias("missing"))


@query(f"""WITH {CASES_SQL}, a AS (SELECT case_id, count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_linenumber END) AS n FROM amounts GROUP BY case_id HAVING count(CASE WHEN l_returnflag <> 'N' THEN 1 END) > 0)
    SELECT CASE WHEN c.n_applicants <= 2 OR a.n IS NULL THEN 'unknown' WHEN a.n = c.n_applicants - 2 THEN 'pass' WHEN a.n > c.n_applicants - 2 THEN 'over' ELSE 'under' END AS status, count(*) AS n FROM cases c LEFT JOIN a ON a.case_id = c.case_id GROUP BY 1""")
def beneficiary_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether awards reach as many applicants as a case has (two fewer than its items here)."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("index"), F.when(F.col("l_returnflag") == "N", "external").otherwise("applicant").alias("kind"))
    counts = cases(spark, sf_dir).select("case_id", (F.col("n_applicants") - 2).alias("n_applicants"))
    return sections.reconciled(rows, counts, "case_id").groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN c_custkey % 3 = 0 THEN 'complete' WHEN c_custkey % 3 = 1 THEN 'partial' ELSE 'failed' END AS overall, CASE WHEN c_custkey % 3 = 1 THEN 'c' WHEN c_custkey % 3 = 2 THEN 'b' END AS first_failed, count(*) AS n, CAST(sum(CASE c_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END) AS BIGINT) AS ran FROM customer GROUP BY 1, 2""")
def staged_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall states of cases from their stages (states planted here; a stage needs those before it)."""
    i = F.col("k")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).select("k", F.inline(F.array(
        F.struct(F.lit("b").alias("stage"), F.when(i % 3 == 2, "error").otherwise("error").alias("status"), F.lit(1).alias("attempt")), F.struct(F.lit("b").alias("stage"), F.when(i % 3 == 2, "error").otherwise("success").alias("status"), F.lit(2).alias("attempt")),
        F.struct(F.lit("c").alias("stage"), F.when(i % 3 == 1, "error").otherwise("success").alias("status"), F.lit(1).alias("attempt")), F.struct(F.lit("de").alias("stage"), F.lit("success").alias("status"), F.lit(1).alias("attempt")),
    )))
    out = sections.staged(rows, "k", ("b", "c", "de"), {"c": ("b",), "de": ("c",)})
    return out.groupBy("overall", "first_failed").agg(F.count("*").alias("n"), F.sum("ran").cast("long").alias("ran"))


@query("""SELECT CASE k % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'refused' WHEN 2 THEN 'exhausted' ELSE 'success' END AS outcome, CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 2 END AS attempts, count(*) AS n, CAST(sum(CASE k % 4 WHEN 0 THEN 10 WHEN 1 THEN 30 WHEN 2 THEN 60 ELSE 30 END) AS BIGINT) AS tokens FROM (SELECT c_custkey AS k FROM customer) q GROUP BY 1, 2""")
def retried_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of retried calls, and the use of the attempts that count (histories planted here)."""
    k = F.col("k")
    error = lambda n: F.when((k % 4 == 0) & (n >= 1), None).when((k % 4 == 1) & (n == 2), "schema").when((k % 4 == 3) & (n == 2), None).otherwise("timeout")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("attempt"))
    log = rows.select("k", "attempt", error(F.col("attempt")).alias("error"), (F.col("attempt") * 10).alias("tokens"))
    return sections.attempts(log, "k").groupBy("outcome", F.col("attempts").cast("int").alias("attempts")).agg(F.count("*").alias("n"), F.sum("tokens").cast("long").alias("tokens"))


@query("""WITH p AS (SELECT c_custkey AS k, unnest(list_filter([CASE WHEN c_custkey % 17 = 0 THEN 'outside_cohort' END, CASE WHEN c_custkey % 17 <> 0 AND c_custkey % 5 = 0 THEN 'split_changed' END, CASE WHEN c_custkey % 7 = 0 THEN 'not_accepted' END, CASE WHEN c_custkey % 11 = 0 THEN 'not_bound' END, CASE WHEN c_custkey % 13 = 0 THEN 'checks' END,
        CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'zero_without_rationale' END, CASE WHEN c_custkey % 17 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 4 = 0 THEN 'change_without_rationale' END], lambda x: x IS NOT NULL)) AS problem FROM customer)
    SELECT problem, count(*) AS n, min(k) AS first_id FROM p GROUP BY problem""")
def review_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why reviewed records may not be exported, by reason (faults planted here)."""
    i = F.col("case_id")
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.lit("train").alias("split"), F.when(i % 3 == 0, 0).otherwise(5).alias("amount"))
    reviews = base.select(
        "case_id", F.when(i % 5 == 0, "test").otherwise("train").alias("split"), F.when((i % 3 != 0) & (i % 4 == 0), 6).otherwise(F.col("amount")).alias("amount"), F.when(i % 7 != 0, "accepted").alias("status"), F.lit("A").alias("adjudicator"), F.lit("p. 1").alias("source_anchor"),
        F.lit("h").alias("record_sha256"), F.when(i % 11 == 0, "g").otherwise("h").alias("expected_sha256"), F.create_map(F.lit("a"), F.lit("pass"), F.lit("b"), F.when(i % 13 == 0, "open").otherwise("not_applicable")).alias("checks"),
        F.when(i % 2 != 0, "no_claim").alias("zero_rationale"), F.lit("retained_label").alias("target_status"), F.lit("").alias("correction_rationale"),
    )
    found = contract.review_problems(reviews, base.filter(i % 17 != 0), ("a", "b"), ("no_claim",))
    return found.groupBy("problem").agg(F.count("*").alias("n"), F.min("case_id").alias("first_id"))


@query(f"""WITH {CASES_SQL} SELECT 'dates' AS check, count(CASE WHEN judgment_date IS NULL THEN 1 END) AS problems, count(CASE WHEN judgment_date IS NULL THEN 1 END) = 0 AS ok FROM cases UNION ALL SELECT 'articles', count(CASE WHEN n_articles = 0 THEN 1 END), count(CASE WHEN n_articles = 0 THEN 1 END) = 0 FROM cases
    UNION ALL SELECT 'exclusions', 0, true""")
def smoke_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suite of checks of a release, each passed if it finds nothing."""
    view = cases(spark, sf_dir)
    none = view.filter("split = 'train'").join(view.filter("split != 'train'").select("case_id"), "case_id", "left_semi")
    return contract.smoke({"dates": view.filter("judgment_date is null"), "articles": view.filter("n_articles = 0"), "exclusions": none})


@query()
def boosted_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test cases predicted by boosted trees, the better of two candidates on validation cases. No SQL can fit them; tests hold them to a constant's error."""
    view = cases(spark, sf_dir).withColumn("grand", F.col("is_grand").cast("double"))
    features = ["n_applicants", "n_applications", "n_articles", "grand"]
    train, validation = view.filter("split = 'train'"), view.filter("split = 'validation'")
    candidates = {"shallow": {"maxDepth": 2, "maxIter": 10}, "deep": {"maxDepth": 5, "maxIter": 10}}
    name, _ = boosting.chosen(train, validation, features, candidates)
    return boosting.boosted(train, view.filter("split = 'test'"), features, params=candidates[name]).select("case_id", "y", F.round("prediction", 4).alias("prediction"), F.lit(name).alias("candidate"))
