"""Queries for awards, the controller and sections of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.operators import awards, controller, ranking, retrieval
from casewright.plans.cases import CASES_SQL, amounts, articles, cases, table
from casewright.plans.queries import query

_HEAD_SQL = "CASE l_returnflag WHEN 'R' THEN 'non_pecuniary' WHEN 'A' THEN 'pecuniary' ELSE 'costs' END"
_SUM_SQL = ", ".join(f"CAST(sum(CASE WHEN head = '{h}' THEN amount4 END) AS DOUBLE) AS {h}" for h in awards.HEADS)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("l_returnflag") == "R", "non_pecuniary").when(F.col("l_returnflag") == "A", "pecuniary").otherwise("costs")
    return amounts(spark, sf_dir).withColumn("head", head)


@query(f"""WITH {CASES_SQL}, r AS (SELECT case_id, amount4, {_HEAD_SQL} AS head FROM amounts), s AS (SELECT case_id, {_SUM_SQL} FROM r GROUP BY case_id)
    SELECT *, coalesce(non_pecuniary, 0) + coalesce(pecuniary, 0) + coalesce(costs, 0) AS total FROM s""")
def award_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by head, null where a head has no row."""
    return awards.sums_by_head(_rows(spark, sf_dir).withColumn("amount4", F.col("amount4").cast("double")), "case_id", amount="amount4")


@query(f"""WITH {CASES_SQL}, r AS (SELECT case_id, amount4, l_linestatus, {_HEAD_SQL} AS head FROM amounts),
    c AS (SELECT case_id, head, sum(CASE WHEN l_linestatus = 'F' THEN amount4 END) AS claimed, sum(CASE WHEN amount4 % 3 > 0 THEN amount4 END) AS awarded, count(DISTINCT l_linestatus) > 1 AS leave_open, count(*) < 3 AS comparable FROM r GROUP BY case_id, head)
    SELECT head, CASE WHEN awarded IS NULL THEN 'no_award' WHEN claimed IS NULL AND NOT leave_open THEN CASE WHEN awarded <= 10000 THEN 'pass_no_claim_zero_award' ELSE 'fail_no_claim_positive_award' END
        WHEN leave_open THEN 'pass_leave_to_court' WHEN NOT comparable THEN 'review_explicit_amount_uncomparable' WHEN awarded <= claimed + 10000 THEN 'pass_award_leq_claim' ELSE 'fail_award_exceeds_claim' END AS status, count(*) AS n
    FROM c GROUP BY 1, 2""")
def claim_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims against awards by head."""
    a = F.col("amount4")
    rows = _rows(spark, sf_dir).groupBy("case_id", "head").agg(
        F.sum(F.when(F.col("l_linestatus") == "F", a)).alias("claimed"), F.sum(F.when(a % 3 > 0, a)).alias("awarded"), (F.countDistinct("l_linestatus") > 1).alias("leave_open"), (F.count("*") < 3).alias("comparable"),
    )
    status = awards.claim_status(F.col("claimed"), F.col("awarded"), F.col("leave_open"), F.col("comparable"), 10000)
    return rows.groupBy("head", status.alias("status")).agg(F.count("*").alias("n"))


@query(f"""WITH {CASES_SQL}, s AS (SELECT case_id, sum(CASE WHEN l_linestatus = 'F' THEN amount4 END) AS a, sum(CASE WHEN l_returnflag <> 'N' THEN amount4 END) AS b FROM amounts GROUP BY case_id)
    SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'both_missing' WHEN a IS NULL THEN 'validator_missing' WHEN b IS NULL THEN 'llm_missing' WHEN abs(a - b) <= 10000 THEN 'match' ELSE 'mismatch' END AS status, count(*) AS n FROM s GROUP BY 1""")
def cross_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways to the same sum."""
    rows = amounts(spark, sf_dir).groupBy("case_id").agg(F.sum(F.when(F.col("l_linestatus") == "F", F.col("amount4"))).alias("a"), F.sum(F.when(F.col("l_returnflag") != "N", F.col("amount4"))).alias("b"))
    return rows.groupBy(awards.cross_check(F.col("a"), F.col("b"), 10000).alias("status")).agg(F.count("*").alias("n"))



@query("""WITH p AS (SELECT DISTINCT l_orderkey AS case_id, l_linenumber AS idx FROM lineitem),
    l AS (SELECT case_id, idx, CASE WHEN idx % 5 = 0 THEN 'index' WHEN idx % 4 = 0 THEN 'ordinal' WHEN idx % 4 = 1 THEN CASE WHEN idx IN (1, 5) THEN 'ordinal' ELSE 'surname' END WHEN idx % 4 = 2 THEN 'name' ELSE 'surname' END AS how FROM p)
    SELECT how, count(*) AS n, CAST(sum(idx) AS BIGINT) AS sum_index FROM l GROUP BY how""")
def beneficiaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all cases resolved to applicants by an explicit index, an ordinal, the name or a surname."""
    return _resolved(table(spark, sf_dir, "lineitem"))


def _resolved(lines: DataFrame) -> DataFrame:
    rows = lines.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("index")).distinct()
    people = rows.withColumn("name", F.concat(F.lit("Person "), F.chr(F.lit(64) + F.col("index"))))
    i = F.col("index")
    label = F.when(i % 4 == 0, F.concat(F.lit("applicant "), i.cast("string"))).when(i == 1, "the first applicant").when(i == 5, "the fifth applicant").when(i % 4 == 2, F.col("name")).otherwise(F.concat(F.lit("Mr "), F.chr(F.lit(64) + i)))
    given = F.when(i % 5 == 0, i)
    out = awards.resolve_beneficiaries(people.select("case_id", label.alias("label"), given.alias("given")), people, "case_id", "given")
    return out.groupBy("how").agg(F.count("*").alias("n"), F.sum("index").cast("long").alias("sum_index"))


@query(f"""WITH {CASES_SQL}, a AS (SELECT article, avg(CASE WHEN y <= 0 THEN 1.0e0 ELSE 0.0e0 END) AS zero_rate, quantile_cont(y, 0.5) AS middle FROM articles JOIN cases ON cases.case_id = articles.case_id WHERE split = 'train' GROUP BY article),
    e AS (SELECT cases.case_id, max(zero_rate) AS zero_rate, max(middle) AS middle, max(n_applicants) AS n FROM cases LEFT JOIN articles ON articles.case_id = cases.case_id LEFT JOIN a ON a.article = articles.article WHERE split = 'test' GROUP BY cases.case_id),
    i AS (SELECT case_id, CASE WHEN zero_rate >= 0.26 THEN 1 ELSE 0 END + CASE WHEN n <= 1 THEN 1 ELSE 0 END AS zero, CASE WHEN middle > 45000 THEN 1 ELSE 0 END + CASE WHEN zero_rate < 0.24 THEN 1 ELSE 0 END AS positive, n = 0 AS stated FROM e)
    SELECT CASE WHEN stated THEN 'zero_plausible' WHEN zero > 0 AND positive > 0 THEN 'ambiguous' WHEN zero > 0 THEN 'zero_plausible' WHEN positive > 0 THEN 'positive_plausible' ELSE 'insufficient_evidence' END AS recommendation, count(*) AS n FROM i GROUP BY 1""")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators for and against a zero outcome, and what they recommend."""
    view = cases(spark, sf_dir)
    each = view.filter("split = 'train'").withColumn("article", F.explode("articles"))
    by_article = each.groupBy("article").agg(F.avg((F.col("y") <= 0).cast("double")).alias("zero_rate"), F.percentile("y", F.lit(0.5)).alias("middle"))
    test = view.filter("split = 'test'").select("case_id", "n_applicants", F.explode_outer("articles").alias("article")).join(by_article, "article", "left")
    e = test.groupBy("case_id").agg(F.max("zero_rate").alias("zero_rate"), F.max("middle").alias("middle"), F.max("n_applicants").alias("n"))
    count = lambda *conditions: sum((F.when(c, 1).otherwise(0) for c in conditions), F.lit(0))
    advice = controller.recommendation(count(F.col("zero_rate") >= 0.26, F.col("n") <= 1), count(F.col("middle") > 45000, F.col("zero_rate") < 0.24), F.col("n") == 0)
    return e.groupBy(advice.alias("recommendation")).agg(F.count("*").alias("n"))


@query(f"""WITH {CASES_SQL} SELECT case_id, CASE WHEN importance = '3-MEDIUM' THEN 'leakage' WHEN acctbal < 0 THEN 'invalid' ELSE 'accepted' END AS status,
    CASE WHEN importance <> '3-MEDIUM' AND acctbal >= 0 THEN CASE WHEN is_grand THEN least(acctbal, y) ELSE acctbal END END AS final FROM cases""")
def final_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions refused, or capped by a claim where that applies."""
    status, value = controller.gated(F.col("acctbal"), F.col("importance") == "3-MEDIUM", F.col("y"), F.col("is_grand"))
    return cases(spark, sf_dir).select("case_id", status.alias("status"), value.alias("final"))


@query(f"""WITH {CASES_SQL} SELECT case_id, string_agg(DISTINCT CASE WHEN article IN ('Brand#11', 'Brand#12') THEN 'module_one' WHEN article LIKE 'Brand#2%' THEN 'module_two' ELSE 'generic' END, ';'
    ORDER BY CASE WHEN article IN ('Brand#11', 'Brand#12') THEN 'module_one' WHEN article LIKE 'Brand#2%' THEN 'module_two' ELSE 'generic' END) AS modules FROM articles GROUP BY case_id""")
def module_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case's modules by its articles."""
    names = articles(spark, sf_dir).select("article").distinct()
    module = F.when(F.col("article").isin("Brand#11", "Brand#12"), "module_one").when(F.col("article").startswith("Brand#2"), "module_two")
    modules = names.withColumn("module", module).filter("module is not null")
    return controller.route(articles(spark, sf_dir), "case_id", "article", modules, "generic").groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("module")), ";").alias("modules"))


@query("""WITH b AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
    SELECT conv_id, turn, substring(text, 1, CAST(400 - before AS INTEGER)) AS text FROM b WHERE before < 400""")
def budgeted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 400 characters of each conversation, turn by turn."""
    return controller.within_budget(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn"], "text", 400)


@query("""WITH d AS (SELECT conv_id, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS s, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS u, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS a FROM conversations GROUP BY conv_id)
    SELECT conv_id, concat_ws(';', CASE WHEN s = 0 THEN 'system' END, CASE WHEN u = 0 THEN 'user' END, CASE WHEN a = 0 THEN 'assistant' END) AS missing FROM d""")
def missing_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required steps that a trace lacks."""
    out = controller.missing_actions(table(spark, sf_dir, "conversations"), "conv_id", "role", ("system", "user", "assistant"))
    return out.select("conv_id", F.array_join("missing", ";").alias("missing"))


@query(r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\n'), 1) AS i FROM documents),
    h AS (SELECT *, length(line) <= 120 AND length(regexp_replace(line, '[^\p{L}]', '', 'g')) > 0 AND length(regexp_replace(line, '[^\p{Lu}]', '', 'g')) >= 0.55 * length(regexp_replace(line, '[^\p{L}]', '', 'g')) AS heading FROM l),
    s AS (SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS segment FROM h)
    SELECT doc_id, count(DISTINCT segment) AS sections, count(*) AS n_lines, count(CASE WHEN heading THEN 1 END) AS headings FROM s GROUP BY doc_id""")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at headings."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("i", "line"))
    rows = rows.withColumn("heading", X.looks_like_heading(F.col("line"), share=0.55))
    cut = controller.segments(rows, ["doc_id"], "i", F.col("heading"))
    return cut.groupBy("doc_id").agg(F.countDistinct("segment").alias("sections"), F.count("*").alias("n_lines"), F.count_if("heading").alias("headings"))


@query(r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\n'), 1) AS i FROM documents),
    n AS (SELECT *, max(CASE WHEN regexp_matches(line, '(?i)license|copyright|@') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM l)
    SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM n WHERE near = 1 GROUP BY doc_id""")
def keyword_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a keyword and the lines next to them."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("i", "line"))
    near = controller.with_neighbours(rows, ["doc_id"], "i", F.col("line").rlike("(?i)license|copyright|@"))
    return near.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


@query("""SELECT 'forbidden_value' AS reason, 'props' AS path, count(*) AS n FROM events WHERE regexp_matches(props, '7') HAVING count(*) > 0
    UNION ALL SELECT 'forbidden_name', 'value', count(*) FROM events WHERE value IS NOT NULL HAVING count(*) > 0""")
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible paths that a blind view must not show."""
    flat = controller.flatten(table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props"), "event_id")
    return controller.leakage(flat, ("value",), "7").filter("path in ('props', 'value')").groupBy("reason", "path").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT item_id AS id, token, count(*) AS weight FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS token FROM benchmark) x WHERE token <> '' GROUP BY item_id, token),
    s AS (SELECT a.id AS query_id, b.id, CAST(sum(a.weight * b.weight) AS BIGINT) AS score FROM t a JOIN t b ON a.token = b.token WHERE b.id < a.id GROUP BY a.id, b.id)
    SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) q WHERE rank <= 5""")
def sparse_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages by the product of their token counts, among earlier ones."""
    rows = retrieval.terms(table(spark, sf_dir, "benchmark"), "item_id", "text").select("id", F.col("term").alias("token"), F.col("tf").alias("weight"))
    scored = retrieval.sparse_scores(rows, rows).filter("id < query_id")
    out = ranking.top_k(scored, ["query_id"], [F.desc("score"), F.asc("id")], 5)
    return out.withColumn("rank", F.col("rank").cast("long"))
