"""Queries for validated joins, encoders, priors as stored, pins and contracts, and harvests, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators import contract, encode, joins, metrics, priors
from casewright.plans.cases import CASES_SQL, amounts, cases, table
from casewright.plans.queries import _TRAIN_SQL, _distribution_sql, query
from casewright.streaming import harvest

# joins


@query("SELECT o_orderkey AS case_id, o_orderpriority AS importance, c_custkey, n_name AS country FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def cases_with_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, customers and nations joined on keys that are checked to be unique."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("importance"), F.col("o_custkey").alias("c_custkey"))
    people = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    places = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return orders.join(joins.unique(people, ["c_custkey"], "customer"), "c_custkey").join(joins.unique(places, ["n_nationkey"], "nation"), "n_nationkey").select("case_id", "importance", "c_custkey", "country")


@query(f"WITH {CASES_SQL} SELECT case_id, split, n_applicants, n_articles, acctbal, y, CAST(CASE WHEN y > 0 THEN 1 ELSE 0 END AS INTEGER) AS y_binary FROM cases")
def audited_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and targets joined one to one."""
    view = cases(spark, sf_dir)
    return joins.one_to_one(view.select("case_id", "split", "n_applicants", "n_articles", "acctbal"), view.select("case_id", "y", (F.col("y") > 0).cast("int").alias("y_binary")), "case_id")


@query("""WITH k AS (SELECT coalesce(a, b) AS k, coalesce(l, 0) AS l, coalesce(r, 0) AS r FROM (SELECT l_orderkey AS a, count(*) AS l FROM lineitem GROUP BY 1) x FULL OUTER JOIN (SELECT o_orderkey AS b, count(*) AS r FROM orders GROUP BY 1) y ON a = b)
    SELECT 'left_duplicate' AS rule, count(*) AS n, min(k) AS first_key FROM k WHERE l > 1 HAVING count(*) > 0 UNION ALL SELECT 'right_duplicate', count(*), min(k) FROM k WHERE r > 1 HAVING count(*) > 0
    UNION ALL SELECT 'left_only', count(*), min(k) FROM k WHERE r = 0 HAVING count(*) > 0 UNION ALL SELECT 'right_only', count(*), min(k) FROM k WHERE l = 0 HAVING count(*) > 0""")
def join_key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands against joining line items and orders one to one."""
    return joins.key_violations(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k"), table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k"), "k")


@query("""SELECT coalesce(problem, 'none') AS problem, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM (
        SELECT l.doc_id, quality, d.n_chars, CASE WHEN d.doc_id IS NULL THEN 'no_case' WHEN trim(coalesce(t.text, ''), ' ') = '' THEN 'no_text' END AS problem
        FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN text END AS text FROM documents) t ON t.doc_id = l.doc_id) q GROUP BY 1""")
def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with their case and text; rows without either are kept and named (every 13th text is taken away here)."""
    docs = table(spark, sf_dir, "documents")
    texts = docs.select("doc_id", F.when(F.col("doc_id") % 13 != 0, F.col("text")).alias("text"))
    rows = joins.with_texts(table(spark, sf_dir, "labels").select("doc_id", "quality"), docs.select("doc_id", "n_chars"), texts, "doc_id", "text")
    return rows.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good"), F.sum("n_chars").cast("long").alias("n_chars"))


@query(f"""WITH {CASES_SQL}, s AS (SELECT CASE WHEN case_id % 101 = 0 THEN -case_id ELSE case_id END AS id, CASE WHEN case_id % 97 = 0 THEN y + 1 ELSE y END AS v, CASE WHEN case_id % 83 = 0 THEN 'train' ELSE split END AS sp FROM cases WHERE case_id % 89 <> 0),
    j AS (SELECT s.*, c.case_id, c.y, c.split FROM s FULL OUTER JOIN cases c ON s.id = c.case_id)
    SELECT 'unknown_id' AS problem, count(*) AS n, min(id) AS first_key FROM j WHERE case_id IS NULL UNION ALL SELECT 'missing_id', count(*), min(case_id) FROM j WHERE id IS NULL
    UNION ALL SELECT 'value_differs', count(*), min(id) FROM j WHERE id = case_id AND v <> y UNION ALL SELECT 'split_differs', count(*), min(id) FROM j WHERE id = case_id AND sp <> split""")
def target_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplied targets held against canonical ones, by kind of difference (planted here)."""
    view = cases(spark, sf_dir).select("case_id", "y", "split")
    i = F.col("case_id")
    supplied = view.filter(i % 89 != 0).select(F.when(i % 101 == 0, -i).otherwise(i).alias("case_id"), F.when(i % 97 == 0, F.col("y") + 1).otherwise(F.col("y")).alias("y"), F.when(i % 83 == 0, "train").otherwise(F.col("split")).alias("split"))
    return joins.target_differences(supplied, view, "case_id", "y", "split").groupBy("problem").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


@query("""WITH p AS (SELECT l_orderkey AS case_id, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT l_orderkey AS case_id, CAST(round(sum(l_quantity)) AS BIGINT) AS units FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    m AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT o_orderkey AS case_id, c_mktsegment AS party_segment, coalesce(p.n, 0) AS person_n, coalesce(a.units, 0) AS allocation_units, m.state AS manifest_state, c_custkey IS NOT NULL AS has_party, p.case_id IS NOT NULL AS has_person, a.case_id IS NOT NULL AS has_allocation, m.case_id IS NOT NULL AS has_manifest
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN p ON p.case_id = o_orderkey LEFT JOIN a ON a.case_id = o_orderkey LEFT JOIN m ON m.case_id = o_orderkey""")
def export_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with party, persons, allocations and manifest row, each joined on a key checked to be unique."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "case_id")
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("custkey"))
    party = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"))
    paid = lines.filter("l_returnflag = 'R'").groupBy("case_id").agg(F.round(F.sum("l_quantity")).cast("long").alias("units"))
    manifest = table(spark, sf_dir, "orders").filter("o_orderkey % 5 != 0").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"))
    return joins.star(base, [(party, ["custkey"], "party"), (lines.groupBy("case_id").agg(F.count("*").alias("n")), ["case_id"], "person"), (paid, ["case_id"], "allocation"), (manifest, ["case_id"], "manifest")]).drop("custkey").fillna(0, ["person_n", "allocation_units"])


@query("""WITH a AS (SELECT c_custkey AS id, nullif(trim(c_name), '') AS name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 11 <> 0),
    b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'other' ELSE c_name END AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0)
    SELECT coalesce(a.id, b.id) AS id, coalesce(b.name, a.name) AS name, coalesce(b.segment, a.segment) AS segment, concat_ws(',', CASE WHEN a.name <> b.name THEN 'name' END, CASE WHEN a.segment <> b.segment THEN 'segment' END) AS conflicts
    FROM a FULL OUTER JOIN b ON a.id = b.id""")
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of metadata merged column by column, the second preferred, conflicts listed (planted here)."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    a = rows.filter("id % 11 != 0").withColumn("segment", F.when(F.col("id") % 7 != 0, F.col("segment")))
    b = rows.filter("id % 3 != 0").withColumn("name", F.when(F.col("id") % 5 == 0, "other").otherwise(F.col("name")))
    return joins.merged_metadata(a, b, "id", ["name", "segment"], "second").withColumn("conflicts", F.array_join("conflicts", ","))


@query("""WITH a AS (SELECT l_orderkey AS k, l_linestatus AS s, l_shipdate AS d FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_orderkey AS k, l_linestatus AS s, l_shipdate AS d FROM lineitem WHERE l_returnflag <> 'N'),
    c AS (SELECT k, s, d, sum(x) AS x FROM (SELECT k, s, d, 1 AS x FROM a UNION ALL SELECT k, s, d, -1 FROM b) u GROUP BY k, s, d) SELECT k AS case_id, max(abs(x)) = 0 AS same FROM c GROUP BY k""")
def row_multisets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a case has the same rows, apart from their label, in two selections."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), "l_returnflag", "l_linestatus", "l_shipdate")
    return joins.same_multisets(rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag != 'N'"), "case_id", ["l_linestatus", "l_shipdate"])


# encoders


@query(f"""WITH {CASES_SQL}, s AS (SELECT avg(ln(1 + y)) AS m, coalesce(nullif(stddev_pop(ln(1 + y)), 0), 1) AS sd FROM cases WHERE split = 'train')
    SELECT case_id, round((ln(1 + y) - m) / sd, 6) AS z, true AS restored FROM cases CROSS JOIN s""")
def scaled_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets on the standardised log scale of training cases, and back."""
    view = cases(spark, sf_dir)
    rows = view.crossJoin(F.broadcast(encode.fit_target_scaler(view.filter("split = 'train'")))).withColumn("scaled", encode.scaled_target(F.col("y")))
    return rows.select("case_id", F.round("scaled", 6).alias("z"), (F.abs(encode.unscaled_target(F.col("scaled")) - F.col("y")) < 0.001).alias("restored"))


@query(f"""WITH {CASES_SQL}, v AS (SELECT country AS value, row_number() OVER (ORDER BY min(case_id), country) AS place FROM cases WHERE split = 'train' AND country NOT IN ('NATION_4', 'NATION_3') GROUP BY country), t AS (SELECT count(*) AS n FROM v)
    SELECT case_id, CASE WHEN country = 'NATION_3' THEN n + 1 ELSE coalesce(place, n + 2) END AS place FROM cases CROSS JOIN t LEFT JOIN v ON value = country""")
def country_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dummy of each case's country in order of first appearance; one country is missing and one unseen in training here."""
    view = cases(spark, sf_dir).withColumn("country", F.when(F.col("country") != "NATION_3", F.col("country")))
    places = encode.first_seen(view.filter("split = 'train' and (country is null or country != 'NATION_4')"), "country", "case_id")
    return encode.dummy_place(view, places, "country").select("case_id", F.col("place_country").alias("place"))


@query(f"""WITH {CASES_SQL}, f AS (SELECT quantile_cont(acctbal, 0.5) AS m FROM cases WHERE split = 'train' AND acctbal >= 0)
    SELECT case_id, coalesce(CASE WHEN country <> 'NATION_3' THEN country END, '<MISSING>') AS country, round(CASE WHEN acctbal >= 0 THEN acctbal ELSE m END, 6) AS acctbal FROM cases CROSS JOIN f""")
def native_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories kept as such with a missing token, numbers filled with the training median."""
    view = cases(spark, sf_dir).withColumn("country", F.when(F.col("country") != "NATION_3", F.col("country"))).withColumn("acctbal", F.when(F.col("acctbal") >= 0, F.col("acctbal")))
    return encode.native_categories(view, view.filter("split = 'train'"), ["country"], ["acctbal"]).select("case_id", "country", F.round("acctbal", 6).alias("acctbal"))


@query(f"""WITH {CASES_SQL}, c AS (SELECT 'zero' AS name, 0.0e0 AS v UNION ALL SELECT 'mean', avg(y) FROM cases WHERE split = 'train' UNION ALL SELECT 'median', quantile_cont(y, 0.5) FROM cases WHERE split = 'train' UNION ALL SELECT 'p25', quantile_cont(y, 0.25) FROM cases WHERE split = 'train'),
    s AS (SELECT region, name, avg(abs(y - v)) AS mae, quantile_cont(abs(y - v), 0.5) AS medae FROM cases CROSS JOIN c WHERE split = 'validation' GROUP BY region, name)
    SELECT region, name, round(mae, 4) AS mae, round(medae, 4) AS medae FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY mae, medae, name) AS p FROM s) q WHERE p = 1""")
def selected_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of constant candidates fitted on training cases the best on validation cases, for each region."""
    view = cases(spark, sf_dir)
    fitted = view.filter("split = 'train'").agg(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("v")) for n, v in (("zero", F.lit(0.0)), ("mean", F.avg("y")), ("median", F.percentile("y", F.lit(0.5))), ("p25", F.percentile("y", F.lit(0.25))))]).alias("c"))
    rows = view.filter("split = 'validation'").crossJoin(F.broadcast(fitted)).select("region", "y", F.inline("c")).withColumnRenamed("v", "prediction")
    scored = metrics.regression_metrics(rows, ["region", "name"]).select("region", "name", "mae", "medae")
    return encode.best_candidate(scored, ["region"]).select("region", "name", F.round("mae", 4).alias("mae"), F.round("medae", 4).alias("medae"))


# priors as stored, pins, contracts


_SOURCE_SQL = "CASE WHEN country = 'NATION_3' AND case_id % 10 = 0 THEN NULL WHEN country = 'NATION_4' AND case_id % 10 = 0 THEN 'guess' WHEN y <= 0 THEN 'zero_reason' WHEN case_id % 2 = 0 THEN 'amount_direct' ELSE 'proxy_keep72' END"


@query(f"""WITH {CASES_SQL}, s AS (SELECT country, {_SOURCE_SQL} AS source FROM cases WHERE split = 'train'),
    b AS (SELECT country, count(*) AS sample_count, CASE WHEN NOT bool_and(coalesce(source, '') <> '') THEN 'unavailable_missing_y_source' WHEN NOT bool_and(source IN ('zero_reason', 'amount_direct', 'proxy_keep72')) THEN 'unavailable_unrecognized_y_source_values' ELSE 'available_from_supplied_y_source' END AS status,
                 count(CASE WHEN source = 'zero_reason' THEN 1 END) AS z, count(CASE WHEN source = 'amount_direct' THEN 1 END) AS a, count(CASE WHEN source = 'proxy_keep72' THEN 1 END) AS p FROM s GROUP BY country)
    SELECT country, sample_count, status, CASE WHEN status LIKE 'avail%' THEN z ELSE -1 END AS zero_reason_count, CASE WHEN status LIKE 'avail%' THEN a ELSE -1 END AS amount_direct_count, CASE WHEN status LIKE 'avail%' THEN p ELSE -1 END AS proxy_keep72_count FROM b""")
def prior_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the labels of each country's bucket come from (sources planted here); counts are -1 where not all are known."""
    rows = cases(spark, sf_dir).filter("split = 'train'").withColumn("source", F.expr(_SOURCE_SQL))
    status, counts = contract.provenance(F.col("source"))
    return rows.groupBy("country").agg(F.count("*").alias("sample_count"), status.alias("status"), *[F.coalesce(c, F.lit(-1)).cast("long").alias(f"{s}_count") for s, c in zip(contract.SOURCES, counts, strict=True)])


@query(f"""WITH {_TRAIN_SQL}, d AS ({_distribution_sql('train_articles', 'article')}) SELECT article, train_count AS sample_count, zero_rate, median, iqr, p10, p90 FROM d""")
def legacy_article_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older form of the article priors."""
    each = cases(spark, sf_dir).filter("split = 'train'").withColumn("article", F.explode("articles"))
    return priors.distribution(each, ["article"]).select("article", F.col("train_count").alias("sample_count"), "zero_rate", "median", "iqr", "p10", "p90")


@query("""WITH r AS (SELECT upper(trim(c_mktsegment)) AS k, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey END AS n, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS v, c_custkey AS o FROM customer)
    SELECT k AS segment, n AS sample_count, v AS median FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o DESC) AS p FROM r WHERE n > 0 AND v IS NOT NULL AND k <> '') q WHERE p = 1""")
def loaded_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table read back: keys normalised, unusable rows dropped, the last row of a key counts (faults planted here)."""
    i = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("segment"), F.when(i % 4 == 0, "0").otherwise(i.cast("string")).alias("sample_count"), F.when(i % 6 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("median"), i.alias("o"))
    return contract.clean_distribution(rows, ["segment"], ["median"], "sample_count", "o")


def _digest_sql(source: str, columns: str, field: str) -> str:
    return f"""SELECT '{field}' AS field, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(p || d, '' ORDER BY p)) AS digest FROM (
        SELECT substr(h, 1, 2) AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM (SELECT sha256(concat_ws(chr(31), {columns})) AS h FROM {source}) x GROUP BY 1) y"""


_PIN_SQL = " UNION ALL ".join(_digest_sql("pinned", columns, field) for field, columns in (
    ("ids", "case_id"), ("metadata", "case_id, country, arts, CAST(judgment_date AS VARCHAR)"), ("targets", "case_id, amount"), ("provenance", "case_id, source")))


def _pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).filter("split = 'train'").withColumn("source", F.expr(_SOURCE_SQL))
    return rows.withColumn("arts", F.coalesce(F.array_join("articles", ";"), F.lit(""))).withColumn("amount", F.round(F.col("y") * 10000).cast("long"))


@query(f"""WITH {CASES_SQL}, sets AS (SELECT case_id, string_agg(article, ';' ORDER BY article) AS arts FROM articles GROUP BY case_id),
    pinned AS (SELECT c.case_id, country, coalesce(arts, '') AS arts, judgment_date, CAST(round(y * 10000) AS BIGINT) AS amount, coalesce({_SOURCE_SQL.replace('case_id', 'c.case_id')}, '') AS source FROM cases c LEFT JOIN sets s ON s.case_id = c.case_id WHERE split = 'train') {_PIN_SQL}""")
def cohort_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four digests that pin the training cohort."""
    return contract.cohort_pin(_pinned(spark, sf_dir), "case_id", ["country", "arts", "judgment_date"], "amount", "source")


@query("SELECT 'ids' AS field, true AS same UNION ALL SELECT 'metadata', false UNION ALL SELECT 'targets', true UNION ALL SELECT 'provenance', true")
def prior_bundle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pinned cohort against one whose metadata changed since."""
    rows = _pinned(spark, sf_dir)
    pin = lambda df: contract.cohort_pin(df, "case_id", ["country", "arts", "judgment_date"], "amount", "source")
    return contract.pin_differences(pin(rows), pin(rows.withColumn("country", F.when(F.col("country") == "NATION_3", "NATION_5").otherwise(F.col("country")))))


@query(" UNION ALL ".join(_digest_sql(name, columns, name) for name, columns in (("region", "r_regionkey, r_name"), ("nation", "n_nationkey, n_name, n_regionkey"), ("supplier", "s_suppkey, s_name, s_nationkey"))))
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and digest of the dimension tables."""
    out = None
    for name, columns in (("region", ["r_regionkey", "r_name"]), ("nation", ["n_nationkey", "n_name", "n_regionkey"]), ("supplier", ["s_suppkey", "s_name", "s_nationkey"])):
        one = contract.set_digest(table(spark, sf_dir, name), columns).select(F.lit(name).alias("field"), "n", "digest")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {CASES_SQL}, n AS (SELECT count(*) AS a, count(CASE WHEN split = 'train' THEN 1 END) AS tr, count(CASE WHEN split = 'validation' THEN 1 END) AS va, count(CASE WHEN split = 'test' THEN 1 END) AS te,
        count(CASE WHEN test_view = 'ID' THEN 1 END) AS i, count(CASE WHEN test_view = 'OOD' THEN 1 END) AS o, count(CASE WHEN split = 'test' AND is_grand THEN 1 END) AS g FROM cases)
    SELECT 'splits' AS rule, a AS total, tr + va + te AS parts, a = tr + va + te AS ok FROM n UNION ALL SELECT 'views', te, i + o, te = i + o FROM n UNION ALL SELECT 'grand_is_not_all', te, g, te = g FROM n""")
def release_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by split and view, and whether they add up."""
    view = cases(spark, sf_dir)
    names = F.array_compact(F.array(F.lit("all"), F.col("split"), F.col("test_view"), F.when((F.col("split") == "test") & F.col("is_grand"), "grand")))
    counts = view.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return contract.reconciled(counts, {"splits": ("all", ["train", "validation", "test"]), "views": ("test", ["ID", "OOD"]), "grand_is_not_all": ("test", ["grand"])})


@query(f"""WITH {CASES_SQL}, f AS (SELECT case_id, row_number() OVER (ORDER BY case_id) AS o FROM cases WHERE split = 'validation'), t AS (SELECT case_id, CASE WHEN case_id % 29 = 0 THEN o + 1 ELSE o END AS o, CASE WHEN case_id % 31 = 0 THEN -1 ELSE y END AS v, CASE WHEN case_id % 37 = 0 THEN 1 ELSE CAST(y > 0 AS INTEGER) END AS b
        FROM (SELECT case_id, y, row_number() OVER (ORDER BY case_id) AS o FROM cases WHERE split = 'validation') x WHERE case_id % 23 <> 0),
    j AS (SELECT f.case_id AS a, t.case_id AS b, f.o AS oa, t.o AS ob, v, t.b AS y FROM f FULL OUTER JOIN t ON f.case_id = t.case_id)
    SELECT 'feature_without_target' AS rule, count(*) AS n FROM j WHERE b IS NULL HAVING count(*) > 0 UNION ALL SELECT 'order', count(*) FROM j WHERE oa <> ob HAVING count(*) > 0
    UNION ALL SELECT 'target_not_sound', count(*) FROM j WHERE v < 0 HAVING count(*) > 0 UNION ALL SELECT 'binary', count(*) FROM j WHERE v >= 0 AND y <> CAST(v > 0 AS INTEGER) HAVING count(*) > 0""")
def split_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and targets of the validation split held side by side (faults planted here)."""
    from pyspark.sql import Window

    i = F.col("case_id")
    rows = cases(spark, sf_dir).filter("split = 'validation'").select("case_id", "y", F.row_number().over(Window.partitionBy("split").orderBy("case_id")).cast("long").alias("o"))
    targets = rows.filter(i % 23 != 0).select("case_id", F.when(i % 29 == 0, F.col("o") + 1).otherwise(F.col("o")).alias("o"), F.when(i % 31 == 0, -1.0).otherwise(F.col("y")).alias("v"), F.when(i % 37 == 0, 1).otherwise((F.col("y") > 0).cast("int")).alias("b"))
    return contract.alignment(rows, targets, "case_id", "o", "v", "b")


# harvests


@query("""WITH p AS (SELECT event_id // 50 AS page, event_id, user_id, CASE WHEN event_id % 977 = 0 THEN 'changed' ELSE event_type END AS t2, event_type AS t1 FROM events), n AS (SELECT page, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, bool_or(t1 <> t2) AS changed FROM p GROUP BY page),
    w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, lag(last_id) OVER (ORDER BY page) AS before FROM n)
    SELECT page, n, CAST(start AS BIGINT) AS start, start = page * 50 AS continuous, coalesce(first_id > before, true) AS ordered, NOT changed AS verified FROM w""")
def harvest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a harvest: do they follow one another, do ids ascend, does a second pass find the same (changes planted here)."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor(F.col("event_id") / 50).cast("long").alias("page"))
    again = rows.withColumn("event_type", F.when(F.col("event_id") % 977 == 0, "changed").otherwise(F.col("event_type")))
    first = harvest.pages(rows, "page", "event_id", ["user_id", "event_type"])
    checked = harvest.continuity(first.withColumn("expected_start", F.col("page") * 50))
    second = harvest.verified(first, harvest.pages(again, "page", "event_id", ["user_id", "event_type"]))
    return checked.join(second, "page").select("page", "n", "start", "continuous", "ordered", "verified")


@query("""SELECT CASE WHEN event_id % 10 < 6 THEN 'keep' WHEN event_id % 10 < 8 THEN 'roll_forward' ELSE 'discard' END AS action, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1""")
def journal_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each row of batches that a journal knows as committed, as prepared, or not at all."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 10).alias("batch"))
    journal = spark.range(8).select(F.col("id").alias("batch"), F.explode(F.when(F.col("id") < 6, F.array(F.lit("prepared"), F.lit("committed"))).otherwise(F.array(F.lit("prepared")))).alias("state"))
    return harvest.recovery(rows, journal, "batch").groupBy("action").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("""SELECT CASE WHEN coalesce(trim(props), '') = '' AND coalesce(trim(new), '') = '' THEN 'empty' WHEN coalesce(trim(new), '') = '' THEN 'became_empty' WHEN coalesce(trim(props), '') = '' THEN 'became_non_empty' WHEN props = new THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS n
    FROM (SELECT CASE WHEN event_id % 5 = 0 THEN '' ELSE props END AS props, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN props || ' ' ELSE props END AS new FROM events) q GROUP BY 1""")
def backfill_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a backfill of a column did, by kind of change."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(i % 5 == 0, "").otherwise(F.col("props")).alias("old"), F.when(i % 7 == 0, F.lit(None)).when(i % 3 == 0, F.concat("props", F.lit(" "))).otherwise(F.col("props")).alias("new"))
    return rows.groupBy(harvest.change(F.col("old"), F.col("new")).alias("change")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, count(*) AS n, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM events WHERE event_id % 9 <> 0 AND event_type <> 'view' GROUP BY user_id""")
def problem_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines grouped by item in order of time; lines that are no JSON objects are skipped (planted here)."""
    e = table(spark, sf_dir, "events").filter("event_type != 'view'")
    line = F.to_json(F.struct(F.col("user_id").alias("itemid"), F.unix_micros(F.to_timestamp("ts")).alias("ts"), F.col("event_id").alias("no"), F.col("event_type").alias("problem")))
    lines = e.select(F.when(F.col("event_id") % 9 == 0, F.substring(line, 1, 20)).otherwise(line).alias("line"))
    found = harvest.problems(lines, "line")
    return found.select(F.col("itemid").cast("long").alias("user_id"), F.size("records").cast("long").alias("n"), F.array_join(F.transform("records", lambda r: r["problem"]), ">").alias("path"))


@query("""SELECT source, count(*) AS docs, count(CASE WHEN text LIKE '%' || chr(10) || chr(10) || '%' THEN 1 END) AS with_paragraphs, count(CASE WHEN length(text) > 4000 THEN 1 END) AS long_docs,
    CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, round(CAST(count(quality) AS DOUBLE) / count(*), 6) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: documents, features present, token estimate, and the share with a label."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(
        F.count("*").alias("docs"), F.count_if(F.contains("text", F.lit("\n\n"))).alias("with_paragraphs"), F.count_if(F.length("text") > 4000).alias("long_docs"), F.sum(F.ceil(F.length("text") / 4)).cast("long").alias("tokens"),
        F.round(F.count("quality") / F.count("*"), 6).alias("coverage"),
    )


@query("""SELECT role AS stage, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS characters, count(CASE WHEN length(text) = 0 OR text IS NULL THEN 1 END) AS empty, count(DISTINCT conv_id) AS runs FROM conversations GROUP BY role""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use by stage: calls, characters, empty answers and runs."""
    return table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("stage")).agg(F.count("*").alias("calls"), F.sum(F.length("text")).cast("long").alias("characters"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("empty"), F.countDistinct("conv_id").alias("runs"))


@query(f"""WITH {CASES_SQL}, p AS (SELECT a.case_id, sum(a.amount4) AS s FROM amounts a WHERE l_returnflag = 'R' GROUP BY a.case_id), r AS (SELECT case_id, split, test_view, judgment_date, CAST(n_articles AS BIGINT) AS n FROM cases)
    SELECT 'allocations_over_target' AS rule, count(*) AS n FROM p JOIN cases ON p.case_id = cases.case_id WHERE s > CAST(round(y * 10000) AS BIGINT) UNION ALL SELECT 'view_outside_test', count(*) FROM r WHERE split <> 'test' AND test_view IS NOT NULL UNION ALL SELECT 'no_articles', count(*) FROM r WHERE n = 0""")
def package_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-table checks of a release, counted whether broken or not."""
    view = cases(spark, sf_dir)
    sums = amounts(spark, sf_dir).filter("l_returnflag = 'R'").groupBy("case_id").agg(F.sum("amount4").alias("s"))
    over = view.join(sums, "case_id").agg(F.count_if(F.col("s") > F.round(F.col("y") * 10000).cast("long")).alias("n")).select(F.lit("allocations_over_target").alias("rule"), "n")
    rows = view.agg(F.count_if((F.col("split") != "test") & F.col("test_view").isNotNull()).alias("a"), F.count_if(F.col("n_articles") == 0).alias("b"))
    return over.unionByName(rows.select(F.inline(F.array(F.struct(F.lit("view_outside_test").alias("rule"), F.col("a").alias("n")), F.struct(F.lit("no_articles").alias("rule"), F.col("b").alias("n"))))))
