"""Queries over the driver's tables for the engine's operators, each beside the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.functions import normalize as N
from casewright.functions import text as X
from casewright.operators import contract, encode, metrics, priors, ranking, retrieval, validate
from casewright.plans.cases import CASES_SQL, amounts, articles, cases, table
from casewright.session import kept
from casewright.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Every so many ids is a target of the nearest-neighbour queries (of ``knn_predictions`` all are); the references are all training cases.
TARGET_STEP = 50
FEATURES = ["acctbal", "n_applicants", "n_articles"]


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _targets(all_cases: DataFrame) -> DataFrame:
    return all_cases.filter(f"case_id % {TARGET_STEP} = 0")


def _sides(spark: SparkSession, sf_dir: str, every: int = TARGET_STEP) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """Targets (every so many ids, or with 1 all cases), training references, and about how many there are (from the orders' file footers)."""
    view, n = kept(cases(spark, sf_dir)), table(spark, sf_dir, "orders").count()
    return view if every == 1 else _targets(view), view.filter("split = 'train'"), (n // every, n)


def _pairs_sql(every: int = TARGET_STEP) -> str:
    """Pairs, scores and predictions of the targets: every so many ids, or with 1 all cases."""
    a, c = ("", "") if every == 1 else (f"a.case_id % {every} = 0 AND ", f" WHERE c.case_id % {every} = 0")
    return f"""{CASES_SQL},
    pairs AS (
        SELECT a.case_id AS target_id, b.case_id AS ref_id, count(*) AS shared
        FROM articles a JOIN articles b ON a.article = b.article
        JOIN cases t ON t.case_id = a.case_id JOIN cases r ON r.case_id = b.case_id
        WHERE {a}r.split = 'train' AND r.judgment_date < t.judgment_date AND a.case_id <> b.case_id
        GROUP BY a.case_id, b.case_id),
    scored AS (
        SELECT target_id, ref_id, shared, t.y AS t_y, r.y AS r_y, {retrieval.SIMILARITY_SQL} AS score
        FROM pairs JOIN cases t ON t.case_id = target_id JOIN cases r ON r.case_id = ref_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, ref_id) AS rank FROM scored),
    near AS (SELECT target_id, quantile_cont(r_y, 0.5) AS near, count(*) AS neighbors FROM ranked WHERE rank <= 20 GROUP BY target_id),
    middle AS (SELECT quantile_cont(y, 0.5) AS middle FROM cases WHERE split = 'train'),
    predicted AS (
        SELECT c.case_id, c.split, c.test_view, c.is_grand OR (c.n_applications > 1 AND c.n_articles > 1) AS challenging, c.y, coalesce(neighbors, 0) AS neighbors,
               coalesce(near, (SELECT middle FROM middle)) AS prediction,
               CASE WHEN neighbors IS NULL THEN '{retrieval.FALLBACK}' ELSE '' END AS fallback_reason
        FROM cases c LEFT JOIN near ON near.target_id = c.case_id{c})"""


_PAIRS_SQL = _pairs_sql()


def _predicted(spark: SparkSession, sf_dir: str, every: int = TARGET_STEP) -> DataFrame:
    targets, train, sizes = _sides(spark, sf_dir, every)
    out = retrieval.neighbour_medians(targets, retrieval.nearest(targets, train, sizes), train)
    hard = N.challenging(F.col("is_grand"), F.col("n_applications"), F.col("n_articles"))
    return out.select("case_id", "split", "test_view", hard.alias("challenging"), "y", "neighbors", "prediction", "fallback_reason")


@query(f"WITH {_pairs_sql(1)} SELECT case_id, split, y, neighbors, round(prediction, 5) AS prediction, fallback_reason FROM predicted")
def knn_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every case the median outcome of the 20 most similar earlier training cases that share an article."""
    return _predicted(spark, sf_dir, 1).select("case_id", "split", "y", "neighbors", F.round("prediction", 5).alias("prediction"), "fallback_reason")


_SLICES_SQL = """sliced AS (
        SELECT 'all' AS slice, * FROM predicted UNION ALL SELECT test_view AS slice, * FROM predicted WHERE test_view IS NOT NULL
        UNION ALL SELECT 'Challenging' AS slice, * FROM predicted WHERE challenging)"""


@query(f"""WITH {_PAIRS_SQL}, {_SLICES_SQL}
    SELECT slice, count(*) AS n, round(avg(abs(prediction - y)), 4) AS mae, round(sqrt(avg((prediction - y) * (prediction - y))), 4) AS rmse,
           round(quantile_cont(abs(prediction - y), 0.5), 4) AS medae, round(quantile_cont(abs(prediction - y), 0.95), 4) AS p95ae,
           round(CASE WHEN sum(y * y) - count(*) * avg(y) * avg(y) > 1e-9 THEN 1 - sum((prediction - y) * (prediction - y)) / (sum(y * y) - count(*) * avg(y) * avg(y)) ELSE 0 END, 4) AS r2,
           count(CASE WHEN y > 0.5 THEN 1 END) AS n_positive,
           round(coalesce(avg(CASE WHEN y > 0.5 THEN abs(prediction - y) END), 0), 4) AS mae_positive_only,
           round(coalesce(100 * avg(CASE WHEN y > 0.5 THEN abs(prediction - y) / (y + 1) END), 0), 4) AS mape
    FROM sliced GROUP BY slice""")
def metrics_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the nearest-neighbour predictions for overlapping slices, over the targets (every ``TARGET_STEP``-th id)."""
    out = metrics.regression_metrics(metrics.slices(_predicted(spark, sf_dir)), ["slice"])
    return out.select("slice", "n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "medae", "p95ae", "r2")], "n_positive", *[F.round(c, 4).alias(c) for c in ("mae_positive_only", "mape")])


@query(f"""WITH {_PAIRS_SQL}, {_SLICES_SQL},
    c AS (SELECT slice, count(CASE WHEN y > 0.5 AND prediction > 0.5 THEN 1 END) AS tp, count(CASE WHEN y <= 0.5 AND prediction > 0.5 THEN 1 END) AS fp,
                 count(CASE WHEN y > 0.5 AND prediction <= 0.5 THEN 1 END) AS fn, count(CASE WHEN y <= 0.5 AND prediction <= 0.5 THEN 1 END) AS tn FROM sliced GROUP BY slice)
    SELECT slice, tp, fp, fn, tn, round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy,
           round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END, 6) AS precision,
           round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END, 6) AS recall,
           round(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
           round(CASE WHEN 2 * tn + fp + fn > 0 THEN CAST(2 * tn AS DOUBLE) / (2 * tn + fp + fn) ELSE 0 END, 6) AS zero_f1 FROM c""")
def zero_award_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an outcome is zero, as predicted, by slice, over the targets (every ``TARGET_STEP``-th id)."""
    out = metrics.zero_metrics(metrics.slices(_predicted(spark, sf_dir)), ["slice"])
    return out.select("slice", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "zero_f1")])


@query(f"""WITH {CASES_SQL},
    r AS (SELECT split, acctbal, y, rank() OVER (PARTITION BY split ORDER BY acctbal) + (count(*) OVER (PARTITION BY split, acctbal) - 1) / 2.0 AS rx,
                 rank() OVER (PARTITION BY split ORDER BY y) + (count(*) OVER (PARTITION BY split, y) - 1) / 2.0 AS ry FROM cases)
    SELECT split, round(corr(acctbal, y), 6) AS pearson, round(corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)), 6) AS spearman FROM r GROUP BY split""")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson and Spearman (average ranks of ties) by split."""
    rows = cases(spark, sf_dir).select("split", "acctbal", "y")
    both = metrics.pearson(rows, ["split"], "acctbal", "y").join(metrics.spearman(rows, ["split"], "acctbal", "y"), "split")
    return both.select("split", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query(f"""WITH {CASES_SQL} SELECT 'zero' AS baseline, 0.0e0 AS value UNION ALL SELECT 'median', quantile_cont(y, 0.5) FROM cases WHERE split = 'train'
    UNION ALL SELECT 'mean', round(avg(y), 6) FROM cases WHERE split = 'train' UNION ALL SELECT 'positive_median', quantile_cont(y, 0.5) FROM cases WHERE split = 'train' AND y > 0
    UNION ALL SELECT 'positive_mean', round(avg(y), 6) FROM cases WHERE split = 'train' AND y > 0""")
def constant_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants fitted on training cases, in one aggregation."""
    y, some = F.col("y"), F.when(F.col("y") > 0, F.col("y"))
    parts = {"zero": F.lit(0.0), "median": F.percentile(y, F.lit(0.5)), "mean": F.round(F.avg(y), 6), "positive_median": F.percentile(some, F.lit(0.5)), "positive_mean": F.round(F.avg(some), 6)}
    one = cases(spark, sf_dir).filter("split = 'train'").agg(*[v.alias(k) for k, v in parts.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("baseline"), F.col(k).alias("value")) for k in parts])))


@query(f"""WITH {CASES_SQL}, edges AS (SELECT case_id, split, y, CASE WHEN y >= 100000 THEN 4 WHEN y >= 50000 THEN 3 WHEN y >= 10000 THEN 2 WHEN y >= 0.5 THEN 1 ELSE 0 END AS bin,
           CASE WHEN n_applicants * 25000.0e0 >= 100000 THEN 4 WHEN n_applicants * 25000.0e0 >= 50000 THEN 3 WHEN n_applicants * 25000.0e0 >= 10000 THEN 2 WHEN n_applicants * 25000.0e0 >= 0.5 THEN 1 ELSE 0 END AS guess FROM cases)
    SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, round(avg(CASE WHEN bin = guess THEN 1.0e0 ELSE 0.0e0 END), 6) AS recall, round(avg(CASE WHEN abs(bin - guess) <= 1 THEN 1.0e0 ELSE 0.0e0 END), 6) AS within_1,
           round(avg(CASE WHEN abs(bin - guess) <= 2 THEN 1.0e0 ELSE 0.0e0 END), 6) AS within_2 FROM edges GROUP BY bin""")
def ordinal_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount bins against a guess from the number of applicants."""
    edges = [0.5, 10_000.0, 50_000.0, 100_000.0]
    rows = cases(spark, sf_dir).select(metrics.digitize(F.col("y"), edges).alias("bin"), metrics.digitize(F.col("n_applicants") * 25_000.0, edges).alias("guess"))
    near = lambda k: F.round(F.avg((F.abs(F.col("bin") - F.col("guess")) <= k).cast("double")), 6)
    return rows.groupBy("bin").agg(F.count("*").alias("n"), near(0).alias("recall"), near(1).alias("within_1"), near(2).alias("within_2"))


def _distribution_sql(source: str, keys: str) -> str:
    part = lambda q: f"round(coalesce(quantile_cont(CASE WHEN y > 0 THEN y END, {q}), quantile_cont(y, {q})), 6)"
    return f"""SELECT {keys}, count(*) AS train_count, count(CASE WHEN y > 0 THEN 1 END) AS positive_count, count(CASE WHEN y <= 0 THEN 1 END) AS zero_count,
        round(CAST(count(CASE WHEN y <= 0 THEN 1 END) AS DOUBLE) / count(*), 6) AS zero_rate, {part(0.5)} AS median, {part(0.25)} AS p25, {part(0.75)} AS p75, {part(0.1)} AS p10, {part(0.9)} AS p90,
        round(quantile_cont(y, 0.5), 6) AS median_all, round({part(0.75)} - {part(0.25)}, 6) AS iqr FROM {source} GROUP BY {keys}"""


_TRAIN_SQL = f"{CASES_SQL}, train AS (SELECT * FROM cases WHERE split = 'train'), train_articles AS (SELECT train.*, article FROM train JOIN articles ON train.case_id = articles.case_id)"


@query(f"WITH {_TRAIN_SQL} {_distribution_sql('train_articles', 'article')}")
def prior_by_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome distribution of training cases by article."""
    train = cases(spark, sf_dir).filter("split = 'train'")
    return priors.distribution(train.withColumn("article", F.explode("articles")), ["article"])


@query(f"WITH {_TRAIN_SQL} {_distribution_sql('train', 'country')}")
def prior_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By country, each case once (not on the exploded relation)."""
    return priors.distribution(cases(spark, sf_dir).filter("split = 'train'"), ["country"])


@query(f"WITH {_TRAIN_SQL} {_distribution_sql('train_articles', 'article, country')}")
def prior_by_article_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = cases(spark, sf_dir).filter("split = 'train'")
    return priors.distribution(train.withColumn("article", F.explode("articles")), ["article", "country"])


@query(f"""WITH {_TRAIN_SQL}, ac AS ({_distribution_sql('train_articles', 'article, country')}), a AS ({_distribution_sql('train_articles', 'article')}), c AS ({_distribution_sql('train', 'country')}),
    g AS (SELECT sum(train_count) AS n, round(sum(median * train_count) / sum(train_count), 6) AS median FROM a),
    wanted AS (SELECT case_id, country, (SELECT min(article) FROM articles WHERE articles.case_id = cases.case_id) AS article FROM cases WHERE split = 'test')
    SELECT w.case_id, CASE WHEN ac.train_count >= 50 THEN 'article_country' WHEN a.train_count >= 50 THEN 'article' WHEN c.train_count >= 50 THEN 'country' WHEN g.n >= 50 THEN 'global'
                WHEN g.n IS NOT NULL THEN 'global' WHEN c.train_count IS NOT NULL THEN 'country' WHEN a.train_count IS NOT NULL THEN 'article' WHEN ac.train_count IS NOT NULL THEN 'article_country' END AS level,
           round(CASE WHEN ac.train_count >= 50 THEN ac.median WHEN a.train_count >= 50 THEN a.median WHEN c.train_count >= 50 THEN c.median ELSE g.median END, 5) AS median
    FROM wanted w LEFT JOIN ac ON ac.article = w.article AND ac.country = w.country LEFT JOIN a ON a.article = w.article LEFT JOIN c ON c.country = w.country CROSS JOIN g""")
def prior_back_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most specific prior with support for each test case's first article and country."""
    view = cases(spark, sf_dir)
    train = view.filter("split = 'train'")
    each = train.withColumn("article", F.explode("articles"))
    ac, a, c = priors.distribution(each, ["article", "country"]), priors.distribution(each, ["article"]), priors.distribution(train, ["country"])
    g = priors.weighted_global(a, ["median"])
    short = lambda df, keys, p: df.select(*keys, F.col("train_count").alias(f"{p}_n"), F.col("median").alias(f"{p}_m"))
    rows = view.filter("split = 'test'").select("case_id", "country", F.get("articles", F.lit(0)).alias("article"))
    rows = rows.join(short(ac, ["article", "country"], "ac"), ["article", "country"], "left").join(short(a, ["article"], "a"), ["article"], "left").join(short(c, ["country"], "c"), ["country"], "left")
    rows = rows.crossJoin(F.broadcast(short(g, [], "g")))  # one row
    levels = [(name, F.col(f"{p}_m"), F.col(f"{p}_n")) for name, p in (("article_country", "ac"), ("article", "a"), ("country", "c"), ("global", "g"))]
    name, value, _ = priors.back_off(levels, 50)
    return rows.select("case_id", name.alias("level"), F.round(value, 5).alias("median"))


_BAND_SQL = "CASE WHEN n_applicants <= 1 THEN '1' WHEN n_applicants <= 5 THEN '2-5' WHEN n_applicants <= 20 THEN '6-20' WHEN n_applicants <= 100 THEN '21-100' ELSE '100+' END"


@query(f"""WITH {_TRAIN_SQL} SELECT {_BAND_SQL} AS band, count(*) AS n, count(CASE WHEN y > 0 THEN 1 END) AS n_positive, round(quantile_cont(y, 0.5), 6) AS p50, round(quantile_cont(y, 0.9), 6) AS p90,
    round(quantile_cont(CASE WHEN y > 0 THEN y END, 0.5), 6) AS positive_p50,
    coalesce(round(quantile_cont(y, 0.9), 6) > 1.5 * (SELECT quantile_cont(y, 0.9) FROM train WHERE n_applicants <= 1), false) AS scale_flag FROM train GROUP BY 1""")
def aggregation_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By band of applicants, with a flag where the 90th percentile is over 1.5 times that of single cases."""
    train = cases(spark, sf_dir).filter("split = 'train'")
    single = train.filter("n_applicants <= 1").agg(F.percentile("y", F.lit(0.9)).alias("single"))
    out = train.groupBy(N.count_band(F.col("n_applicants")).alias("band")).agg(
        F.count("*").alias("n"), F.count_if(F.col("y") > 0).alias("n_positive"), F.round(F.percentile("y", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("y", F.lit(0.9)), 6).alias("p90"),
        F.round(F.percentile(F.when(F.col("y") > 0, F.col("y")), F.lit(0.5)), 6).alias("positive_p50"),
    )
    return out.crossJoin(F.broadcast(single)).withColumn("scale_flag", F.coalesce(F.col("p90") > 1.5 * F.col("single"), F.lit(False))).drop("single")


_STEPS_SQL = ["shared = t.n_articles AND shared = r.n_articles", "t.country = r.country", "t.region = r.region", "t.formation = r.formation", "t.importance = r.importance", "t.judgment_date - r.judgment_date <= 1825"]


def _cascade_sql() -> str:
    out, prior = [f"s0 AS (SELECT p.target_id, p.ref_id, r.y AS r_y, {retrieval.SIMILARITY_SQL} AS score, {', '.join(f'({c}) AS c{i}' for i, c in enumerate(_STEPS_SQL))}, true AS active FROM pairs p JOIN cases t ON t.case_id = p.target_id JOIN cases r ON r.case_id = p.ref_id)"], "s0"
    for i in range(len(_STEPS_SQL)):
        need = "> 0" if i < 2 else ">= 30"
        out.append(f"s{i + 1} AS (SELECT target_id, ref_id, r_y, score, {', '.join(f'c{k}' for k in range(len(_STEPS_SQL)))}, CASE WHEN sum(CASE WHEN active AND c{i} THEN 1 ELSE 0 END) OVER (PARTITION BY target_id) {need} THEN active AND c{i} ELSE active END AS active FROM {prior})")
        prior = f"s{i + 1}"
    return ", ".join(out) + f", left_over AS (SELECT * FROM {prior} WHERE active)"


@query(f"""WITH {_PAIRS_SQL}, {_cascade_sql()}
    SELECT target_id, count(*) AS n, min(ref_id) AS first_ref, max(ref_id) AS last_ref, round(quantile_cont(r_y, 0.5), 5) AS median FROM left_over GROUP BY target_id""")
def reference_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References left after narrowing by conditions in turn, each kept only with enough support."""
    return retrieval.narrowed(*_sides(spark, sf_dir)).groupBy("target_id").agg(F.count("*").alias("n"), F.min("ref_id").alias("first_ref"), F.max("ref_id").alias("last_ref"), F.round(F.percentile("r_y", F.lit(0.5)), 5).alias("median"))


@query(f"""WITH {_PAIRS_SQL}, {_cascade_sql()},
    o AS (SELECT *, r_y > 0 AS positive, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, ref_id) AS overall, row_number() OVER (PARTITION BY target_id, r_y > 0 ORDER BY score DESC, ref_id) AS own FROM left_over),
    u AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY CASE WHEN positive AND own <= 4 THEN 0 WHEN NOT positive AND own <= 4 THEN 1 ELSE 2 END, overall) AS turn FROM o)
    SELECT target_id, ref_id, r_y AS amount, row_number() OVER (PARTITION BY target_id ORDER BY overall) AS rank FROM u WHERE turn <= 8""")
def balanced_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight references a target, half positive and half zero where there are enough."""
    out = ranking.balanced(retrieval.narrowed(*_sides(spark, sf_dir), per_class=8), ["target_id"], F.col("r_y") > 0, [F.desc("score"), F.asc("ref_id")], 8)
    return out.select("target_id", "ref_id", F.col("r_y").alias("amount"), F.col("rank").cast("long").alias("rank"))


@query("""WITH e AS (SELECT vec_id, label, embedding FROM embeddings), p AS (
        SELECT t.vec_id AS target_id, r.vec_id AS ref_id, r.label AS label, list_sum(list_transform(range(1, 65), lambda i: CAST(t.embedding[i] AS DOUBLE) * CAST(r.embedding[i] AS DOUBLE)))
               / greatest(sqrt(list_sum(list_transform(t.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(r.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 1e-12) AS score
        FROM e t JOIN e r ON t.label = r.label AND r.vec_id < t.vec_id WHERE t.vec_id % 50 = 0)
    SELECT target_id, ref_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(score, 9) DESC, ref_id) AS rank FROM p) q WHERE rank <= 5""")
def dense_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine neighbours among earlier vectors of the same label."""
    rows = table(spark, sf_dir, "embeddings")
    t = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("target_id"), "label", F.col("embedding").alias("a"))
    r = rows.select(F.col("vec_id").alias("ref_id"), "label", F.col("embedding").alias("b"))
    scored = t.join(r, "label").filter("ref_id < target_id").select("target_id", "ref_id", retrieval.cosine(F.col("a"), F.col("b")).alias("score"))
    out = ranking.top_k(scored, ["target_id"], [F.desc(F.round("score", 9)), F.asc("ref_id")], 5)
    return out.select("target_id", "ref_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH dt AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM documents) x WHERE term <> '' GROUP BY doc_id, term),
    qt AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM benchmark) x WHERE term <> ''),
    dl AS (SELECT id, sum(tf) AS dl FROM dt GROUP BY id), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    df AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
    s AS (SELECT query_id, dt.id, sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score
          FROM qt JOIN dt ON dt.term = qt.term JOIN df ON df.term = dt.term JOIN dl ON dl.id = dt.id CROSS JOIN st GROUP BY query_id, dt.id)
    SELECT query_id, id AS doc_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 7) DESC, id) AS rank FROM s) q WHERE rank <= 5""")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries against all documents."""
    scored = retrieval.bm25(retrieval.terms(table(spark, sf_dir, "documents"), "doc_id", "text"), retrieval.terms(table(spark, sf_dir, "benchmark"), "item_id", "text"))
    out = ranking.top_k(scored, ["query_id"], [F.desc(F.round("score", 7)), F.asc("id")], 5)
    return out.select("query_id", F.col("id").alias("doc_id"), F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {CASES_SQL},
    m AS (SELECT quantile_cont(CASE WHEN acctbal >= 0 THEN acctbal END, 0.5) AS a FROM cases WHERE split = 'train'),
    f AS (SELECT case_id, split, coalesce(CASE WHEN acctbal >= 0 THEN acctbal END, (SELECT a FROM m)) AS acctbal, CAST(n_applicants AS DOUBLE) AS n_applicants, CAST(n_articles AS DOUBLE) AS n_articles FROM cases),
    s AS (SELECT avg(acctbal) AS a1, stddev_pop(acctbal) AS s1, avg(n_applicants) AS a2, stddev_pop(n_applicants) AS s2, avg(n_articles) AS a3, stddev_pop(n_articles) AS s3 FROM f WHERE split = 'train'),
    v AS (SELECT DISTINCT importance FROM cases WHERE split = 'train' UNION SELECT '__MISSING__'),
    p AS (SELECT importance, row_number() OVER (ORDER BY importance) AS place FROM v)
    SELECT f.case_id, round((f.acctbal - a1) / s1, 6) AS z_acctbal, round((f.n_applicants - a2) / s2, 6) AS z_n_applicants, round((f.n_articles - a3) / s3, 6) AS z_n_articles, place AS importance_place
    FROM f CROSS JOIN s JOIN cases ON cases.case_id = f.case_id LEFT JOIN p ON p.importance = cases.importance""")
def encoded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers scaled and a category encoded by what training cases show; negative balances count as unknown."""
    view = cases(spark, sf_dir).withColumn("acctbal", F.when(F.col("acctbal") >= 0, F.col("acctbal")))
    train = view.filter("split = 'train'")
    out = encode.one_hot(encode.standardise(view, encode.fit_numeric(train, FEATURES), FEATURES), encode.vocabulary(train, "importance"), "importance")
    return out.select("case_id", *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in FEATURES], F.nullif(F.array_position("hot_importance", 1), F.lit(0)).cast("long").alias("importance_place"))


@query(f"""WITH {CASES_SQL},
    s AS (SELECT avg(CAST(n_applicants AS DOUBLE)) AS a2, stddev_pop(CAST(n_applicants AS DOUBLE)) AS s2, avg(CAST(n_articles AS DOUBLE)) AS a3, stddev_pop(CAST(n_articles AS DOUBLE)) AS s3 FROM cases WHERE split = 'train'),
    f AS (SELECT case_id, judgment_date, split, y, (n_applicants - a2) / s2 AS x, (n_articles - a3) / s3 AS z FROM cases CROSS JOIN s),
    pairs AS (SELECT DISTINCT a.case_id AS target_id, b.case_id AS ref_id FROM articles a JOIN articles b ON a.article = b.article WHERE a.case_id % {TARGET_STEP} = 0),
    d AS (SELECT target_id, ref_id, r.y, sqrt((t.x - r.x) * (t.x - r.x) + (t.z - r.z) * (t.z - r.z)) AS distance FROM pairs JOIN f t ON t.case_id = target_id JOIN f r ON r.case_id = ref_id
          WHERE r.split = 'train' AND r.judgment_date < t.judgment_date AND target_id <> ref_id)
    SELECT target_id, count(*) AS neighbors, round(quantile_cont(y, 0.5), 5) AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(distance, 9), ref_id) AS rank FROM d) q WHERE rank <= 20 GROUP BY target_id""")
def tabular_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euclidean neighbours over scaled features."""
    targets, train, sizes = _sides(spark, sf_dir)
    names = ["n_applicants", "n_articles"]
    stats = encode.fit_numeric(train, names)
    scaled = [encode.standardise(side, stats, names) for side in (targets, train)]
    scored = retrieval.nearest_by_features(*scaled, [f"z_{c}" for c in names], sizes, grid=True)
    near = ranking.top_k(scored, ["target_id"], [F.asc(F.round("distance", 9)), F.asc("ref_id")], 20)
    return near.groupBy("target_id").agg(F.count("*").alias("neighbors"), F.round(F.percentile("r_y", F.lit(0.5)), 5).alias("prediction"))


@query(f"""WITH {CASES_SQL}, v AS (
        SELECT 'negative_balance' AS rule, case_id FROM cases WHERE acctbal < 0 UNION ALL SELECT 'no_applicants', case_id FROM cases WHERE n_applicants = 0
        UNION ALL SELECT 'zero_award_with_articles', case_id FROM cases WHERE y <= 0 AND n_articles > 3
        UNION ALL SELECT 'duplicate_applicant', case_id FROM (SELECT case_id, l_linenumber FROM amounts GROUP BY case_id, l_linenumber HAVING count(*) > 1) d)
    SELECT rule, count(*) AS n FROM v GROUP BY rule""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row rules and key rules of the two tables, counted by rule."""
    rules = {"negative_balance": F.col("acctbal") < 0, "no_applicants": F.col("n_applicants") == 0, "zero_award_with_articles": (F.col("y") <= 0) & (F.col("n_articles") > 3)}
    found = validate.violations(cases(spark, sf_dir), "case_id", rules).unionByName(validate.duplicates(amounts(spark, sf_dir), ["case_id", "l_linenumber"], "duplicate_applicant"))
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS a FROM orders), b AS (SELECT c_custkey AS b FROM customer)
    SELECT CASE WHEN b IS NULL THEN 'left_only' WHEN a IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*) AS n, min(coalesce(a, b)) AS first_id FROM a FULL OUTER JOIN b ON a = b GROUP BY 1""")
def id_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with and without orders, both ways at once."""
    return validate.id_difference(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "o_custkey", "c_custkey")


@query(f"""WITH {CASES_SQL}, r AS (SELECT case_id, CASE WHEN is_grand THEN 'grand_chamber' END AS g, CASE WHEN n_applications > 1 AND n_articles > 1 THEN 'multiple_applications_and_articles' END AS m FROM cases WHERE split = 'test')
    SELECT concat_ws(';', g, m) AS reason, count(*) AS n, min(case_id) AS first_id, max(case_id) AS last_id FROM r WHERE g IS NOT NULL OR m IS NOT NULL GROUP BY 1""")
def challenging_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test cases of the hard view by reason."""
    flags = [F.col("is_grand"), F.col("n_applications"), F.col("n_articles")]
    rows = cases(spark, sf_dir).filter("split = 'test'").filter(N.challenging(*flags)).withColumn("reason", N.challenge_reason(*flags))
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.min("case_id").alias("first_id"), F.max("case_id").alias("last_id"))


@query(f"""WITH {CASES_SQL}, g AS (SELECT sha256(CAST(case_id AS VARCHAR)) AS h FROM cases WHERE split = 'test' AND is_grand), r AS (SELECT h[1:2] AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM g GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(p || d, '' ORDER BY p)) AS digest FROM r""")
def view_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest that pins a view's membership, worked out in ranges of the ids' own digests."""
    return contract.set_digest(cases(spark, sf_dir).filter("split = 'test' and is_grand"), ["case_id"])


@query(f"""WITH {CASES_SQL}, s AS (SELECT case_id, sum(amount4) AS allocated, count(*) AS n FROM amounts WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY case_id),
    c AS (SELECT cases.case_id, CAST(round(y * 10000) AS BIGINT) AS target, CASE WHEN formation = 'F' THEN 'complete' WHEN formation = 'O' THEN 'none_found' ELSE 'partial' END AS coverage,
                 CASE WHEN importance = '5-LOW' THEN 'draft' ELSE 'reviewed' END AS status, coalesce(allocated, 0) AS allocated, coalesce(n, 0) AS n FROM cases LEFT JOIN s ON s.case_id = cases.case_id),
    d AS (SELECT *, concat_ws(';', CASE WHEN status <> 'reviewed' THEN 'not_reviewed' END, CASE WHEN allocated > target THEN 'allocations_exceed_target' END,
                 CASE WHEN coverage = 'complete' AND allocated <> target THEN 'complete_coverage_differs' END, CASE WHEN coverage IN ('none_found', 'unknown') AND n > 0 THEN 'allocations_without_coverage' END) AS reasons FROM c)
    SELECT reasons, reasons = '' AS promoted, count(*) AS n, CAST(sum(allocated) AS BIGINT) AS allocated FROM d GROUP BY 1, 2""")
def promotion_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates promoted or held back, by reason."""
    coverage = F.when(F.col("formation") == "F", "complete").when(F.col("formation") == "O", "none_found").otherwise("partial")
    status = F.when(F.col("importance") == "5-LOW", "draft").otherwise("reviewed")
    rows = cases(spark, sf_dir).select("case_id", F.round(F.col("y") * 10000).cast("long").alias("target"), coverage.alias("coverage"), status.alias("status"))
    paid = amounts(spark, sf_dir).filter("l_returnflag = 'R' and l_linestatus = 'F'")
    return validate.promote(rows, paid, "case_id", "target", "amount4").groupBy("reasons", "promoted").agg(F.count("*").alias("n"), F.sum("allocated").cast("long").alias("allocated"))


@query("""WITH o AS (SELECT event_id, user_id, event_type, ts FROM events WHERE event_id % 3 <> 0), n AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN 'changed' ELSE event_type END AS event_type, ts FROM events WHERE event_id % 2 = 0)
    SELECT CASE WHEN o.event_id IS NULL THEN 'added' WHEN n.event_id IS NULL THEN 'kept' WHEN o.event_type = n.event_type THEN 'unchanged' ELSE 'updated' END AS action, count(*) AS n
    FROM o FULL OUTER JOIN n ON o.event_id = n.event_id GROUP BY 1""")
def merge_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merge of a newer delivery would do."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    new = rows.filter("event_id % 2 = 0").withColumn("event_type", F.when(F.col("event_id") % 7 == 0, "changed").otherwise(F.col("event_type")))
    out = ingest.merge_actions(rows.filter("event_id % 3 != 0"), new, "event_id", ["user_id", "event_type"])
    return out.groupBy("action").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT min(ts) AS lo FROM events), k AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -user_id ELSE user_id END AS user_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'x' ELSE props END AS props FROM events WHERE event_id % 4 <> 0)
    SELECT CASE WHEN k.event_id IS NULL THEN 'add_candidate' WHEN k.user_id <> e.user_id THEN 'review_metadata_revision' WHEN k.props IS NULL OR e.props IS NULL THEN 'metadata_unchanged_source_unverified'
                WHEN k.props <> e.props THEN 'review_document_revision' ELSE 'unchanged' END AS action, count(*) AS n
    FROM events e CROSS JOIN b LEFT JOIN k ON k.event_id = e.event_id WHERE e.ts >= lo + INTERVAL 1 DAY AND e.ts < lo + INTERVAL 10 DAY GROUP BY 1""")
def ingestion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of an update in a half-open window."""
    rows = table(spark, sf_dir, "events")
    low = rows.agg(F.min("ts").alias("lo"))
    known = rows.filter("event_id % 4 != 0").withColumn("user_id", F.when(F.col("event_id") % 5 == 0, -F.col("user_id")).otherwise(F.col("user_id")))
    known = known.withColumn("props", F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 13 == 0, "x").otherwise(F.col("props")))
    since, until = F.col("lo") + F.expr("interval 1 day"), F.col("lo") + F.expr("interval 10 days")
    plan = ingest.update_plan(rows.crossJoin(F.broadcast(low)), known, "event_id", "ts", since, until, ["user_id"], "props")
    return plan.groupBy("action").agg(F.count("*").alias("n"))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the same user in the day that ends with each event."""
    return ingest.rolling_count(table(spark, sf_dir, "events"), "user_id", "ts", 86400).select("event_id", "in_window")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) q WHERE p = 1""")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user."""
    return ingest.latest(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM documents)
    SELECT doc_id, length(body) AS n_chars, CAST(ceil(length(body) / 4.0) AS BIGINT) AS n_tokens, md5(body) AS digest FROM c""")
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cleaned, with size, token estimate and digest."""
    body = table(spark, sf_dir, "documents").select("doc_id", X.clean(F.col("text")).alias("body"))
    return body.select("doc_id", F.length("body").cast("long").alias("n_chars"), X.token_estimate(F.col("body")).alias("n_tokens"), F.md5(F.col("body").cast("binary")).alias("digest"))


#: Lines of documents, some with an outcome appended, so that every rule of the redaction is met.
_OUTCOMES = ("The applicant claimed EUR 5,000", "under Article 41 of the Convention", "he has to pay 1 200 within", "awarded for non-pecuniary harm", "3,500 euros were lost", "dismisses the claim", "damage of 4,000", "costs and expenses")


@query(r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text || chr(10) || list_extract(['The applicant claimed EUR 5,000', 'under Article 41 of the Convention', 'he has to pay 1 200 within', 'awarded for non-pecuniary harm', '3,500 euros were lost', 'dismisses the claim', 'damage of 4,000', 'costs and expenses'],
            CAST(doc_id % 8 AS BIGINT) + 1), '\n')) AS line FROM documents),
    m AS (SELECT doc_id, line, lower(line) AS x, regexp_matches(line, '(?i)(€|\beur\b|\beuros?\b|\b\d[\d,\s.\x{00a0}\x{202f}]{2,}\b)') AS money FROM l)
    SELECT doc_id, count(CASE WHEN regexp_matches(x, 'article 41|just satisfaction|non-pecuniary damage|non pecuniary damage|pecuniary damage|costs and expenses|for these reasons|operative provision')
                 OR (money AND regexp_matches(x, 'claim|award|pay')) OR (contains(x, 'non-pecuniary') AND regexp_matches(x, 'claim|award|damage')) THEN 1 END) AS strict,
           count(CASE WHEN regexp_matches(x, 'article 41|just satisfaction|for these reasons|operative (provision|clauses)|costs and expenses|finding of a violation constitutes sufficient satisfaction|makes no award|made no award|no award is made|no separate award|(dismisses|dismissed|rejects|rejected) the claim')
                 OR (money AND regexp_matches(x, 'claim|award|pay|damage')) OR (regexp_matches(x, 'non[- ]pecuniary') AND regexp_matches(x, 'claim|award|damage')) THEN 1 END) AS claim_blind,
           count(*) AS n_lines, count(CASE WHEN regexp_matches(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 1 END) AS with_address FROM m GROUP BY doc_id""")
def redaction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the strict and the claim-blind view hide, and lines with addresses."""
    outcome = F.element_at(F.array(*[F.lit(o) for o in _OUTCOMES]), (F.col("doc_id") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").withColumn("text", F.concat("text", F.lit("\n"), outcome))
    strict, blind = (X.redact_lines(F.col("text"), claim_blind)[1] for claim_blind in (False, True))
    parts = X.lines(F.col("text"))
    return rows.select("doc_id", strict.alias("strict"), blind.alias("claim_blind"), F.size(parts).cast("long").alias("n_lines"), F.size(F.filter(parts, lambda x: x.rlike(X.EMAIL_RE))).cast("long").alias("with_address"))


@query(r"""WITH c AS (SELECT conv_id, turn, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, count(CASE WHEN role = before THEN 1 END) AS repeated_roles, CAST(sum(length(text)) AS BIGINT) AS n_chars,
           string_agg(role, '>' ORDER BY turn) AS path FROM c GROUP BY conv_id""")
def action_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a trace: its roles in order, and roles that follow themselves."""
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct("role").alias("roles"), F.count_if(F.col("role") == F.col("before")).alias("repeated_roles"), F.sum(F.length("text")).cast("long").alias("n_chars"), path.alias("path"))


@query(f"""WITH {CASES_SQL} SELECT case_id, string_agg(article, ';' ORDER BY article) AS articles, count(*) AS n FROM articles GROUP BY case_id""")
def article_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case's sorted set of articles as text."""
    return articles(spark, sf_dir).groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list("article")), ";").alias("articles"), F.count("*").alias("n"))


@query(f"""WITH {CASES_SQL} SELECT case_id, CAST(date_part('month', judgment_date) AS BIGINT) AS month, CAST(date_part('year', judgment_date) AS BIGINT) AS year, {_BAND_SQL} AS band,
    CASE WHEN n_applicants > 100 THEN 'mass' WHEN n_applicants >= 21 THEN 'large' WHEN n_applicants > 1 OR n_applications > 1 THEN 'small_group' ELSE 'single' END AS structure,
    round(CAST(DATE '2002-01-01' - judgment_date AS DOUBLE) / 30.4375, 2) AS months FROM cases""")
def case_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates parsed back from the formats in use, bands and the aggregation class."""
    i = F.col("case_id") % 3
    written = F.when(i == 0, F.date_format("judgment_date", "yyyy-MM-dd")).when(i == 1, F.date_format("judgment_date", "yyyy/MM/dd")).otherwise(F.date_format("judgment_date", "dd/MM/yyyy"))
    rows = cases(spark, sf_dir).withColumn("day", N.lenient_date(written))
    return rows.select("case_id", F.month("day").cast("long").alias("month"), F.year("day").cast("long").alias("year"), N.count_band(F.col("n_applicants")).alias("band"), N.aggregation_class(F.col("n_applicants"), F.col("n_applications")).alias("structure"), N.months_between_days(F.lit("2002-01-01").cast("date"), F.col("day")).alias("months"))


@query("""WITH r AS (SELECT l_orderkey, l_returnflag, l_linestatus, CAST(round(l_tax * 100) AS BIGINT) AS tax, CAST(l_suppkey AS VARCHAR) AS source FROM lineitem)
    SELECT l_orderkey, l_returnflag, l_linestatus, tax, count(*) AS copies, string_agg(DISTINCT source, ';' ORDER BY source) AS sources FROM r GROUP BY l_orderkey, l_returnflag, l_linestatus, tax HAVING count(*) > 1""")
def collapsed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal candidate rows once, with their number and where they came from."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", F.round(F.col("l_tax") * 100).cast("long").alias("tax"), F.col("l_suppkey").cast("string").alias("source"))
    return validate.collapse(rows, "source").filter("copies > 1").drop("row_hash")
