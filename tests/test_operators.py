import datetime as dt

import pytest
from pyspark.sql import functions as F

from casewright.functions import normalize as N
from casewright.functions import text as X
from casewright.operators import encode, metrics, priors, ranking, retrieval, validate
from casewright.operators.overlap import overlap_join


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).head()["x"]


def test_overlap_is_strictly_earlier_shares_a_member_and_is_not_self(spark):
    d = dt.date
    docs = spark.createDataFrame([("six", d(2020, 1, 1), ["6"]), ("eight", d(2019, 1, 1), ["8"]), ("target", d(2021, 1, 1), ["6", "9"]), ("none", d(2021, 1, 1), ["14"]), ("nodate", None, ["6"]), ("noset", d(2018, 1, 1), None)], "case_id string, judgment_date date, articles array<string>")
    found = {(r.target_id, r.ref_id, r.shared) for r in overlap_join(docs, docs.filter("case_id != 'target'")).collect()}
    assert found == {("target", "six", 1)}


def test_overlap_plan_has_no_nested_loop(spark):
    docs = spark.createDataFrame([("a", dt.date(2020, 1, 1), ["6"])], "case_id string, judgment_date date, articles array<string>")
    plan = overlap_join(docs, docs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_balanced_takes_half_of_each_then_fills(spark):
    rows = spark.createDataFrame([(1, i, float(10 - i), i % 2 == 0) for i in range(10)], "t int, id int, score double, positive boolean")
    got = ranking.balanced(rows, ["t"], F.col("positive"), [F.desc("score"), F.asc("id")], 5).collect()
    assert sorted(r.id for r in got) == [0, 1, 2, 3, 4]
    only = ranking.balanced(rows.filter("positive"), ["t"], F.col("positive"), [F.desc("score")], 4).collect()
    assert [r.id for r in sorted(only, key=lambda r: r["rank"])] == [0, 2, 4, 6]
    with pytest.raises(ValueError):
        ranking.balanced(rows, ["t"], F.col("positive"), [F.desc("score")], 0)


def test_cascade_keeps_only_supported_narrowings(spark):
    rows = spark.createDataFrame([(1, i) for i in range(10)], "t int, v int")
    steps = [("some", F.col("v") < 8), ("none", F.col("v") > 100), ("few", F.col("v") < 2), ("enough", F.col("v") < 5)]
    got = ranking.cascade(rows, ["t"], steps, enough=4, always=2).collect()
    assert sorted(r.v for r in got) == [0, 1, 2, 3, 4] and got[0].applied == ["some", "enough"]


def test_average_ranks_share_ties(spark):
    rows = spark.createDataFrame([(v,) for v in (10.0, 20.0, 20.0, 30.0)], "v double")
    assert sorted(r.rank for r in ranking.average_ranks(rows, "v", "rank").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_metrics_of_constant_and_zero_rows(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.0, 0.0), ("a", 1.0, 0.0)], "g string, y double, prediction double")
    r = metrics.regression_metrics(rows, ["g"]).head()
    assert r.mae == pytest.approx(1 / 3) and r.n_positive == 1
    assert metrics.zero_metrics(rows, ["g"]).head().zero_f1 == pytest.approx(0.8)
    assert metrics.pearson(rows, ["g"], "prediction", "y").head().pearson == 0


def test_distribution_falls_back_to_all_without_positives(spark):
    rows = spark.createDataFrame([("z", 0.0), ("z", 0.0), ("p", 0.0), ("p", 100.0)], "k string, y double")
    got = {r.k: r for r in priors.distribution(rows, ["k"]).collect()}
    assert got["z"].median == 0 and got["p"].median == 100 and got["p"].median_all == 50 and got["p"].zero_rate == 0.5


def test_back_off_prefers_support_else_the_last_available(spark):
    rows = spark.createDataFrame([(10, 60, 90), (10, 20, 30), (None, None, 5), (None, None, None)], "a int, b int, c int")
    name, _, n = priors.back_off([(k, F.col(k).cast("double"), F.col(k)) for k in "abc"], 50)
    assert [(r.name, r.n) for r in rows.select(name.alias("name"), n.alias("n")).collect()] == [("b", 60), ("c", 30), ("c", 5), (None, None)]


def test_encoder_fills_scales_and_zeroes_unseen(spark):
    train = spark.createDataFrame([("A", 1.0), ("B", 3.0)], "c string, v double")
    stats, words = encode.fit_numeric(train, ["v"]), encode.vocabulary(train, "c")
    new = spark.createDataFrame([("NEW", None), (None, 3.0)], "c string, v double")
    got = encode.one_hot(encode.standardise(new, stats, ["v"]), words, "c").collect()
    assert [(r.z_v, r.hot_c) for r in got] == [(0.0, [0, 0, 0]), (1.0, [0, 0, 1]) if sorted(["A", "B", "__MISSING__"])[2] == "__MISSING__" else got[1]]


def test_article_normalisers_differ(spark):
    text = F.lit('["p1_1", "6 "]')
    assert one(spark, N.article_set(text)) == ["P1-1", "6"]
    assert one(spark, N.article_names(F.lit("Article 6; Art. 8/P1A1,6"))) == ["6", "8", "P1-1"]
    assert one(spark, N.article_list(F.lit("8;6; 6;a"))) == ["6", "8", "A"]
    assert one(spark, N.article_upper(F.lit("  "))) is None


@pytest.mark.parametrize(("text", "want"), [("2020-03-04T10:00", dt.date(2020, 3, 4)), ("2020/03/04", dt.date(2020, 3, 4)), ("04/03/2020", dt.date(2020, 3, 4)), ("2020", dt.date(2020, 1, 1)), ("x", None), (None, None)])
def test_lenient_dates(spark, text, want):
    assert one(spark, N.lenient_date(F.lit(text).cast("string"))) == want


def test_small_normalisers(spark):
    assert one(spark, N.money(F.lit("1,234.50"))) == 1234.5 and one(spark, N.money(F.lit("x"))) is None
    assert one(spark, N.application_numbers(F.lit("no. 123/20; 124/20; 123/20"))) == ["123/20", "124/20"]
    assert one(spark, N.application_numbers(F.lit("a; b"))) == ["a", "b"]
    assert one(spark, N.docname_applicant(F.lit("CASE OF SMITH v. NORWAY"))) == "SMITH"
    assert one(spark, N.docname_respondent(F.lit("CASE OF SMITH v. NORWAY"))) == "NORWAY"
    assert one(spark, N.largest_positive(F.lit(0), F.lit(3), F.lit(None).cast("int"))) == 3
    assert one(spark, N.ordinal_index(F.lit("the second applicant"))) == 2 and one(spark, N.ordinal_index(F.lit("applicant 7"))) == 7
    assert one(spark, N.challenging(F.lit(None).cast("boolean"), F.lit(1), F.lit(2))) is None
    assert one(spark, N.age_group(F.lit(2000), F.lit(2012))) == "child"


def test_text_functions(spark):
    assert one(spark, X.clean(F.lit("a\r\n\r\n\r\n\r\nb  \t c "))) == "a\n\nb c"
    assert one(spark, X.eur_amounts(F.lit("EUR 1,500 and 20.5 euros, EUR 1,500"))) == [1500.0, 20.5]
    text, n = X.redact_lines(F.lit("quiet\nhe claimed it\nEUR 500\nhe claimed EUR 500\nArticle 41\nnon-pecuniary damage of 9\n"))
    assert one(spark, text) == "quiet\nhe claimed it\nEUR 500\n[REDACTED]\n[REDACTED]\n[REDACTED]" and one(spark, n) == 3
    assert one(spark, X.redact_lines(F.lit("dismisses the claim\ndamage of 4,000\nlaw"), claim_blind=True)[1]) == 2 and one(spark, X.redact_lines(F.lit(" \n"))[0]) == ""
    assert one(spark, X.mask_names(F.lit("Ann Lee and lee; Leeds"), F.array(F.lit("Lee"), F.lit("Ann Lee")))) == "[NAME] and [NAME]; Leeds"
    assert one(spark, X.looks_like_heading(F.lit("THE LAW"))) and not one(spark, X.looks_like_heading(F.lit("The law")))
    assert one(spark, X.without_adjacent_repeats(F.array(*map(F.lit, "aabba")))) == ["a", "b", "a"]
    assert one(spark, X.head_of_claim(F.lit("costs and non-pecuniary"))) == "costs"
    assert one(spark, X.head_of_claim(F.lit("costs and non-pecuniary"), False)) == "non_pecuniary"
    assert one(spark, X.middle_cut(F.lit("abcdefgh"), 6, 2, 2, "..")) == "ab..gh"
    assert one(spark, X.matching_clauses(F.lit("one two three four harm. harm"), "harm")) == ["one two three four harm"]


def test_bm25_prefers_the_rarer_term(spark):
    docs = retrieval.terms(spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a a")], "id int, text string"), "id", "text")
    asked = retrieval.terms(spark.createDataFrame([(9, "a b")], "id int, text string"), "id", "text")
    got = {r.id: r.score for r in retrieval.bm25(docs, asked).collect()}
    assert max(got, key=got.get) == 1 and len(got) == 3


def test_violations_and_assertions(spark):
    rows = spark.createDataFrame([(1, 5), (2, -1), (2, None)], "id int, v int")
    found = validate.violations(rows, "id", {"negative": F.col("v") < 0}).unionByName(validate.duplicates(rows, ["id"], "twice"))
    assert {(r.key, r.rule) for r in found.collect()} == {("2", "negative"), ("2", "twice")}
    with pytest.raises(ValueError, match="negative at 2"):
        validate.assert_none(found.filter("rule = 'negative'"), "table")
    with pytest.raises(ValueError):
        validate.assert_columns(rows, ["id"], ("v",))
