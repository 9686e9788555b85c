import pytest
from pyspark.sql import functions as F

from casewright.functions import spans
from casewright.plans.schema import APPLICANT_COLUMNS, CASE_COLUMNS, validate_tables


def test_mentions_have_places(spark):
    text = "He claimed EUR 1,500.50 and 20 euros, also UAH 3 000 or 7 chf"
    assert [(text[a:b], c, x) for a, b, c, x in spans.mentions(text)] == [("EUR 1,500.50", "EUR", 1500.5), ("20 euros", "EUR", 20.0), ("UAH 3 000", "UAH", 3000.0), ("7 chf", "CHF", 7.0)]
    rows = spark.createDataFrame([(text, 2), (None, None)], "t string, n int").select(spans.currency_mentions(F.col("t")).alias("m"), spans.claims(F.col("t"), F.col("n")).alias("c")).collect()
    assert [len(r.m) for r in rows] == [4, 0] and [len(r.c) for r in rows] == [4, 0]


def test_recipients():
    assert spans.multiplied("EUR 100 to each of the three applicants", 9) == [("EUR", 100.0, 3)]
    assert spans.multiplied("EUR 100 each", 9) == [("EUR", 100.0, 9)]
    assert spans.multiplied("EUR 100 to the first applicant", 9) == [("EUR", 100.0, 1)]


def test_precedents(spark):
    text = "see Smith and Others v. Norway [GC], no. 123/10, 5 May 2011, and Lee v. Malta, no. 7/99; Smith v. Norway, no. 123/10"
    assert spans.cited(text) == [("Smith and Others v. Norway", "123/10", "5 May 2011", True), ("Lee v. Malta", "7/99", None, False)]
    assert len(spark.createDataFrame([(text,)], "t string").select(spans.precedents(F.col("t")).alias("p")).head().p) == 2


def test_json_in_messy_text(spark):
    rows = spark.createDataFrame([('so: ```json\n{"b": [1, {"a": 2}]}\n``` ok',), ("{broken",), (None,)], "t string")
    assert [r.j for r in rows.select(spans.json_in(F.col("t")).alias("j")).collect()] == ['{"b": [1, {"a": 2}]}', None, None]


def case(**changes):
    row = dict.fromkeys(CASE_COLUMNS, "unknown") | {"case_id": "001-100000", "split": "train", "test_view": "not_applicable", "test_challenging_view": "no", "judgment_date": "2010-01-01", "judgment_year": "2010", "hudoc_application_count": "1"}
    row |= {"is_grand_chamber": "no", "violated_articles": "3;6", "violated_articles_count": "2", "violation_type": "both", "y_amount_eur": "100", "y_binary": "1", "target_status": "retained_label"}
    return tuple((row | changes)[c] for c in CASE_COLUMNS)


def person(**changes):
    row = dict.fromkeys(APPLICANT_COLUMNS, "unknown") | {"applicant_id": "applicant_000001", "case_id": "001-100000", "split": "train", "applicant_name": "[MASKED]", "applicant_type": "applicant_source_record"}
    row |= {"npd_award_eur": "60", "npd_award_scope": "individual", "npd_award_status": "verified_source_link"}
    return tuple((row | changes)[c] for c in APPLICANT_COLUMNS)


def found_in(spark, cases, people):
    text = lambda columns: ", ".join(f"{c} string" for c in columns)
    return {(r.key, r.rule) for r in validate_tables(spark.createDataFrame(cases, text(CASE_COLUMNS)), spark.createDataFrame(people, text(APPLICANT_COLUMNS))).collect()}


def test_two_tables(spark):
    assert found_in(spark, [case()], [person()]) == set()
    cases = [case(), case(case_id="x", split="dev", judgment_date="2010-13-01", y_amount_eur="-1"), case(case_id="001-100002", violated_articles_count="3", y_binary="0", respondent_state="a@b.org")]
    cases += [case(case_id="001-100003", split="test", test_view="ID", hudoc_application_count="2", target_status="?"), case(case_id="001-100004", hudoc_application_count="0", judgment_year="2011", violation_type="none", violation_duration_months="long", test_view="ID")]
    people = [person(), person(applicant_id="applicant_000002"), person(applicant_id="applicant_000002", case_id="none"), person(applicant_id="applicant_000003", split="test", npd_award_eur="unknown")]
    people += [person(applicant_id="a4", applicant_name="Ann", npd_award_scope="applicant_estate", sex="mixed", npd_award_eur="0"), person(applicant_id="applicant_000005", npd_award_status="group_or_organisation_record")]
    people += [person(applicant_id="applicant_000006", npd_award_status="?", birth_year="70", age_group="old", nationality_scope="x"), person(applicant_id="applicant_000007", npd_award_scope="unknown", npd_award_eur="0"), person(applicant_id="applicant_000008", npd_award_eur="101", case_id="001-100004")]
    assert found_in(spark, cases, people) == {
        ("x", "case_id_form"), ("x", "split_known"), ("x", "date_iso"), ("x", "amount"), ("001-100002", "article_count"), ("001-100002", "binary"), ("001-100002", "contact"),
        ("001-100003", "challenging"), ("001-100003", "target_status_known"), ("001-100004", "application_count"), ("001-100004", "year_of_date"), ("001-100004", "violation_type_known"), ("001-100004", "duration"), ("001-100004", "view_only_in_test"),
        ("applicant_000002", "applicant_id_unique"), ("none", "applicant_without_case"), ("applicant_000003", "split_agrees"), ("applicant_000003", "award"), ("a4", "applicant_id_form"), ("a4", "name_masked"), ("a4", "estate_type"), ("a4", "mixed_sex"),
        ("applicant_000005", "unresolved_without_amount"), ("applicant_000006", "award_status_known"), ("applicant_000006", "birth_year"), ("applicant_000006", "age_group_known"), ("applicant_000006", "nationality_scope_known"),
        ("applicant_000007", "amount_with_scope"), ("applicant_000008", "award_within_case"), ("001-100004", "awards_within_case"), ("001-100000", "awards_within_case"),
    }
    with pytest.raises(ValueError, match="columns"):
        validate_tables(spark.createDataFrame([case()[::-1]], ", ".join(f"{c} string" for c in CASE_COLUMNS[::-1])), spark.createDataFrame([person()], ", ".join(f"{c} string" for c in APPLICANT_COLUMNS)))
