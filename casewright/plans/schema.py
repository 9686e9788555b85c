"""The two public tables, and the rules that they must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators.validate import duplicates, orphans, violations

#: Fixed column names of the tables, in order.
CASE_COLUMNS = (
    "case_id split test_view test_challenging_view judgment_date judgment_year respondent_state country_alpha2 hudoc_decision_body court_formation is_grand_chamber case_importance "
    "has_separate_opinion represented hudoc_application_count num_applicants num_violations_found has_mixed_outcome violated_articles violated_articles_count violation_type violation_duration_months "
    "applicant_sex applicant_age_group applicant_birth_years applicant_nationality_scope beneficiary_type has_joint_beneficiary gdp_per_capita_current_usd gdp_constant_2015_usd y_amount_eur y_binary target_status"
).split()
APPLICANT_COLUMNS = "applicant_id case_id split applicant_name applicant_type sex age_group birth_year nationality nationality_scope beneficiary_type npd_award_eur npd_award_scope npd_award_status".split()
#: Fixed values of the categories.
SPLITS = ("train", "validation", "test")
CASE_CATEGORIES = {
    "split": SPLITS, "violation_type": ("substantive", "procedural", "both", "unknown", "other"), "test_challenging_view": ("yes", "no"),
    "target_status": ("retained_label", "corrected_amount", "mixed_head_reference_label", "unresolved_reference_label"),
}
APPLICANT_CATEGORIES = {
    "applicant_type": ("applicant_source_record", "applicant_estate_record", "organisation_record", "group_or_ambiguous_record"), "npd_award_scope": ("individual", "applicant_estate", "group_or_organisation", "unknown"),
    "sex": ("male", "female", "unknown", "mixed"), "age_group": ("child", "adolescent", "adult", "elderly", "unknown"), "nationality_scope": ("single", "multiple", "stateless", "unknown"),
}
AMOUNT_STATUSES = ("retained_source_link", "verified_source_link", "verified_source_allocation")
MISSING_STATUSES = ("no_personal_allocation_found_in_retained_data", "allocation_link_or_scope_unresolved", "group_or_organisation_record", "reference_case_target_unresolved")
CONTACT = r"[^\s@]+@[^\s@]+\.[^\s@]+"


def number(c: Column) -> Column:
    """A decimal, null where the text is ``unknown`` or none."""
    return F.nullif(c, F.lit("unknown")).try_cast("decimal(28,6)")


def bad_number(c: Column, unknown: bool = True) -> Column:
    """Neither a number of zero or more nor, where that is allowed, ``unknown``."""
    return F.coalesce(~((number(c).isNotNull() & (number(c) >= 0)) | (F.lit(unknown) & (c == "unknown"))), F.lit(True))


def _contact(columns: list[str]) -> Column:
    return F.exists(F.array(*[F.col(x) for x in columns]), lambda x: F.coalesce(x.rlike(CONTACT), F.lit(False)))


def case_rules() -> dict[str, Column]:
    """What is wrong with a row of the case table; a null cell is wrong wherever a value is asked for."""
    c, wrong = F.col, lambda condition: F.coalesce(~condition, F.lit(True))
    codes = F.size(F.array_distinct(F.filter(F.transform(F.split(c("violated_articles"), ";"), lambda x: F.trim(x)), lambda x: x != "")))
    applications, amount = c("hudoc_application_count").try_cast("int"), number(c("y_amount_eur"))
    hard = (c("split") == "test") & ((c("is_grand_chamber") == "yes") | ((applications > 1) & (codes > 1)))
    return {f"{k}_known": wrong(c(k).isin(*v)) for k, v in CASE_CATEGORIES.items()} | {
        "case_id_form": wrong(c("case_id").rlike(r"^\d{3}-\d{4,9}$")), "date_iso": wrong(c("judgment_date").rlike(r"^\d{4}-\d{2}-\d{2}$") & c("judgment_date").try_cast("date").isNotNull()),
        "year_of_date": F.year(c("judgment_date").try_cast("date")).cast("string") != c("judgment_year"), "article_count": wrong(codes == c("violated_articles_count").try_cast("int")), "application_count": wrong(applications >= 1),
        "challenging": (c("test_challenging_view") == "yes") != hard, "amount": bad_number(c("y_amount_eur"), unknown=False), "binary": (amount >= 0) & (c("y_binary") != F.when(amount > 0, "1").otherwise("0")),
        "duration": bad_number(c("violation_duration_months")), "view_only_in_test": (c("split") != "test") & ((c("test_challenging_view") != "no") | (c("test_view") != "not_applicable")), "contact": _contact(CASE_COLUMNS),
    }


def applicant_rules() -> dict[str, Column]:
    """What is wrong with a row of the applicant table by itself."""
    c, wrong = F.col, lambda condition: F.coalesce(~condition, F.lit(True))
    missing, amounts = c("npd_award_status").isin(*MISSING_STATUSES), c("npd_award_status").isin(*AMOUNT_STATUSES)
    return {f"{k}_known": wrong(c(k).isin(*v)) for k, v in APPLICANT_CATEGORIES.items()} | {
        "applicant_id_form": wrong(c("applicant_id").rlike(r"^applicant_\d{6,}$")), "name_masked": wrong(c("applicant_name") == "[MASKED]"), "estate_type": (c("npd_award_scope") == "applicant_estate") & (c("applicant_type") != "applicant_estate_record"),
        "mixed_sex": (c("sex") == "mixed") & (c("applicant_type") != "group_or_ambiguous_record"), "birth_year": wrong((c("birth_year") == "unknown") | c("birth_year").rlike(r"^\d{4}$")),
        "unresolved_without_amount": missing & ((c("npd_award_eur") != "unknown") | (c("npd_award_scope") != "unknown")), "amount_with_scope": amounts & (c("npd_award_scope") == "unknown"), "award": amounts & bad_number(c("npd_award_eur"), unknown=False),
        "award_status_known": wrong(missing | amounts), "contact": _contact(APPLICANT_COLUMNS),
    }


def validate_tables(cases: DataFrame, applicants: DataFrame) -> DataFrame:
    """``key, rule`` of everything in the two tables that breaks a rule: of columns (at once), rows, keys, links and sums of awards."""
    if cases.columns != CASE_COLUMNS or applicants.columns != APPLICANT_COLUMNS:
        raise ValueError("the two tables do not have their columns in order")
    found = violations(cases, "case_id", case_rules()).unionByName(violations(applicants, "applicant_id", applicant_rules()))
    found = found.unionByName(duplicates(cases, ["case_id"], "case_id_unique")).unionByName(duplicates(applicants, ["applicant_id"], "applicant_id_unique"))
    found = found.unionByName(orphans(applicants, cases, "case_id", "case_id", "applicant_without_case"))
    award = F.when(F.col("npd_award_status").isin(*AMOUNT_STATUSES), number(F.col("npd_award_eur")))
    linked = applicants.select("applicant_id", "case_id", F.col("split").alias("own"), award.alias("award")).join(cases.select("case_id", "split", number(F.col("y_amount_eur")).alias("y")), "case_id")
    for rule, condition in (("split_agrees", F.col("own") != F.col("split")), ("award_within_case", F.col("award") > F.col("y"))):
        found = found.unionByName(linked.filter(condition).select(F.col("applicant_id").alias("key"), F.lit(rule).alias("rule")))
    sums = linked.groupBy("case_id").agg(F.sum("award").alias("sum"), F.first("y").alias("y")).filter("sum > y")
    return found.unionByName(sums.select(F.col("case_id").alias("key"), F.lit("awards_within_case").alias("rule")))
