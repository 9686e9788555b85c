"""Normalisers for codes, dates, counts and labels, as column expressions.

The four article normalisers differ on purpose; callers name the one they mean.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def first_present(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def _kept(parts: Column) -> Column:
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def article_set(c: Column) -> Column:
    """A: a list in brackets or parts at ``; , |``; all white space out, upper case, ``_`` as ``-``; distinct."""
    bare = F.regexp_replace(c, r'^\s*\[|\]\s*$|"', "")
    return _kept(F.transform(F.split(bare, r"[;,|]"), lambda x: F.replace(F.upper(F.regexp_replace(x, r"\s+", "")), F.lit("_"), F.lit("-"))))


def article_names(c: Column) -> Column:
    """B: parts at ``; , / |`` too; words for article dropped, names of the first protocol's first article unified; first seen first."""
    def one(x: Column) -> Column:
        x = F.upper(strip(x))
        x = F.regexp_replace(x, r"^(ARTICLE|ART\.)\s*", "")
        return F.when(F.regexp_replace(x, r"\s+", "").isin("P1A1", "A1P1", "P1-01"), F.lit("P1-1")).otherwise(x)

    return _kept(F.transform(F.split(c, r"[;,/|]+"), one))


def article_list(c: Column) -> Column:
    """C: parts at ``;`` only, upper case, sorted, distinct."""
    return F.array_sort(_kept(F.transform(F.split(c, ";"), lambda x: F.upper(strip(x)))))


def article_upper(c: Column) -> Column:
    """D: one code, upper case and trimmed; null if nothing is left."""
    return F.nullif(F.upper(strip(c)), F.lit(""))


def country(c: Column) -> Column:
    """The first of a list at ``;``, upper case."""
    return F.nullif(F.upper(strip(F.element_at(F.split(c, ";"), 1))), F.lit(""))


def lenient_date(c: Column) -> Column:
    """Year-month-day with dashes or slashes or day/month/year in the first ten characters, else the year they start with; null if none fits."""
    head = F.left(strip(c), F.lit(10))
    tries = [F.try_to_timestamp(head, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy")]
    year = F.regexp_extract(head, r"^(\d{4})", 1)
    return F.coalesce(*tries, F.when(year != "", F.make_date(F.nullif(year, F.lit("")).cast("int"), F.lit(1), F.lit(1))))


def any_year(c: Column) -> Column:
    """The first year of the 20th or 21st century in a text."""
    return F.nullif(F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def months_between_days(later: Column, earlier: Column) -> Column:
    """Days by the mean length of a month, to two places."""
    return F.round(F.datediff(later, earlier) / 30.4375, 2)


def money(c: Column) -> Column:
    """A number with commas as separators, null if it is none."""
    return F.replace(strip(c), F.lit(","), F.lit("")).try_cast("double")


def count_band(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").when(n <= 100, "21-100").otherwise("100+")


def applicant_band(n: Column) -> Column:
    return F.when(n <= 1, "single").when(n <= 3, "small").when(n <= 10, "medium").otherwise("large")


def recency(days: Column) -> Column:
    """Steps at 1, 3, 5 and 10 years."""
    return F.when(days <= 365, 1.0).when(days <= 1095, 0.85).when(days <= 1825, 0.7).when(days <= 3650, 0.45).otherwise(0.2)


def applicant_similarity(distance: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.least(distance / F.greatest(n, F.lit(1)), F.lit(1.0)))


def age_group(birth_year: Column, year: Column) -> Column:
    age = year - birth_year
    return F.when(age.isNull() | (age < 0), "unknown").when(age < 13, "child").when(age < 18, "adolescent").when(age < 65, "adult").otherwise("elderly")


def aggregation_class(applicants: Column, applications: Column) -> Column:
    return F.when(applicants > 100, "mass").when(applicants >= 21, "large").when((applicants > 1) | (applications > 1), "small_group").otherwise("single")


def challenging(is_grand: Column, applications: Column, distinct_articles: Column) -> Column:
    """Null if what is known does not settle it."""
    return is_grand | ((applications > 1) & (distinct_articles > 1))


def challenge_reason(is_grand: Column, applications: Column, distinct_articles: Column) -> Column:
    multi = (applications > 1) & (distinct_articles > 1)
    return F.concat_ws(";", F.when(is_grand, "grand_chamber"), F.when(multi, "multiple_applications_and_articles"))


def application_numbers(c: Column) -> Column:
    """All numbers of the form 123/45, distinct; where there are none, the parts at ``; , |``."""
    hits = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b\d{1,6}/\d{2,4}\b"), 0))
    return F.when(F.size(hits) > 0, hits).otherwise(_kept(F.transform(F.split(c, r"[;,|]"), strip)))


def docname_applicant(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)^(?:case of\s+)?(.+?)\s+v\.\s+.+$", 1), F.lit(""))


def docname_respondent(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)^.+?\s+v\.\s+(.+)$", 1), F.lit(""))


def largest_positive(*counts: Column) -> Column:
    """The largest count above zero among fields, else 1."""
    positive = [F.when(c > 0, c) for c in counts]
    return F.coalesce(F.greatest(*positive) if len(positive) > 1 else positive[0], F.lit(1))


def beneficiary_kind(label: Column) -> Column:
    x = F.lower(label)
    return F.when(x.rlike(r"joint|together"), "joint").when(x.rlike(r"heir|estate|widow"), "heirs").when(x.rlike(r"each|every"), "each").when(x.rlike(r"applicant"), "applicant").otherwise("other")


#: Ordinals as written, first to tenth.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")


def ordinal_index(label: Column) -> Column:
    """The place that an ordinal word or number names, from 1."""
    word = F.regexp_extract(F.lower(label), r"\b(" + "|".join(ORDINALS) + r")\b", 1)
    by_word = F.nullif(F.array_position(F.array(*[F.lit(o) for o in ORDINALS]), word), F.lit(0))
    return F.coalesce(by_word.cast("int"), F.nullif(F.regexp_extract(label, r"\b(\d{1,3})(?:st|nd|rd|th)?\b", 1), F.lit("")).cast("int"))
