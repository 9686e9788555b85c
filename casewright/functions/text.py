"""Text functions as column expressions: cleaning, splitting, amounts, redaction, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright.functions.normalize import strip

#: Fixed values of the redaction rules: what hides a line by itself, in the strict and in the claim-blind view.
STRICT_TERMS = ("article 41", "just satisfaction", "non-pecuniary damage", "non pecuniary damage", "pecuniary damage", "costs and expenses", "for these reasons", "operative provision")
CLAIM_BLIND_TERMS = (
    "article 41", "just satisfaction", "for these reasons", "operative provision", "operative clauses", "costs and expenses", "finding of a violation constitutes sufficient satisfaction",
    "constitutes sufficient just satisfaction", "sufficient just satisfaction", "makes no award", "made no award", "no award is made", "no separate award", "dismisses the claim", "dismissed the claim",
    "rejects the claim", "rejected the claim",
)
#: Fixed value: what counts as money there.
MONEY_RE = r"(?i)(?:€|\beur\b|\beuros?\b|\b\d[\d,\s.\x{00a0}\x{202f}]{2,}\b)"
MARKER = "[REDACTED]"
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def clean(c: Column) -> Column:
    """Line ends unified, blanks collapsed, no more than one empty line, nothing at the ends."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def middle_cut(c: Column, most: int, head: int, tail: int, mark: str = " [TRUNCATED] ") -> Column:
    """Longer texts keep their head and tail."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(head)), F.lit(mark), F.right(c, F.lit(tail)))).otherwise(c)


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda x: x != "")


def clauses(c: Column) -> Column:
    """Stretches between full stops, semicolons and line ends."""
    return F.filter(F.transform(F.split(c, r"[.;\n]+"), squeeze), lambda x: x != "")


def matching_clauses(c: Column, pattern: str, words: int = 5, most: int = 12) -> Column:
    """Clauses of some words that match, distinct, the first ones."""
    hit = F.filter(clauses(c), lambda x: x.rlike(pattern) & (F.size(F.split(x, " ")) >= words))
    return F.slice(F.array_distinct(hit), 1, most)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("long")


def eur_amounts(c: Column) -> Column:
    """Amounts with the currency before or after, distinct, those before first."""
    before = F.regexp_extract_all(c, F.lit(r"(?:EUR|€)\s?(\d[\d,]*(?:\.\d+)?)"), 1)
    after = F.regexp_extract_all(c, F.lit(r"(\d[\d,]*(?:\.\d+)?)\s?(?:EUR|euros?)\b"), 1)
    return F.array_distinct(F.transform(F.concat(before, after), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")))


def hides(line: Column, claim_blind: bool = False) -> Column:
    """Whether a line gives the outcome away.

    By a term of the list, by money beside a word of claiming, awarding or paying, or by non-pecuniary damage
    claimed or awarded.
    """
    x = F.lower(line)
    has = lambda *words: F.greatest(*[F.contains(x, F.lit(w)) for w in words], F.lit(False))
    terms, beside = (CLAIM_BLIND_TERMS, ("claim", "award", "pay", "damage")) if claim_blind else (STRICT_TERMS, ("claim", "award", "pay"))
    names = ("non-pecuniary", "non pecuniary") if claim_blind else ("non-pecuniary",)
    return has(*terms) | (line.rlike(MONEY_RE) & has(*beside)) | (has(*names) & has("claim", "award", "damage"))


def redact_lines(c: Column, claim_blind: bool = False) -> tuple[Column, Column]:
    """Lines that give the outcome away become a marker; also how many did. Blank texts become empty, a line end at the end goes."""
    parts = F.split(F.regexp_replace(c, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")
    hit = lambda x: hides(x, claim_blind)
    blank = F.coalesce(strip(c), F.lit("")) == ""
    text = F.array_join(F.transform(parts, lambda x: F.when(hit(x), F.lit(MARKER)).otherwise(x)), "\n")
    return F.when(blank, "").otherwise(text), F.when(blank, 0).otherwise(F.size(F.filter(parts, hit))).cast("long")


def mask_names(c: Column, names: Column, mask: str = "[NAME]") -> Column:
    """Each name, longest first, as a whole word in any case."""
    longest = F.array_sort(names, lambda a, b: (F.length(b) - F.length(a)).cast("int"))
    return F.aggregate(longest, c, lambda text, name: F.regexp_replace(text, F.concat(F.lit(r"(?i)(?<!\w)\Q"), name, F.lit(r"\E(?!\w)")), F.lit(mask)))


def looks_like_heading(c: Column, most: int = 120, share: float = 0.65) -> Column:
    """Short, with letters, most of them capitals."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(c, r"[^\p{Lu}]", ""))
    return (F.length(c) <= most) & (letters > 0) & (capitals >= share * letters)


def heading_name(heading: Column, name: Column | None = None) -> Column:
    """A heading's canonical section, by the first rule that fits; else the section's own name, else ``unclassified``."""
    x = F.upper(F.regexp_replace(F.regexp_replace(clean(F.coalesce(heading, F.lit(""))), "’", "'"), "[“”]", '"'))
    has = lambda *words: F.greatest(*[F.contains(x, F.lit(w)) for w in words], F.lit(False))
    ladder = (
        (has("FOR THESE REASONS"), "operative"), (has("THE COURT'S ASSESSMENT"), "assessment_summary"), (has("APPLICATION OF ARTICLE 41", "APPLICATION OF ARTICLE 50", "JUST SATISFACTION"), "article_41"),
        (has("SUBJECT MATTER OF THE CASE"), "summary_intro"), (x.isin("PROCEDURE", "PROCEEDINGS", "PROCEEDINGS BEFORE THE COURT"), "procedure"), (x == "INTRODUCTION", "introduction"),
        (has("THE FACTS", "THE CIRCUMSTANCES OF THE CASE"), "facts"), (has("RELEVANT LEGAL FRAMEWORK", "RELEVANT DOMESTIC LAW", "RELEVANT COUNCIL OF EUROPE INSTRUMENTS"), "relevant_law"),
        (x.isin("THE LAW", "MERITS") | has("ALLEGED VIOLATION OF ARTICLE") | x.startswith("III. MERITS"), "law"), (x.startswith("TABLE-") | x.startswith("TABLE "), "appendix"), (has("OPINION"), "opinion"),
    )
    own = F.lower(clean(F.coalesce(name if name is not None else F.lit(""), F.lit(""))))
    out = F.when(*ladder[0][:1], ladder[0][1])
    for condition, section in ladder[1:]:
        out = out.when(condition, section)
    return out.when(own == "conclusion", "conclusion_misc").when(own != "", own).otherwise("unclassified")


def head_of_claim(c: Column, costs_first: bool = True) -> Column:
    """What an amount is for; the two orders of the rules are both in use."""
    x = F.lower(c)
    costs, non_pecuniary, pecuniary = x.rlike("costs|expenses"), x.rlike("non-pecuniary"), x.rlike("pecuniary")
    if costs_first:
        return F.when(costs, "costs").when(non_pecuniary, "non_pecuniary").when(pecuniary, "pecuniary")
    return F.when(non_pecuniary, "non_pecuniary").when(pecuniary, "pecuniary").when(costs, "costs")


def amount_spellings(amount: Column) -> Column:
    """The ways an amount may be written."""
    plain = F.format_number(amount, "0")
    comma = F.format_number(amount, 0)
    return F.array_distinct(F.array(plain, comma, *[F.replace(comma, F.lit(","), F.lit(x)) for x in (" ", " ", " ", ".")], F.concat(plain, F.lit(".0"))))


def without_adjacent_repeats(parts: Column) -> Column:
    """Of equal neighbours the first."""
    return F.filter(parts, lambda x, i: (i == 0) | (x != F.element_at(parts, F.greatest(i, F.lit(1)).cast("int"))))
