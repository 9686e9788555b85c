"""Extraction that needs places in the text: vectorised Python over Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright.functions.normalize import ORDINALS

#: The currency codes known.
CURRENCIES = ("EUR", "USD", "GBP", "AZN", "RUB", "TRY", "UAH", "PLN", "HUF", "RON", "CZK", "SEK", "NOK", "DKK", "CHF", "BGN", "RSD", "HRK", "BAM", "MKD", "ALL", "AMD", "GEL", "MDL", "ISK")
_CODE = rf"(?:euros?|{'|'.join(CURRENCIES)})"
_NUMBER = r"[0-9]{1,3}(?:[,\s][0-9]{3})*(?:\.\d+)?|[0-9]+(?:\.\d+)?"
_BEFORE = re.compile(rf"\b(?P<code>{_CODE})\s*(?P<number>{_NUMBER})\b", re.I)
_AFTER = re.compile(rf"\b(?P<number>{_NUMBER})\s*(?P<code>{_CODE})\b", re.I)
_PRECEDENT = re.compile(r"(?P<name>[A-Z][\w'’.-]*(?:\s+(?:and\s+Others|[A-Z][\w'’.-]*))*\s+v\.\s+[A-Z]\w*(?:\s+[A-Z]\w*)*)(?:\s+\[GC\])?,\s+no\.\s+(?P<number>\d{1,6}/\d{2,4})(?:,\s+(?P<date>\d{1,2}\s+\w+\s+\d{4}))?")
_COUNT = re.compile(r"\b(?:(?P<n>\d{1,4})|(?P<word>two|three|four|five|six|seven|eight|nine|ten))\s+applicants\b", re.I)
_ONE = re.compile(rf"\b(?:{'|'.join(ORDINALS)})\s+applicant\b", re.I)
_WORDS = ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def mentions(text: str | None) -> list[tuple[int, int, str, float]]:
    """Start, end, currency and amount of each mention, code before or after the number, by start; a span counts once."""
    found: dict[tuple[int, int], tuple[int, int, str, float]] = {}
    for pattern in (_BEFORE, _AFTER):
        for m in pattern.finditer(text or ""):
            number = m["number"].replace(" ", "").replace(",", "")
            code = "EUR" if m["code"].lower().startswith("euro") else m["code"].upper()
            try:
                found.setdefault(m.span(), (*m.span(), code, float(number)))
            except ValueError:  # other white space inside
                continue
    return sorted(found.values(), key=lambda x: x[0])


def currency_mentions(text: Column) -> Column:
    """``array<struct<start, end, currency, amount>>``; null texts have none."""

    @F.pandas_udf("array<struct<start:int,end:int,currency:string,amount:double>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("start", "end", "currency", "amount"), m, strict=True)) for m in mentions(t)] for t in texts], dtype=object)

    return run(text)


def cited(text: str | None) -> list[tuple[str, str, str | None, bool]]:
    """Case, application number, date and whether the Grand Chamber decided; the first of each number."""
    found: dict[str, tuple[str, str, str | None, bool]] = {}
    for m in _PRECEDENT.finditer(text or ""):
        found.setdefault(m["number"], (re.sub(r"\s+", " ", m["name"]), m["number"], m["date"], "[GC]" in (text or "")[m.start() : m.end() + 12]))
    return list(found.values())


def precedents(text: Column) -> Column:
    @F.pandas_udf("array<struct<name:string,number:string,date:string,grand:boolean>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("name", "number", "date", "grand"), c, strict=True)) for c in cited(t)] for t in texts], dtype=object)

    return run(text)


def multiplied(text: str | None, applicants: int) -> list[tuple[str, float, int]]:
    """Currency, amount and number of recipients of each mention: all of them after "each", those counted or one named near it."""
    out, text = [], text or ""
    for start, end, currency, amount in mentions(text):
        near = text[max(0, start - 80) : end + 80].lower()
        count, each = _COUNT.search(near), re.search(r"\b(?:each|every|respectively to each)\b", near)
        if each and count:
            n = int(count["n"]) if count["n"] else 2 + _WORDS.index(count["word"].lower())
        else:
            n = max(1, applicants) if each and not _ONE.search(near) else 1
        out.append((currency, amount, n))
    return out


def claims(text: Column, applicants: Column) -> Column:
    """``array<struct<currency, amount, recipients, total>>``."""

    @F.pandas_udf("array<struct<currency:string,amount:double,recipients:int,total:double>>")
    def run(texts: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([[{"currency": c, "amount": a, "recipients": n, "total": a * n} for c, a, n in multiplied(t, int(k) if k == k and k is not None else 1)] for t, k in zip(texts, counts, strict=True)], dtype=object)

    return run(text, applicants)


def first_json(text: str | None) -> str | None:
    """The first balanced object or list in messy text that is JSON, fences or not; null if there is none."""
    text = text or ""
    for i, c in enumerate(text):
        if c in "{[":
            try:
                value, _ = _DECODER.raw_decode(text, i)
            except ValueError:
                continue
            return json.dumps(value, sort_keys=True, ensure_ascii=False)
    return None


_DECODER = json.JSONDecoder()


def json_in(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([first_json(t) for t in texts], dtype=object)

    return run(text)
