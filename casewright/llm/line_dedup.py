"""Substring deduplication by hashing pieces of lines (or whole paragraphs).

A line is cut at sentence ends and at content-defined places: before a word whose hash, taken with the next
word's, is smallest within ``REACH`` words of its sentence. Where a cut lies depends on the few words around it alone, so a
passage is cut alike inside any line. With ``paragraphs`` units are what blank lines separate, uncut. Pieces,
normalised (ASCII letters lower-cased, white space collapsed), are grouped by a 128-bit digest over all
documents; the occurrence of lowest rank (id, then place in the text) stays. Of the others those are removed
that make up a whole line, or stand in a row of ``run_words`` words or more (fewer words recur by chance).
Neighbours with the same first document are one span; places in the original text are kept as offsets of
code points. Only digests and offsets are shuffled, aggregated within map tasks first; rows of a very common
piece are joined back by a key whose rows Spark can split.

Defined results: a null text counts as empty and has no units; null ids rank last; repeated rows are
documents of their own, the first of them ranks first; lines under ``min_words`` words always stay, as do the
ends of a passage up to its first and from its last cut, and passages inside a stretch without white space;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import Workspace, bounded_batches, fresh

_PARAGRAPH = re.compile(r"\n[\x20\x09-\x0D]*\n")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: How many words on either side a content-defined cut is compared with.
REACH = 4
#: A shorter row of repeated pieces stays, unless it is a whole line.
RUN_WORDS = 8
_ENDS = (b".", b"!", b"?")


def pieces(text: str, min_words: int) -> list[tuple[int, int, int, int, int, int]]:
    """Start, end, digest (two numbers of 64 bits), words and line of each piece of the lines that are long enough.

    A line's pieces cover it: the first starts where it starts, a piece ends one character before the next.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    n = len(words)
    begin = np.fromiter((m.start() for m in _WORD.finditer(text)), np.int64, n)
    breaks = np.array(_newlines(text), np.int64)
    line = np.searchsorted(breaks, begin)
    fresh = np.ones(n, bool)
    fresh[1:] = line[1:] != line[:-1]
    cut = fresh.copy()
    cut[1:] |= np.fromiter((w.endswith(_ENDS) for w in words[:-1]), bool, n - 1)
    cut |= _local_minima(np.fromiter(map(zlib.crc32, words), np.uint64, n), np.flatnonzero(cut))
    at = np.flatnonzero(cut)
    ends = np.append(at[1:], n)
    of_line = np.bincount(line)[line[at]]
    left = np.where(fresh[at], np.append(0, breaks + 1)[line[at]], begin[at])
    last = np.append(fresh[at[1:]], True)
    right = np.where(last, np.append(breaks, len(text))[line[at]], np.append(left[1:] - 1, 0))
    out = []
    for a, b, start, end, size, k in zip(at.tolist(), ends.tolist(), left.tolist(), right.tolist(), of_line.tolist(), line[at].tolist(), strict=True):
        if size >= min_words:
            # a short line is compared with lines only, not with pieces that happen to hold its words
            digest = xxhash.xxh3_128_intdigest(b" ".join(words[a:b]) + b"\n" * (b - a == size < RUN_WORDS))
            out.append((start, end, (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63, b - a, k))
    return out


def _local_minima(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where a word's hash with the next word's is smallest among ``REACH`` on either side (of equals the first).

    Only where so many stand on either side within the sentence or line, of which ``begin`` has the first words.
    """
    n = len(h)
    x = np.zeros(n + 2 * REACH, np.uint64)
    x[REACH : REACH + n] = (h * np.uint64(0x9E3779B97F4A7C15) + np.append(h[1:], np.uint64(0))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(8)
    size = np.diff(begin, append=n)
    place = np.arange(n) - np.repeat(begin, size)
    own, out = x[REACH : REACH + n], (place >= REACH) & (np.repeat(size, size) - place > REACH)
    for k in range(1, REACH + 1):
        out &= (own < x[REACH - k : REACH - k + n]) & (own <= x[REACH + k : REACH + k + n])
    # one word over and over has no smallest place: such a row is cut at its start and every RUN_WORDS words
    same = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (place[1:] == 0)))
    length = np.diff(same, append=n)
    return out | ((np.repeat(length, length) >= 2 * RUN_WORDS) & ((np.arange(n) - np.repeat(same, length)) % RUN_WORDS == 0))


def spans_of(start: np.ndarray, end: np.ndarray, words: np.ndarray, line: np.ndarray, first: dict, run_words: int) -> tuple[list[tuple], int]:
    """Spans (start, end, first document) to remove, and their words; ``first``: the first document of each repeated unit, by its number."""
    out, units_, i, gone = [], sorted(first), 0, 0
    while i < len(units_):
        j = i + 1
        while j < len(units_) and units_[j] == units_[j - 1] + 1 and line[units_[j]] == line[units_[i]]:
            j += 1
        a, b = units_[i], units_[j - 1]
        whole = (a == 0 or line[a - 1] != line[a]) and (b + 1 == len(line) or line[b + 1] != line[b])
        if whole or words[a : b + 1].sum() >= run_words:
            gone += int(words[a : b + 1].sum())
            for k, u in enumerate(units_[i:j]):
                if k and first[u] == out[-1][2]:
                    out[-1] = (out[-1][0], int(end[u]), first[u])
                else:
                    out.append((int(start[u]), int(end[u]), first[u]))
        i = j
    return out, gone


def units(text: str, paragraphs: bool, min_words: int) -> list[tuple[int, int, int, int, int, int]]:
    """Start, end, digest (two numbers of 64 bits), words and line (with ``paragraphs`` a number of its own) of each unit that is long enough."""
    if not paragraphs:
        return pieces(text, min_words)
    out, start = [], 0
    ends = [(m.start(), m.end()) for m in _PARAGRAPH.finditer(text)]
    for end, next_ in [*ends, (len(text), len(text))]:
        words = text[start:end].encode("utf-8", "surrogatepass").lower().split()
        if words and len(words) >= min_words:
            digest = xxhash.xxh3_128_intdigest(b" ".join(words))
            out.append((start, end, (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63, len(words), len(out)))
        start = next_
    return out


def _newlines(text: str) -> list[int]:
    out, i = [], text.find("\n")
    while i >= 0:
        out.append(i)
        i = text.find("\n", i + 1)
    return out


def repeated_units(df: DataFrame, ws: Workspace, min_words: int = 8, paragraphs: bool = False, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS, row_col: str | None = None) -> DataFrame:
    """A row for each document: ``doc_id, n_units, n_removed, removed_chars, n_words, removed_words, removed`` (start, end, first_doc_id), ``row``.

    ``row_col`` may name a column of distinct numbers that tells rows apart, in order of rank for equal ids; else one is made.
    """
    bounded_batches(df.sparkSession)

    @F.pandas_udf("n_words long, start array<long>, end array<long>, high array<long>, low array<long>, words array<long>, line array<long>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        found = [units(t or "", paragraphs, min_words) for t in texts]
        cols = [[np.array([u[k] for u in row], np.int64) for row in found] for k in range(6)]
        n_words = [len((t or "").encode("utf-8", "surrogatepass").split()) for t in texts]
        return pd.DataFrame({"n_words": n_words, "start": cols[0], "end": cols[1], "high": cols[2], "low": cols[3], "words": cols[4], "line": cols[5]})

    id_type = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    row = df[row_col] if row_col else F.monotonically_increasing_id()
    docs = ws.keep(df.select(df[id_col].alias("doc_id"), row.alias("row"), cut(text).alias("c")).select("doc_id", "row", "c.*"), "units")
    each = docs.select("doc_id", "row", F.posexplode(F.arrays_zip("start", "end", "high", "low")).alias("unit", "u")).select("doc_id", "row", "unit", "u.*")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "unit")
    first = ws.keep(each.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c"), "first")
    again = each.join(first, ["high", "low"]).filter((F.col("row") != F.col("first.row")) | (F.col("unit") != F.col("first.unit")))
    again = again.groupBy("row").agg(F.collect_list(F.struct("unit", F.col("first.doc_id").alias("first_doc_id"))).alias("again"))

    columns = ("start", "end", "words", "line", "again")

    @F.pandas_udf(f"removed array<struct<start:long,end:long,first_doc_id:{id_type}>>, removed_words long")
    def chosen(*series: pd.Series) -> pd.DataFrame:
        found = [([], 0) if a is None else spans_of(s, e, w, k, {u["unit"]: u["first_doc_id"] for u in a}, run_words) for s, e, w, k, a in zip(*series, strict=True)]
        removed = [[dict(zip(("start", "end", "first_doc_id"), x, strict=True)) for x in row] for row, _ in found]
        return pd.DataFrame({"removed": pd.Series(removed, dtype=object), "removed_words": pd.Series([n for _, n in found], dtype="int64")})

    # the units of a row without repeats stay out of Python
    needed = [F.when(F.col("again").isNotNull(), F.col(c)) for c in columns]
    joined = docs.join(again, "row", "left").select("doc_id", "row", "n_words", F.size("start").cast("long").alias("n_units"), chosen(*needed).alias("c"))
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return joined.select("doc_id", "row", "n_words", "n_units", "c.*").select("doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), chars.alias("removed_chars"), "n_words", "removed_words", "removed", "row")


def without_repeats(df: DataFrame, ws: Workspace, min_words: int = 8, paragraphs: bool = False, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """``df`` with later occurrences cut out of the text (a whole line with its end), and their original offsets in ``removed``."""
    row, spans = fresh(df, "_row", "_removed")
    marked = ws.keep(df.withColumn(row, F.monotonically_increasing_id()), "marked")
    found = repeated_units(marked, ws, min_words, paragraphs, id_col, text_col, run_words, row).filter("n_removed > 0")
    found = found.select(F.col("row").alias(row), F.col("removed").alias(spans))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, of: pd.Series) -> pd.Series:
        out = []
        for text, row in zip(texts, of, strict=True):
            parts, at, whole = [], 0, False
            for s in [] if row is None else row:
                parts.append(text[at : s["start"]])
                whole = s["start"] == 0 or text[s["start"] - 1] == "\n" or (whole and at == s["start"])
                at = min(len(text), s["end"] + (whole or text[s["end"] : s["end"] + 1] != "\n"))
            out.append(text if text is None else "".join(parts) + text[at:])
        return pd.Series(out)

    joined = marked.join(found, row, "left")
    return joined.select(*[cut(F.col(text_col).cast("string"), F.col(spans)).alias(c) if c == text_col else F.col(c) for c in df.columns], F.col(spans).alias(fresh(df, "removed")[0]))
