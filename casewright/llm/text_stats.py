"""Counts over whole texts, for a batch at a time: shared by the quality rules and the quality classifier.

Words are stretches without ASCII white space, as ``bytes.split()`` finds them. A null text counts as empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import bounded_batches, numbered, portions, sum_by_row

_ASCII = bytes(range(128))
_WHITE = b" \t\n\x0b\x0c\r"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_DIGIT = b"0123456789"
#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
_STOPS = b".,;:!?\"'()-"
_LATER_BYTES = bytes(range(0x80, 0xC0))  # second and later bytes of a letter

COUNTS = ("n_bytes", "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_digits", "n_stops", "n_ascii", "longest_word", "n_title_words", "n_repeat_pairs")


def _left(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def measure(texts: list[str]) -> pd.DataFrame:
    """The ``COUNTS`` of each text."""
    out = {k: np.zeros(len(texts), np.int64) for k in COUNTS}
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    for part in portions(raws):
        cut = []
        for i in range(part.start, part.stop):
            raw = raws[i]
            words = raw.split()
            cut.append(words)
            white = _left(raw, _WHITE)
            chars = len(raw.translate(None, _LATER_BYTES))
            lines = [x for x in raw.split(b"\n") if x.strip()]
            row = (len(raw), chars, len(words), chars - white, _left(raw, SYMBOLS), len(lines), len(lines) - len(set(lines)), 0, len(set(words)), _left(raw, _UPPER), _left(raw, _DIGIT), _left(raw, _STOPS), _left(raw, _ASCII), max(map(len, words), default=0), 0, 0)
            for k, v in zip(COUNTS, row, strict=True):
                out[k][i] = v
        repeats, pairs, titles = _repeated(cut)
        out["n_repeat_words"][part], out["n_repeat_pairs"][part], out["n_title_words"][part] = repeats, pairs, titles
    return pd.DataFrame(out)


def _repeated(cut: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in windows of three that their text has twice or more, word pairs seen before, and words with a capital first."""
    n = np.fromiter(map(len, cut), np.int64, len(cut))
    code, words = numbered([w for row in cut for w in row])
    if not len(code):
        return np.zeros(len(cut), np.int64), np.zeros(len(cut), np.int64), np.zeros(len(cut), np.int64)
    title = np.fromiter((65 <= w[0] <= 90 and not w.isupper() for w in words), np.int64, len(words))
    doc = np.repeat(np.arange(len(cut)), n)
    count = len(words)
    two = pd.factorize(code[:-1] * count + code[1:])[0]
    same = doc[1:] == doc[:-1]
    pair = pd.factorize(two[same] * len(cut) + doc[:-1][same])[0]
    seen = np.ones(len(pair), np.int64)
    seen[np.unique(pair, return_index=True)[1]] = 0
    pairs = np.bincount(doc[:-1][same], seen, len(cut)).astype(np.int64)
    mark = np.zeros(len(code) + 2, bool)
    if len(code) > 2:
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        three = pd.factorize(two[:-1][inside] * count + code[2:][inside])[0]
        own = pd.factorize(three * len(cut) + doc[inside])[0]
        twice = inside[np.bincount(own)[own] > 1] if len(own) else inside
        for k in range(3):
            mark[twice + k] = True
    return sum_by_row(mark[: len(code)].astype(np.int64), n), pairs, sum_by_row(title[code], n)


def with_stats(df: DataFrame, text_col: str, keep: dict[str, str]) -> DataFrame:
    """The columns ``keep`` (old name: new name) and the ``COUNTS`` of the text."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf(", ".join(f"{k} long" for k in COUNTS))
    def counts(texts: pd.Series) -> pd.DataFrame:
        return measure([t or "" for t in texts])

    chosen = df.select(*[df[a].alias(b) for a, b in keep.items()], counts(df[text_col].cast("string")).alias("m"))
    return chosen.select(*keep.values(), "m.*")
