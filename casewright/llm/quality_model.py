"""A quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins. Boosting goes round the features in a cycle; each turn fits
a small tree (two cuts) on one feature's bins to the gradient of the logistic loss and adds a fraction of it
to the feature's table of bin values. Then the pairs of features whose joint residuals gain most get
tables of their own, boosted in the same way by trees with one cut on each feature. Scoring adds looked-up
bin values for arrays of rows.

The model is fitted on the driver on a bounded sample of labelled rows (``sample``, chosen by a digest of the
id); all rows are scored, each by its whole text.

Defined results: a null text counts as empty and is scored as such; without labels to learn from every
score is 0.5; label rows that are null or repeat (highest counts) are tolerated; ids are passed through, null
and repeated ones included; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import in_fold
from casewright.llm.text_stats import COUNTS, measure, with_stats


def features(c: pd.DataFrame) -> np.ndarray:
    """A row of features for each row of counts: sizes as logarithms, the rest as shares."""
    chars, words, lines = (np.maximum(c[k].to_numpy(float), 1) for k in ("word_chars", "n_words", "n_lines"))
    f = {k: c[k].to_numpy(float) for k in COUNTS}
    return np.column_stack([
        np.log1p(f["n_words"]), np.log1p(f["n_chars"]), f["word_chars"] / words, f["n_symbols"] / chars, f["n_upper"] / chars, f["n_digits"] / chars,
        f["n_stops"] / words, f["n_dup_lines"] / lines, f["n_repeat_words"] / words, f["n_repeat_pairs"] / words, f["n_distinct_words"] / words ** 0.9,
        np.log1p(f["longest_word"]), f["n_words"] / lines, f["n_title_words"] / words, (f["n_bytes"] - f["n_ascii"]) / np.maximum(f["n_bytes"], 1),
    ])


@dataclass
class AdditiveModel:
    """Bin edges, one table for each feature, coarser edges and a table for each pair."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, k], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values for bins of a tree with two cuts, from sums of gradients and curvatures by bin."""
    values = np.zeros(len(g))
    parts = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, None)
        for low, high in parts:
            if high - low < 2:
                continue
            cg, ch = np.cumsum(g[low:high]), np.cumsum(h[low:high])
            gain = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1) - cg[-1] ** 2 / (ch[-1] + 1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (low, high), low + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    for low, high in parts:
        values[low:high] = _leaf(g[low:high].sum(), h[low:high].sum())
    return values


def _cut_pair(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on each side of a table of sums."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    total = lambda s: (s[:-1, :-1], s[:-1, -1:] - s[:-1, :-1], s[-1:, :-1] - s[:-1, :-1], s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + s[:-1, :-1])
    gain = sum(a**2 / (b + 1) for a, b in zip(total(G), total(H), strict=True)) - G[-1, -1] ** 2 / (H[-1, -1] + 1)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = np.zeros_like(g)
    for a in (slice(0, i + 1), slice(i + 1, None)):
        for b in (slice(0, j + 1), slice(j + 1, None)):
            values[a, b] = _leaf(g[a, b].sum(), h[a, b].sum())
    return float(gain[i, j]), values


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.15, bins: int = 32, coarse: int = 8) -> AdditiveModel:
    """Cyclic boosting; the same rows give the same model."""
    model = AdditiveModel()
    if not len(y):
        return model
    share = (y.sum() + 1) / (len(y) + 2)
    model.base = float(np.log(share / (1 - share)))
    n = x.shape[1]
    model.edges = [_edges(x[:, k], bins) for k in range(n)]
    model.coarse = [_edges(x[:, k], coarse) for k in range(n)]
    at = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    raw = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(n):
            g, h = slopes()
            add = rate * _tree(np.bincount(at[k], g, len(model.tables[k])), np.bincount(at[k], h, len(model.tables[k])))
            model.tables[k] += add
            raw += add[at[k]]
    rough = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.coarse)]
    shape = [len(e) + 1 for e in model.coarse]
    g, h = slopes()
    sums = lambda a, b, v: np.bincount(rough[a] * shape[b] + rough[b], v, shape[a] * shape[b]).reshape(shape[a], shape[b])
    gains = sorted(((_cut_pair(sums(a, b, g), sums(a, b, h))[0], a, b) for a in range(n) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in gains[:pairs] if gain > 1]
    model.pair_tables = [np.zeros((shape[a], shape[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for table, (a, b) in zip(model.pair_tables, model.pairs, strict=True):
            g, h = slopes()
            add = rate * _cut_pair(sums(a, b, g), sums(a, b, h))[1]
            table += add
            raw += add[rough[a], rough[b]]
    return model


def teach(df: DataFrame, labels: DataFrame, sample: int = 40_000, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AdditiveModel:
    """Fit on about ``sample`` labelled rows outside fold 0, or on all if there are fewer; the sample goes by a digest of the id.

    Ids and labels of the sample, bounded by it, are broadcast; the texts stay where they are.
    """
    marked = labels.select(labels[id_col].alias("_id"), labels[label_col].alias("_label")).filter("_label is not null and _id is not null")
    marked = marked.filter(~in_fold("_id", 0, folds)).groupBy("_id").agg(F.max("_label").alias("_label"))
    share = min(1.0, sample / max(1, marked.count()))
    marked = marked.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    taught = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).join(F.broadcast(marked), F.col("doc_id") == F.col("_id"))
    rows = with_stats(taught, "text", {"doc_id": "doc_id", "_label": "label"}).toPandas().sort_values(["doc_id", *COUNTS], ignore_index=True)
    return fit(features(rows), (rows["label"].to_numpy(float) == 1).astype(float)) if len(rows) else AdditiveModel()


def score_column(model: AdditiveModel):
    """A function of a text column: the score."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(features(measure([t or "" for t in texts]))))

    return score


def score_quality(df: DataFrame, labels: DataFrame, cutoff: float = 0.3, sample: int = 40_000, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row; rows of fold 0 never teach."""
    score = score_column(teach(df, labels, sample, folds, id_col, text_col, label_col))
    rows = df.select(df[id_col].alias("doc_id"), in_fold(df[id_col], 0, folds).alias("held_out"), score(df[text_col].cast("string")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def good_documents(df: DataFrame, labels: DataFrame, cutoff: float = 0.3, **how) -> DataFrame:
    """The rows of ``df`` that are not rejected, whole; nothing is shuffled."""
    score = score_column(teach(df, labels, **how))
    return df.filter(score(df[how.get("text_col", "text")].cast("string")) >= cutoff)
