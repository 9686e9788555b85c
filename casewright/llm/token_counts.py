"""Token counts by rank-synchronous merging of ragged arrays.

A batch of texts is cut into pre-tokens. The distinct ones not seen before lie in one ragged array of
symbols; each step finds the lowest-rank pair of every pre-token and merges it at all its places in
all pre-tokens at once, until no pair is left (see ``bpe.PieceModel.merge``). The symbols that survive
are counted, letters outside the vocabulary by their bytes.

Defined results: a null text counts as empty and has 0 bytes and 0 tokens; ids are passed through,
nulls and repeated rows included (they never enter Python); an empty table gives no rows; other columns are
not looked at. Work is by row: nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.bpe import WordCache, piece_model, pre_tokens
from casewright.llm.common import bounded_batches, numbered, portions, sum_by_row

_caches: dict[str, WordCache] = {}


def count_tokens(texts: list[str], model_path: str) -> np.ndarray:
    """Tokens of each text as the library for the model gives them, without begin or end tokens."""
    model = piece_model(model_path)
    if model.unigram:
        raise ValueError("a unigram model has no merges to count by")
    cache = _caches.setdefault(model_path, WordCache(800_000))
    out = []
    for part in portions(texts):
        cut = [pre_tokens(model.normalised(t)) for t in texts[part]]
        lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        codes, words = numbered([w for row in cut for w in row])
        each = np.array(cache.look_up(words, lambda w: model.counts(w).tolist()), np.int64)
        out.append(sum_by_row(each[codes], lengths))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def token_counts(df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row."""
    bounded_batches(df.sparkSession)

    @F.pandas_udf("n_bytes long, n_tokens long")
    def count(column: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in column]
        size = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
        return pd.DataFrame({"n_bytes": size, "n_tokens": count_tokens(texts, model_path)})

    rows = df.select(df[id_col].alias("doc_id"), count(df[text_col].cast("string")).alias("m"))
    return rows.select("doc_id", "m.n_bytes", "m.n_tokens", (F.col("m.n_tokens") > limit).alias("over_limit"))
