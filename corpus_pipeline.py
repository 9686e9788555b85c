"""A training corpus from raw documents: rejected by quality, exact and near copies dropped, mixed, encoded.

A stage takes the rows that its predecessor left, read again from Parquet; all but the last return the columns
of documents. Tables that a stage wrote for itself are deleted when the next one starts, and what a stage left when
its successor has been written.

Defined results: null and empty texts go the way of their score; where no label teaches, no document is rejected. Of
equal texts the row with the smallest id stays, rows without an id after all others. Of near copies the smallest id
stays, rows without an id all do, rows of one id together. The mix repeats whole rows and takes none of size 0.
Ids, also large ones beside nulls, and columns of any name are passed through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from casewright.llm.common import Workspace
from casewright.llm.exact_dedup import drop_copies
from casewright.llm.jaccard_join import one_of_each
from casewright.llm.piece_codec import encode
from casewright.llm.quality_model import good_documents
from casewright.llm.source_mix import mixed_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_open: list[Workspace] = []


def _workspace(spark: SparkSession, label: str) -> Workspace:
    """A new one; those of stages before, whose results are written by now, go."""
    while _open:
        _open.pop().drop()
    _open.append(Workspace(spark, label))
    return _open[-1]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _workspace(spark, "quality")
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs, _workspace(spark, "exact"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, _workspace(spark, "near"), words=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, _workspace(spark, "mix"))


def piece_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _workspace(spark, "pieces")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [(f.__name__, f) for f in (quality_classifier, exact_dedup, near_dedup, source_mix, piece_codec)]

#: SQL cannot express the classifier or the transducer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, kept, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = kept.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if before:
            kept.drop(before)
        before = f"{k}-{name}"
    return docs
