"""The pipeline's stages against plain versions, on a small table."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from casewright.llm import quality_model, queries, text_stats

from .test_operators import DOCS, MODEL, documents, edited, invented, plain_components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng, top = random.Random(1), tmp_path_factory.mktemp("sf")
    texts = invented(200, 20, 80, 900)
    texts += texts[:20] + [edited(t, rng, 0.004) for t in texts[20:60]] + [re.sub(r"(\w+)", r"\1$$$", t) for t in texts[60:120]]
    documents(spark, texts).selectExpr("*", "length(text) as n_chars").write.parquet(f"{top}/documents.parquet")
    labels = [(i, int("$" not in t), 0) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return f"file://{top}"


def test_stages(spark, folder, ws):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "source_mix", "piece_codec"] and DOCS and MODEL
    step = dict(corpus_pipeline.STAGES)
    good = ws.keep(step["quality_classifier"](spark, docs, folder), "a")
    taught = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    ids = sorted(taught)
    model = quality_model.fit(quality_model.features(text_stats.measure([texts[i] for i in ids])), np.array([taught[i] for i in ids], float))
    scores = model.score(quality_model.features(text_stats.measure([texts[i] for i in sorted(texts)])))
    want = {i for i, x in zip(sorted(texts), scores, strict=True) if x >= 0.3}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == want and sum("$" in texts[i] for i in want) <= 3
    first = ws.keep(step["exact_dedup"](spark, good, folder), "b")
    kept = {}
    for i in sorted(r.doc_id for r in good.collect()):
        kept.setdefault(re.sub(r"\s+", " ", texts[i]), i)
    assert first.columns == columns and {r.doc_id for r in first.collect()} == set(kept.values())
    near = ws.keep(step["near_dedup"](spark, first, folder), "c")
    ids = sorted(kept.values())
    want = {ids[c] for i, (_, c) in plain_components([texts[i] for i in ids], 5, 80).items()}
    assert near.columns == columns and {r.doc_id for r in near.collect()} == want
    mixed = ws.keep(step["source_mix"](spark, near, folder), "d")
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().filter("count > 2").count() == 0 and mixed.count() > 0
    last = step["piece_codec"](spark, mixed, folder)
    assert last.count() == mixed.count() and last.filter("not round_trip").count() == 0


BIG = 2**60 + 1


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, tmp_path, ws, empty):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(None, None, None, None, None, "x", 1), (None, "a b c", "en", "s", 5, "x", 1), (BIG, "a  b c", "en", "s", 5, "x", 1), (BIG, "a  b c", "en", "s", 5, "x", 1), (BIG + 2, "", "de", None, 0, "y", 2), (BIG + 4, long, "en", "s", 1, "y", 2)]
    rows += [(BIG + 6, long + " end", "en", "s", 1, "y", 2), (BIG + 8, "q" * 30_000, None, "t", 1, "y", 2)]
    form = "doc_id long, text string, lang string, source string, n_chars long, _id string, node int"
    spark.createDataFrame([] if empty else rows, form).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 1, 0), (BIG, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf_dir = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = ws.keep(stage(spark, docs, sf_dir), f"{k}{name}")
        left.append([tuple(r) for r in out.collect()])
        if k < 4:
            assert out.columns == docs.columns and set(left[-1]) <= set(rows)
        docs = out
    sizes = [len(x) for x in left]
    assert sizes == [0] * 5 if empty else (sizes[:3] == [8, 5, 4] and {r[0] for r in left[2]} == {BIG, BIG + 2, BIG + 4, BIG + 8} and sizes[3] == sizes[4] > 0)


def test_run_is_the_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "pieces", "n_pieces", "round_trip"] and out.count() > 0


def test_queries_cover_the_ten():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
