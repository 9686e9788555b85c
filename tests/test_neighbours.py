"""The neighbour queries do their whole job."""

from pyspark.sql import functions as F

from casewright.operators import blocks, retrieval
from casewright.plans.queries import QUERIES, _sides


def test_every_case_is_predicted(spark, sf_dir):
    want = {r.o_orderkey for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").collect()}
    got = [r.case_id for r in QUERIES["knn_predictions"](spark, sf_dir).select("case_id").collect()]
    assert len(got) == len(want) and set(got) == want


def test_references_by_terms_are_read_not_dealt(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TARGETS", 8)
    monkeypatch.setattr(blocks, "REFERENCES", 16)
    texts = [" ".join([f"w{i % 3}"] * (1 + i % 2) + ["all"] * (i % 5)) for i in range(60)]
    rows = spark.createDataFrame([(i, i % 7, ["a", "b"][: 1 + i % 2], float(i), texts[i]) for i in range(60)], "case_id long, day int, articles array<string>, y double, text string").withColumn("judgment_date", F.date_from_unix_date("day"))
    counted = retrieval.counted_terms(rows, "text")
    assert {r.case_id: dict(zip(r.terms, r.tf, strict=True)) for r in counted.collect()} == {i: {w: t.split().count(w) for w in t.split()} for i, t in enumerate(texts)}
    sides = counted.withColumn("at", F.transform("terms", lambda t: F.xxhash64(t))).withColumn("weights", F.transform("tf", lambda n: n / 10))
    found = retrieval.nearest_by_terms(sides, sides, (60, 60), 2)
    assert "CoGroup" not in found._jdf.queryExecution().toString()
    rows = found.collect()
    for i in range(60):
        want = sorted((-round(sum(texts[i].split().count(w) * texts[j].split().count(w) for w in set(texts[i].split())) / 100, 7), j) for j in range(60) if j % 7 < i % 7)[:2]
        assert sorted((-r.score, r.ref_id) for r in rows if r.target_id == i) == want


def test_the_case_view_is_made_once(spark, sf_dir):
    for side in _sides(spark, sf_dir)[:2]:
        assert "Join" not in side._jdf.queryExecution().toString()
