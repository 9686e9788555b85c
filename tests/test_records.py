"""Error paths and odd values of joins, encoders, contracts, harvests, records and facts from texts; queries cover the plain ones."""

import json

import pytest
from pyspark.sql import functions as F

from casewright.functions import extract as E
from casewright.functions import text as X
from casewright.operators import blocks, boosting, contract, encode, joins, ranking, records, retrieval, sections
from casewright.sources import writers
from casewright.streaming import harvest


def frame(spark, rows, form):
    return spark.createDataFrame(rows, form)


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).head())


def test_joins_refuse_what_they_do_not_allow(spark):
    a, twice = frame(spark, [(1, "x"), (2, "y")], "k int, v string"), frame(spark, [(1, 5), (1, 6)], "k int, w int")
    with pytest.raises(Exception, match="key not unique at 1"):
        joins.unique(twice, ["k"], "t").collect()
    with pytest.raises(Exception, match="key not unique at null"):
        joins.unique(frame(spark, [(None, 5)], "k int, w int"), ["k"], "t").collect()
    with pytest.raises(ValueError, match="both sides"):
        joins.one_to_one(a, a, "k")
    with pytest.raises(Exception, match="metadata differs: v"):
        joins.merged_metadata(a, frame(spark, [(1, "z")], "k int, v string"), "k", ["v"]).collect()
    merged = joins.merged_metadata(a, frame(spark, [(1, " "), (3, "n")], "k int, v string"), "k", ["v"]).collect()
    assert {(r.k, r.v, tuple(r.conflicts)) for r in merged} == {(1, "x", ()), (2, "y", ()), (3, "n", ())}
    assert [r.v for r in spark.range(1).select(joins.first_known(F.array().cast("array<string>"), F.array(F.lit("3"))).alias("v")).collect()] == [["3"]]


def test_encoders_at_their_edges(spark):
    train = frame(spark, [(1, "b", 1.0), (2, None, 3.0), (3, "a", 3.0), (4, "<MISSING>", 0.0)], "id int, c string, y double")
    places = encode.first_seen(train, "c", "id")
    assert [(r.value, r.kind) for r in places.orderBy("place").collect()] == [("b", 0), ("a", 0), ("<MISSING>", 0), ("<MISSING>_", 1), ("<UNKNOWN>", 2)]
    rows = encode.dummy_place(frame(spark, [(1, "a"), (2, None), (3, "zz")], "id int, c string"), places, "c")
    assert {(r.id, r.place_c) for r in rows.collect()} == {(1, 2), (2, 4), (3, 5)}
    with pytest.raises(Exception, match="not negative"):
        encode.fit_target_scaler(frame(spark, [(-1.0,)], "y double")).collect()
    assert tuple(encode.fit_target_scaler(frame(spark, [(0.0,), (0.0,)], "y double")).head()) == (0.0, 1.0)
    with pytest.raises(Exception, match="missing in all of training"):
        encode.native_categories(train, train.withColumn("y", F.lit(None).cast("double")), [], ["y"]).filter("y is null or id > 0").select((F.col("y") + 1).alias("z"), "id").collect()
        encode.native_categories(train.withColumn("y", F.lit(None).cast("double")), train.withColumn("y", F.lit(None).cast("double")), [], ["y"]).collect()
    with pytest.raises(Exception, match="more than 2 values"):
        encode.vocabulary(train, "c", most=2).collect()


def test_contracts(spark):
    rows = frame(spark, [(i, None if i % 2 else "x") for i in range(50)], "id int, v string")
    digest = contract.set_digest(rows, ["id", "v"]).head()
    assert digest.n == 50 and digest == contract.set_digest(rows.repartition(7).orderBy(F.desc("id")), ["id", "v"]).head()
    assert contract.set_digest(rows, ["id", "v"], digits=1).head().digest != digest.digest and contract.set_digest(rows.limit(0), ["id"]).head().n == 0
    found = contract.inventory(frame(spark, [("a", "1"), ("b", "2")], "path string, sha256 string"), frame(spark, [("a", "1"), ("b", "3"), ("c", "4")], "path string, sha256 string"))
    assert {(r.path, r.problem) for r in found.collect()} == {("b", "digest_differs"), ("c", "not_there")}


def test_harvests(spark):
    known, page = frame(spark, [(1, "a"), (2, "b")], "id int, v string"), frame(spark, [(2, "b"), (1, "c"), (3, "d")], "id int, v string")
    assert {(r.id, r.state) for r in harvest.checkpointed(known, page, "id", ["v"]).collect()} == {(2, "duplicate"), (1, "conflict"), (3, "new")}
    lines = frame(spark, [('{"itemid": "7", "ts": 2, "problem": "b"}',), ('{"itemid": "7", "ts": 1, "problem": "a"}',), ("[1]",), ('{"itemid"',), (None,)], "line string")
    assert [[r["problem"] for r in row.records] for row in harvest.problems(lines, "line").collect()] == [["a", "b"]]


def test_record_gates(spark):
    rows = frame(spark, [(1, "train", "unknown"), (2, "x", "-1")], "case_id int, split string, n string")
    with pytest.raises(Exception, match="unknown split: x"):
        rows.select(records.split_name(F.col("split")).alias("s")).collect()
    with pytest.raises(Exception, match="not a number of zero or more"):
        records.feature_frame(rows, ["split"], ["n"]).collect()
    with pytest.raises(ValueError, match="award_eur"):
        records.reject_names(["country", "award_eur"])
    with pytest.raises(ValueError, match="not allowed"):
        records.covariates(rows, rows, "case_id", ["n"])
    with pytest.raises(Exception, match="no covariates for 2"):
        records.covariates(rows, rows.filter("case_id = 1").select("case_id", "n"), "case_id", ["n"]).collect()
    assert records.group_of(rows, ["n", "none"]).columns == ["n"] and records.kept_by_name(rows, ["n"], ["spl"]).columns == ["split", "n"]
    with pytest.raises(ValueError, match="no values"):
        records.messages({}, "a {b}", "c")
    assert [(r.name, r.kind) for r in records.feature_schema(rows, {}).orderBy("position").collect()] == [("case_id", "number"), ("split", "category"), ("n", "category")]
    good = {"profile": "metadata_knn", "columns": ["a"], "lineage": {"a": {"source_group": "metadata", "source_reference": "x"}}}
    assert records.profile_problems(good) == [] and records.profile_problems({"columns": ["split", "split"], "historical_reproduction": True}) == [
        "duplicate columns", "forbidden: split", "forbidden: split", "lineage: split", "lineage: split", "historical reproduction",
    ]
    with pytest.raises(ValueError, match="unknown mode"):
        records.module_gate(rows, "x", {})


def test_json_records(spark):
    schema = {"type": "object", "additionalProperties": False, "properties": {"a": {"type": ["integer", "null"], "minimum": 1}, "b": {"type": "array", "items": {"enum": ["x"]}}}}
    assert records.schema_errors({"a": 0, "b": ["x", "y"], "c": 1}, schema) == ["$.c: not known", "$.a: below 1", "$.b[1]: not one of ['x']"] and records.schema_errors({"a": True}, schema) == ["$.a: not integer or null"]
    value, problems = one(spark, records.sanitised(F.lit("[broken"), ["a"]), records.json_problems(F.lit(None).cast("string"), schema))
    assert value.value is None and value.removed == [] and problems == ["$: not JSON"]
    assert E.catalogue(json.loads('{"a": [{"b": "xy"}], "n": null, "k": 1.5}')) == {
        "type": "object", "field_count": 3, "fields": ["a", "n", "k"],
        "children": {"a": {"type": "list", "length": 1, "item_schema": {"type": "object", "field_count": 1, "fields": ["b"]}}, "n": {"type": "null"}, "k": {"type": "float"}},
    }


def test_facts_from_texts(spark):
    assert E.claimed("He claimed EUR 500 and 600 euros for costs before the Court; EUR 7 for non-pecuniary damage was claimed before the Court. The district court awarded damages claimed of EUR 9.") == [("costs", 500.0, "EUR"), ("costs", 600.0, "EUR"), ("bundled", 7.0, "EUR")]
    assert E.claimed("She sought 7 euros for pecuniary damage and costs.", "facts_text") == [("bundled", 7.0, "EUR")] and E.claimed("She sought 7 euros for damage.") == [] and E.claimed(None) == []
    text = "is to pay the following amounts:\nEUR 5 in respect of costs\n\nEUR 6 for costs\nThat from the expiry\nEUR 7"
    block, blocks_, rest = one(spark, E.following_amounts(F.lit(text)), E.blocks_at(F.lit("head\n12/34\na\n56/78\nb"), r"^\s*\d{1,6}/\d{2}\s*$"), E.blocks_at(F.lit(" no marks "), "^x$"))
    assert block == "EUR 5 in respect of costs\n\nEUR 6 for costs".replace("\n\n", "\n") and [b.split() for b in blocks_] == [["12/34", "a"], ["56/78", "b"]] and rest == ["no marks"]
    nothing = one(spark, E.awards(F.lit(None).cast("string")))[0]
    assert (nothing.non_pecuniary, nothing.vote, nothing.quality) == (None, "unknown", "none")
    paid = one(spark, E.awards(F.lit("ITL 3,000 (approximately EUR 1,549.5) in respect of non-pecuniary damage; less EUR 5; EUR 20 for costs")))[0]
    assert (paid.non_pecuniary, paid.costs, paid.net_costs) == (1549.5, 20.0, 15.0)
    rows = one(spark, E.evidence({"article_41": F.lit("The applicant claimed EUR 5 for costs.\n\nThe Court awards Ms Ann Lee, together, EUR 5 and 6 euros, each.\n\nEUR 9"), "operative": F.lit(None).cast("string")}))[0]
    assert [(r.kind, r.head, r.amount, r.joint, r.labels) for r in rows] == [("claim", "costs", 5.0, None, ["The applicant"]), ("award", None, 5.0, False, ["Ms Ann Lee"]), ("award", None, 6.0, False, ["Ms Ann Lee"])]
    assert one(spark, E.title_case(F.lit("ANN de  LEE-ROE X")), E.person_name(F.lit("Mr. Ann  O'Neil-Lee")), E.money_text(F.lit(1234.5)), E.money_text(F.lit(1000.0))) == ("Ann de Lee-roe X", "ann o neil lee", "1,234.5", "1,000")
    assert one(spark, E.decision_body(F.lit(None), F.lit("")), E.limb(F.lit("x"), F.lit("Civil")), E.limb(F.lit("civil and criminal"))) == (None, "civil", "ambiguous")
    sentence = lambda *heads: E.award_sentence(dict(zip(("non_pecuniary", "pecuniary", "costs"), map(F.lit, heads), strict=True)), F.lit(7))
    assert one(spark, sentence(None, None, None), sentence(1, None, None), sentence(1, 2, None)) == ("The Court awarded a bundled EUR 7 award.", "The Court awarded EUR 1 for non-pecuniary damage.", "The Court awarded EUR 1 for non-pecuniary damage and EUR 2 for pecuniary damage.")
    assert one(spark, X.heading_name(F.lit("THE COURT’S ASSESSMENT")), X.heading_name(F.lit(None).cast("string")), X.heading_name(F.lit("x"), F.lit("Conclusion"))) == ("assessment_summary", "unclassified", "conclusion_misc")


def test_blocks_are_many_and_small(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TARGETS", 2)
    monkeypatch.setattr(blocks, "REFERENCES", 3)
    rows = frame(spark, [(i, i % 5, ["a", "b"][: 1 + i % 2] if i % 4 else None, float(i)) for i in range(40)], "case_id long, day int, articles array<string>, y double").withColumn("judgment_date", F.date_from_unix_date("day"))
    from casewright.operators import retrieval

    got = {(r.target_id, r.ref_id) for r in retrieval.eligible(rows, rows, (40, 40)).collect()}
    assert got == {(i, j) for i in range(40) for j in range(40) if i % 4 and j % 4 and i != j and j % 5 < i % 5}


def counted_cells(monkeypatch):
    """Small cells, and how many targets each turn deals out."""
    monkeypatch.setattr(blocks, "TARGETS", 16)
    monkeypatch.setattr(blocks, "REFERENCES", 16)
    dealt, in_cells = [], retrieval.in_cells
    monkeypatch.setattr(retrieval, "in_cells", lambda targets, *args, **how: (dealt.append(targets.count()), in_cells(targets, *args, **how))[1])
    return dealt


def odd_cases(spark):
    kinds = [(["a"], "x", "n"), (["a", "b"], "y", "n"), (["b", "c", "d"], "x", "n"), (["c"], None, None), (None, "y", "n"), (["a", "b", "c"], "z", "s")]
    rows = [(i, (i * 7) % 90, *kinds[(i * i + i // 9) % len(kinds)], str(i % 2), "F" if i % 3 else None, i % 4, float(i)) for i in range(160)]
    rows = frame(spark, [(*r, len(r[2] or [])) for r in rows], "case_id long, day int, articles array<string>, country string, region string, importance string, formation string, n_applicants long, y double, n_articles long")
    return rows.withColumn("judgment_date", F.date_from_unix_date("day"))


def test_later_turns_take_only_undecided_targets(spark, monkeypatch):
    dealt, rows = counted_cells(monkeypatch), odd_cases(spark)
    order = [F.desc("score"), F.asc("ref_id")]
    got = {(r.target_id, r.ref_id, round(r.score, 9)) for r in retrieval.top_k(retrieval.nearest(rows, rows, (160, 160), 3), ["target_id"], order, 3).collect()}
    want = {(r.target_id, r.ref_id, round(r.score, 9)) for r in retrieval.top_k(retrieval.case_pairs(rows, rows), ["target_id"], order, 3).collect()}
    assert got == want and dealt[0] == 160 and all(n < 160 for n in dealt[1:])


def test_cascade_looks_at_all_pairs_of_no_target_that_needs_fewer(spark, monkeypatch):
    dealt, rows = counted_cells(monkeypatch), odd_cases(spark)
    steps = [("articles", (F.col("shared") == F.col("t_n_articles")) & (F.col("shared") == F.col("r_n_articles"))), *((c, F.col(f"t_{c}") == F.col(f"r_{c}")) for c in retrieval.STEPS[1:5]), ("recent", F.col("days") <= 1825)]
    for always in (2, 0):
        got = {(r.target_id, r.ref_id) for r in retrieval.narrowed(rows, rows, (160, 160), enough=3, always=always).collect()}
        want = {(r.target_id, r.ref_id) for r in ranking.cascade(retrieval.case_pairs(rows, rows), ["target_id"], steps, 3, always).collect()}
        assert got == want
        if always:
            assert len(dealt) > 2 and all(n < 160 for n in dealt[1:])


def test_points_of_a_grid_are_met_first(spark, monkeypatch):
    dealt = counted_cells(monkeypatch)
    rows = odd_cases(spark).withColumn("z", F.col("n_applicants") / 3)
    found = [retrieval.nearest_by_features(rows, rows, ["z"], (160, 160), 3, grid=grid) for grid in (True, False)]
    order = [F.asc(F.round("distance", 9)), F.asc("ref_id")]
    got, want = ({(r.target_id, r.ref_id, r["rank"]) for r in retrieval.top_k(f, ["target_id"], order, 3).collect()} for f in found)
    assert got == want and dealt[1] < 160


def test_vectors_are_ranked_within_cells(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TARGETS", 4)
    monkeypatch.setattr(blocks, "REFERENCES", 3)
    vector = lambda i: None if i % 7 == 0 else [float(i % 5 - 2), float(i % 3), 1.0]
    rows = frame(spark, [(i, i % 6, ["a", "b"][: 1 + i % 2], float(i), vector(i)) for i in range(48)], "case_id long, day int, articles array<string>, y double, v array<float>").withColumn("judgment_date", F.date_from_unix_date("day"))
    found = retrieval.nearest_by_vectors(rows, rows, "v", (48, 48), 2).collect()
    assert len(found) <= 48 * 16 * 2  # the best two of each cell, not all pairs

    def score(i, j):
        a, b = vector(i), vector(j)
        return 0.0 if a is None or b is None else sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5

    for i in range(48):
        got = sorted((-round(r.score, 7), r.ref_id) for r in found if r.target_id == i)[:2]
        want = sorted((-round(score(i, j), 7), j) for j in range(48) if j % 6 < i % 6)[:2]
        assert [j for _, j in got] == [j for _, j in want]


def test_terms_are_ranked_within_cells(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TARGETS", 4)
    monkeypatch.setattr(blocks, "REFERENCES", 12)
    texts = [None if i % 11 == 0 else " ".join(["all", f"w{i % 4}", f"w{i % 4}", f"x{i % 9}", f"only{i}"][: 1 + i % 5]) for i in range(48)]
    rows = frame(spark, [(i, i % 6, ["a", "b"][: 1 + i % 2], float(i), texts[i]) for i in range(48)], "case_id long, day int, articles array<string>, y double, text string").withColumn("judgment_date", F.date_from_unix_date("day"))
    words = retrieval.terms(rows, "case_id", "text")
    sides = retrieval.term_vectors(rows, words, F.col("tf") / 10, retrieval.hash_seed(words.select("term").distinct()))
    found = retrieval.nearest_by_terms(sides, sides, (48, 48), 2).collect()
    assert len(found) <= 48 * 16 * 2  # the best two of each cell, not all pairs
    count = [{w: (t or "").split().count(w) for w in (t or "").split()} for t in texts]
    for i in range(48):
        got = sorted((-round(r.score, 7), r.ref_id) for r in found if r.target_id == i)[:2]
        assert got == sorted((-round(sum(n * count[j].get(w, 0) for w, n in count[i].items()) / 100, 7), j) for j in range(48) if j % 6 < i % 6)[:2]


def test_routes_packets_and_results(spark, tmp_path):
    rows = frame(spark, [(1, ["6", "3", "6"], "a criminal conviction", "GRANDCHAMBER", "2", "nor;swe"), (2, ["8"], None, None, "x", None)], "case_id int, articles array<string>, facts string, branch string, importance string, country string")
    got = {r.case_id: r for r in records.route_state(rows, "strict").collect()}
    assert (got[1].articles, got[1].limb, got[1].formation, got[1].importance, got[1].country) == (["3", "6"], "criminal", "Grand_Chamber", 2, "NOR") and (got[2].limb, got[2].limb_ambiguous, got[2].importance) == (None, False, None)
    seen = {r.case_id: (r.packet, r.n_fields) for r in records.packets(rows, {"blind": ["facts", "country", "none"]}, "blind").collect()}
    assert seen == {1: ('{"country":"nor;swe","facts":"a criminal conviction"}', 2), 2: ("{}", 0)}
    with pytest.raises(ValueError, match="unknown mode"):
        records.packets(rows, {}, "blind")
    with pytest.raises(ValueError, match="forbidden"):
        records.packets(rows.withColumn("award", F.lit(1)), {"m": ["award"]}, "m")
    results = frame(spark, [(1, '{"names": "[\\"a\\", \\"a\\"]", "granted": "Yes", "n": 3}'), (2, "[]"), (3, None)], "k int, result string")
    out = {r.k: (r.names, r.granted, r.n, r.problem) for r in records.result_rows(results, "k", "names string, granted string, n int", ["names"], ["granted"]).collect()}
    assert out == {1: (["a"], True, 3, None), 2: ([], None, None, "not_an_object"), 3: ([], None, None, "not_an_object")}
    traces, answers = frame(spark, [(1, "a"), (1, "b")], "k int, action string"), frame(spark, [(1, 2.0)], "k int, p double")
    writers.write_traces(traces, answers, str(tmp_path / "run"), "k")
    assert spark.read.json(str(tmp_path / "run" / "traces")).count() == 2
    with pytest.raises(ValueError, match="first 7"):
        writers.write_traces(traces, frame(spark, [(1, 2.0), (7, 1.0)], "k int, p double"), str(tmp_path / "other"), "k")


def test_sections_stages_and_archives(spark, tmp_path):
    import io
    import zipfile

    assert one(spark, sections.first_useful(F.lit("THE LAW ON ALL OF THE MATTERS THAT WERE LEFT OUT HERE"), F.lit(None), F.lit("the applicant was born in a town by the sea")))[0].startswith("the applicant")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a", "1")
        z.writestr("../b", "2")
        z.writestr("c", "3")
    assert contract.archive_differences(data.getvalue(), {"a": b"1", "c": b"4", "d": b"5"}) == ["../b", "c", "d"]
    cases = frame(spark, [(1, "train", 2.0, 0.0), (2, "test", 1.0, 5.0)], "case_id int, split string, f double, y double")
    boosting.prepared(spark, cases, ["f"], str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x" / "records")).filter("split = 'test'").head().record == '{"f":1.0}'
    with pytest.raises(ValueError, match="forbidden"):
        boosting.prepared(spark, cases.withColumn("award", F.lit(1)), ["award"], str(tmp_path / "z"))
    vectors = {r.id: r.embedding for r in retrieval.hashed_vectors(frame(spark, [(1, "a b b"), (2, "B a b"), (3, "z")], "id int, text string"), "id", "text", 16).collect()}
    assert vectors[1] == pytest.approx(vectors[2]) and sum(v * v for v in vectors[3]) == pytest.approx(1)
