import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from casewright.sources import readers, web, writers
from casewright.streaming import ingest


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_strict_csv_rejects_short_rows_and_repeated_names(spark, tmp_path):
    good = readers.strict_csv(spark, put(tmp_path / "g.csv", 'a,b\n1,"x\ny"\n2,\n'), ["a"])
    assert [tuple(r) for r in good.collect()] == [("1", "x\ny"), ("2", "")]
    with pytest.raises(Exception, match="wrong number of fields"):
        readers.strict_csv(spark, put(tmp_path / "s.csv", "a,b\n1\n")).collect()
    with pytest.raises(ValueError, match="repeats"):
        readers.strict_csv(spark, put(tmp_path / "d.csv", "a,a\n1,2\n"))
    with pytest.raises(ValueError, match="lacks"):
        readers.strict_csv(spark, put(tmp_path / "m.csv", "a\n1\n"), ["z"])


def test_index_csv_takes_either_key(spark, tmp_path):
    got = readers.index_csv(spark, put(tmp_path / "i.csv", "﻿case_id,v\n7,x\n")).collect()
    assert got[0].itemid == "7"


def test_records_by_suffix(spark, tmp_path):
    put(tmp_path / "r.json", '{"rows": [{"id": 1}, {"id": 2}]}')
    put(tmp_path / "r.jsonl", '{"id": 3}\n')
    assert sorted(r.id for r in readers.records(spark, str(tmp_path / "r.json")).collect()) == [1, 2]
    assert [r.id for r in readers.records(spark, str(tmp_path / "r.jsonl")).collect()] == [3]
    with pytest.raises(ValueError):
        readers.records(spark, "x.xml")


def test_look_up_falls_back_and_exactly_one(spark):
    store, more = spark.createDataFrame([(1, "s")], "id int, v string"), spark.createDataFrame([(1, "f"), (2, "f")], "id int, v string")
    got = readers.look_up(spark.createDataFrame([(1,), (2,), (3,)], "id int"), store, more, "id")
    assert {(r.id, r.v) for r in got.collect()} == {(1, "s"), (2, "f")}
    assert readers.exactly_one(more, "id", 2).head().v == "f"
    with pytest.raises(Exception, match="not exactly one"):
        readers.exactly_one(more, "id", 9).collect()


def test_sidecar_last_or_all(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "id int, o int, v string")
    assert readers.sidecar(rows, "id", "o", False).head().v == "b"
    assert [x.v for x in readers.sidecar(rows, "id", "o", True).head().rows] == ["a", "b"]


def test_docx_blocks(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    xml = f"<w:document {w}><w:body>{p('Text')}{p('APPENDIX')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl></w:body></w:document>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "x.docx").write_bytes(data.getvalue())
    got = readers.docx(spark, str(tmp_path / "*.docx")).orderBy("block").collect()
    assert [(r.kind, r.text, r.in_appendix) for r in got] == [("paragraph", "Text", False), ("paragraph", "APPENDIX", True), ("table", "a | b", True)]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, float("nan"))], "id int, v double")
    with pytest.raises(Exception, match="not finite"):
        writers.write_jsonl(rows, str(tmp_path / "j"))
    nested = spark.createDataFrame([(1, [1, 2])], "id int, v array<int>")
    writers.write_csv(nested, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, escape='"').head().v == "[1,2]"
    old, new = spark.createDataFrame([(2, "b", 0), (1, "a", 1)], "id int, v string, o int"), spark.createDataFrame([(3, "d", 0), (2, "c", 1)], "id int, v string, o int")
    assert [(r.id, r.v) for r in writers.upserted(old, new, "id", "o").orderBy("o").collect()] == [(2, "c"), (1, "a"), (3, "d")]
    with pytest.raises(Exception, match="not unique"):
        writers.upserted(old, new.union(new), "id", "o").collect()


def test_single_files_and_summaries(spark, tmp_path):
    for text in ("one", "two é"):
        writers.write_file(spark, f"file://{tmp_path}/x.txt", text)
    assert (tmp_path / "x.txt").read_text() == "two é" and not (tmp_path / "x.txt.part").exists()
    counts = spark.createDataFrame([("a|b", 2)], "rule string, n int")
    assert writers.summary(counts, "Rules") == "# Rules\n\n| rule | n |\n|-|-|\n| a\\|b | 2 |\n"
    writers.write_distribution(spark.createDataFrame([("b", 1), ("a", 2)], "k string, n int"), str(tmp_path / "d"), ["k"])
    assert [f.read_text() for f in (tmp_path / "d").glob("*.csv")] == ["k,n\na,2\nb,1\n"]
    rows = spark.createDataFrame([("test", 7, 0.2, 3.0)], "split string, id int, y double, p double")
    assert tuple(writers.predictions(rows, "id", "y", "p").head()) == ("test", "7", 0.2, 3.0, 0, 1)
    files = spark.createDataFrame([("a.csv", "1"), ("b.exe", "2"), ("c.csv", "3")], "path string, sha256 string")
    listed = spark.createDataFrame([("a.csv", "1"), ("b.exe", "2"), ("d.csv", "4"), ("../e.csv", "5")], "path string, sha256 string")
    found = {r.path: r.reason for r in writers.planned_copies(files, listed, ("csv",)).collect()}
    assert found == {"a.csv": None, "b.exe": "kind", "c.csv": "not_listed", "d.csv": "not_there", "../e.csv": "unsafe_path"}


def test_readers_of_large_arrays_types_and_members(spark, tmp_path):
    items = [{"itemid": str(i), "text": "é" * 50 + "]," * (i % 3)} for i in range(40)] + [5, "x", [1, 2]]
    put(tmp_path / "big.json", json.dumps(items, ensure_ascii=False))
    with open(tmp_path / "big.json", "rb") as f:
        assert list(readers.json_items(f, 7)) == items
    got = {r.itemid: json.loads(r.record) for r in readers.json_array(spark, f"file://{tmp_path}/big.json", wanted=["3", "7", "none"]).collect()}
    assert got == {"3": items[3], "7": items[7]}
    assert readers.json_array(spark, f"file://{tmp_path}/big.json").count() == 43
    with pytest.raises(ValueError, match="no JSON array"):
        list(readers.json_items(io.BytesIO(b'{"a": 1}')))
    with pytest.raises(ValueError, match="does not end"):
        list(readers.json_items(io.BytesIO(b"[1, 2")))
    typed = readers.inferred_csv(spark, put(tmp_path / "t.csv", 'a,"b,c",d,e\n1,2.5,true,x\nNA,3,false,\n'))
    assert typed.dtypes == [("a", "bigint"), ("b,c", "double"), ("d", "boolean"), ("e", "string")] and [tuple(r) for r in typed.collect()] == [(1, 2.5, True, "x"), (None, 3.0, False, None)]
    put(tmp_path / "m.json", '{"test": ["b", "a"], "train": ["c"]}')
    assert [tuple(r) for r in readers.split_members(spark, str(tmp_path / "m.json"), "test").orderBy("place").collect()] == [("b", 0), ("a", 1)]
    assert [r.itemid for r in readers.split_members(spark, put(tmp_path / "m.csv", "itemid,split\nz,train\ny,test\n"), "test").collect()] == ["y"]
    put(tmp_path / "twice.json", '["a", "a"]')
    with pytest.raises(Exception, match="repeated member"):
        readers.split_members(spark, str(tmp_path / "twice.json"), "test").collect()
    assert readers.release_root("/r/", "corrected") == "/r"
    for bad in ((None, "corrected"), ("/r", "old")):
        with pytest.raises(ValueError):
            readers.release_root(*bad)
    (tmp_path / "kb" / "m").mkdir(parents=True)
    put(tmp_path / "kb" / "index.json", '{"modules": [{"module_id": "art3", "path": "m/a.md", "allowed_modes": ["strict"], "leakage_tier": "strict_safe"}, {"module_id": "none", "path": "m/z.md"}]}')
    put(tmp_path / "kb" / "m" / "a.md", "# A\ntext\n")
    assert {(r.module, r.text) for r in readers.knowledge_base(spark, f"file://{tmp_path}/kb").collect()} == {("art3", "# A\ntext\n"), ("none", None)}


def test_merge_plan_and_resume(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "id int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "c"), (4, None)], "id int, v string")
    assert {(r.id, r.action) for r in ingest.merge_actions(old, new, "id", ["v"]).collect()} == {(1, "kept"), (2, "updated"), (3, "added"), (4, "unchanged")}
    assert {(r.id, r.v) for r in ingest.merged(old, new, "id", ["v"], overwrite=True).collect()} == {(1, "a"), (2, "x"), (3, "c"), (4, None)}
    with pytest.raises(Exception, match="overwriting is off"):
        ingest.merged(old, new, "id", ["v"]).collect()
    log = spark.createDataFrame([(1, "success"), (2, "partial")], "id int, status string")
    assert {r.id for r in ingest.pending(old, log, "id").collect()} == {2, 4}


def test_streams_agree_with_batches(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = str(tmp_path / "in")
    events.union(events.limit(100)).repartition(3).write.parquet(source)
    read = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    unique = ingest.run_to_end(ingest.stream_unique(read(), "event_id", "ts", "3650 days"), spark, str(tmp_path / "u"), str(tmp_path / "uc"))
    assert unique.count() == unique.select("event_id").distinct().count() == events.count()
    again = ingest.run_to_end(ingest.stream_unique(read(), "event_id", "ts", "3650 days"), spark, str(tmp_path / "u"), str(tmp_path / "uc"))
    assert again.count() == events.count()
    path = ingest.upsert_stream(read(), "user_id", "ts", str(tmp_path / "v"), str(tmp_path / "vc"))
    want = events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    assert spark.read.parquet(path).select("user_id", "ts").exceptAll(want).count() == 0


def test_pages_and_downloads(spark, tmp_path):
    rows = [{"itemid": f"001-{i}", "rank": i * 3, "title": "é"} for i in range(5)]
    for start in (0, 2, 4):
        put(tmp_path / f"p{start}.json", json.dumps({"resultcount": 5, "results": [{"columns": r} for r in rows[start : start + 2]]}))
    got = web.paged(spark, f"file://{tmp_path}/p{{start}}.json", 2).orderBy("place").collect()
    assert [(r.itemid, r.place, r.total) for r in got] == [(f"001-{i}", i, 5) for i in range(5)] and json.loads(got[0].record) == {"itemid": "001-0", "title": "é"}
    for bad in (b'{"message": "x"}', b'{"resultcount": true, "results": []}', b'{"resultcount": 1, "results": [{"columns": {}}]}'):
        with pytest.raises(ValueError):
            web.page(bad)
    put(tmp_path / "d.html", "<!DOCTYPE html><html></html>")
    put(tmp_path / "e.html", "")
    wanted = spark.createDataFrame([("a", f"file://{tmp_path}/d.html"), ("b", f"file://{tmp_path}/e.html"), ("c", f"file://{tmp_path}/none.html")], "itemid string, url string")
    assert {(r.itemid, r.status, r.bytes) for r in web.downloads(wanted, "html").collect()} == {("a", "success", 28), ("b", "invalid", 0), ("c", "failed", 0)}
    assert web.valid_document(b"PK", "docx") and web.valid_document(b"x", "pdf") == "unknown kind pdf"
