"""Every reader on files it should and should not take, and every writer read back."""

import json

import pytest
from pyspark.sql import functions as F

from folioworks.operators import annotations as A
from folioworks.operators import dataset as D
from folioworks.operators import metrics as M
from folioworks.operators import plugins as P
from folioworks.sources import readers as R
from folioworks.sources import writers as W


def put(tmp_path, name, value):
    path = tmp_path / name
    path.write_bytes(value if isinstance(value, bytes) else (value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)).encode())
    return str(path)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def test_ocr_texts(spark, tmp_path):
    put(tmp_path, "a_qwen.txt", "=== Jawi ===\nايبو\nڤد\n=== Metadata ===\nPage No: 3\n")
    put(tmp_path, "b.txt", "plain text")
    put(tmp_path, "c.txt", "x\n=== Metadata ===\nProvider: Kraken\n")
    got = {r["source_file"].rsplit("/", 1)[1]: r for r in R.ocr_texts(spark, str(tmp_path)).collect()}
    assert (got["a_qwen.txt"]["ocr_provider"], got["a_qwen.txt"]["ocr_jawi_text"], got["a_qwen.txt"]["metadata"]) == ("qwen-fixture", "ايبو\nڤد", {"page_no": "3"})
    assert got["b.txt"]["ocr_provider"] == "text-fixture" and got["c.txt"]["ocr_provider"] == "kraken"


def test_ocr_records(spark, tmp_path):
    good = put(tmp_path, "a.json", {"source_file": "p.png", "ocr_provider": "t", "ocr_jawi_text": " ايبو\n", "metadata": {"k": "v"}})
    bare = put(tmp_path, "b.json", {"source_file": "q.png", "ocr_provider": "t", "ocr_jawi_text": "x"})
    got = rows(R.ocr_records(spark, [good, bare]))
    assert got == [("p.png", "t", "ايبو", {"k": "v"}), ("q.png", "t", "x", {})]
    with pytest.raises(Exception, match="record without"):
        R.ocr_records(spark, put(tmp_path, "c.json", {"source_file": "q.png", "ocr_provider": "t"})).collect()


def test_pairs_and_phrases(spark, tmp_path):
    words = put(tmp_path, "w.json", [["pada", "ڤد"], ["x"], ["a", "b", "c"]])
    assert [tuple(r) for r in R.word_pairs(spark, words).orderBy("ord").collect()] == [(["pada", "ڤد"], 0), (["x"], 1), (["a", "b", "c"], 2)]
    r, j = put(tmp_path, "r.json", {"train": ["ibu pada", "satu"], "test": ["z"]}), put(tmp_path, "j.json", {"train": ["ايبو ڤد", "ساتو"]})
    assert rows(R.phrase_pairs(spark, r, j)) == [("ibu pada", "ايبو ڤد", 0), ("satu", "ساتو", 1)]
    with pytest.raises(Exception, match="differ in length"):
        R.phrase_pairs(spark, r, put(tmp_path, "k.json", {"train": ["only"]})).collect()
    both = tmp_path / "many"
    both.mkdir()
    put(both, "1.json", {"train": ["a"]}), put(both, "2.json", {"train": ["b"]})
    with pytest.raises(Exception, match="one file"):
        R.phrase_pairs(spark, str(both), j).collect()


def test_lines_ratings_and_events(spark, tmp_path):
    lines = put(tmp_path, "e.jsonl", '{"id": "1", "reference": "a"}\n\n{"id": "2", "reference": "b"}\n')
    assert rows(R.json_lines(spark, lines, "id string, reference string")) == [("1", "a"), ("2", "b")]
    sheet = put(tmp_path, "r.csv", "item_id,rater,adequacy,fluency\ni1,r1,4,3\ni1,r2,3,3\n")
    s = M.rubric_summary(R.ratings(spark, sheet)).first()
    assert (s["ratings"], s["items"], s["raters"], s["adequacy_mean"]) == (2, 1, "r1,r2", 3.5)
    folder = tmp_path / "log"
    folder.mkdir()
    put(folder, "1.json", '{"run_id": "a", "seq": 0, "ts": "2024-01-01T00:00:00Z", "type": "stage", "agent": "ocr", "status": "completed"}\n')
    stream = R.events(spark, str(folder))
    assert stream.isStreaming
    stream.writeStream.format("memory").queryName("log_rows").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("log_rows"), "run_id", "seq", "status") == [("a", 0, "completed")]


TASKS = [
    {"id": 1, "data": {"image": "x"}, "annotations": [{"was_cancelled": False, "updated_at": "2024-01-02", "result": [{"id": "r1", "type": "rectangle", "value": {"x": 10, "y": 10, "width": 20, "height": 5}}]}]},
    {"id": 2, "data": {"article_id": "a", "page_index": 0}, "annotations": [
        {"was_cancelled": True, "updated_at": "2024-03-01", "result": []},
        {"was_cancelled": False, "updated_at": "2024-02-01", "created_at": "2024-01-01", "result": [
            {"id": "b1", "type": "rectangle", "value": {"x": 1, "y": 2, "width": 3, "height": 4}}, {"id": "b1", "type": "textarea", "value": {"text": ["فد"]}}, {"id": "b2", "type": "rectangle", "value": {"x": 5, "y": 6, "width": 7, "height": 8}}]},
        {"was_cancelled": False, "created_at": "2024-01-15", "result": []}]},
]


def test_annotation_export(spark, tmp_path):
    tasks = R.annotation_tasks(spark, put(tmp_path, "t.json", TASKS))
    latest = tasks.select("id", "data.article_id", "data.page_index", A.latest_annotation(F.col("annotations")).alias("a"))
    assert rows(latest, "id", "a.updated_at") == [(1, "2024-01-02"), (2, "2024-02-01")]
    known, unknown = A.split_by_metadata(latest, ["article_id", "page_index"])
    assert rows(known, "id") == [(2,)] and rows(unknown, "id") == [(1,)]
    given = spark.createDataFrame([(1, "1950_11_002", 0)], "id long, article_id string, page_index int")
    assert rows(A.split_by_metadata(latest, ["article_id", "page_index"], given)[0], "id", "article_id") == [(1, "1950_11_002"), (2, "a")]
    regions = F.transform("a.result", lambda r: F.struct(r["id"].alias("id"), r["type"].alias("type"), r["value"]["x"].alias("x"), r["value"]["y"].alias("y"), r["value"]["width"].alias("width"), r["value"]["height"].alias("height"), F.array_join(r["value"]["text"], "").alias("text")))
    lines = known.select("id", F.explode(A.region_lines(regions)).alias("l")).select("id", "l.line_index", "l.box.x", "l.text")
    assert rows(lines) == [(2, 1, 1.0, "فد"), (2, 2, 5.0, "")]
    assert A.complete_pages(lines, ["id"]).count() == 0 and A.complete_pages(lines.filter("line_index = 1"), ["id"]).count() == 1
    with pytest.raises(Exception, match="without text"):
        A.complete_pages(lines, ["id"], fail=True).collect()


def test_annotation_rows_and_sheets(spark, tmp_path):
    path = put(tmp_path, "a.csv", "article_id,page_index,line_index,x,y,w,h\nb,0,1,1.9,2,3,4\na,1,2,1,2,3,4\na,0.0,10,1,2,3,4\na,0,9,1,2,3,4\n")
    assert [tuple(r)[:4] for r in R.annotation_rows(spark, path).collect()] == [("a", 0, 9, 1), ("a", 0, 10, 1), ("a", 1, 2, 1), ("b", 0, 1, 1)]
    put(tmp_path, "1950_01_001.csv", 'Jawi,Rumi\n"ايبو, ڤد",ibu\n,\nx,\n')
    cells = R.sheet_cells(spark, str(tmp_path / "1950_01_001.csv"), 2)
    assert ("1950_01_001", 1, 0, "ايبو, ڤد") in rows(cells) and ("1950_01_001", 3, 0, "x") in rows(cells)


def test_orders_uploads_pages_and_words(spark, tmp_path):
    assert rows(R.reading_orders(spark, put(tmp_path, "o.json", {"a_p00": [1, 0], "a_p01": []}))) == [("a_p00", [1, 0]), ("a_p01", [])]
    assert R.reading_orders(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(Exception, match="not an object"):
        R.reading_orders(spark, put(tmp_path, "bad.json", "[1]x")).collect()
    assert rows(R.locked_articles(spark, put(tmp_path, "l.json", ["x", "y"]))) == [("x",), ("y",)]
    up = tmp_path / "up"
    up.mkdir()
    put(up, "a.bin", b"%PDF-1.7"), put(up, "b.bin", b"\x89PNG\r\n\x1a\nxx"), put(up, "c.bin", b"\xff\xd8\xff\xe0"), put(up, "d.bin", b"%PDF"), put(up, "e.bin", b"II*\x00")
    assert rows(R.uploads(spark, str(up)), "document", "file_type") == [("a", "pdf"), ("b", "png"), ("c", "jpg"), ("d", None), ("e", None)]
    page = put(tmp_path, "p.json", {"run_id": "r", "page": 1, "status": "completed", "lines": [{"text": "a", "box": [1, 2, 3, 4], "confidence": 0.5, "order": 0}]})
    assert R.ocr_pages(spark, page).select(F.explode("lines").alias("l")).select("l.text", "l.confidence").first() == ("a", 0.5)
    table = spark.createDataFrame([(1, ["a", "b"], [90.0, -1.0], [1, 1], [1, 1], [1, 1], [1, 5], [1, 1], [3, 3], [2, 2])], "page_id long, text array<string>, conf array<double>, block_num array<int>, par_num array<int>, line_num array<int>, left array<int>, top array<int>, width array<int>, height array<int>")
    assert rows(R.ocr_words(table), "seq", "text", "conf") == [(0, "a", 90.0), (1, "b", -1.0)]
    assert rows(D.confident(R.ocr_words(table), 0.35), "text") == [("a",)]


def test_writers_read_back(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    lex, report = spark.createDataFrame([("ڤد", "pada", 3)], "jawi string, rumi string, n long"), spark.createDataFrame([(1,)], "entries long")
    W.lexicon(lex, report, at("lex"))
    assert rows(spark.read.parquet(at("lex/lexicon"))) == [("ڤد", "pada", 3)] and spark.read.json(at("lex/report")).first()[0] == 1
    W.cases(spark.createDataFrame([("a", "known", "f"), ("b", "unknown", "f")], "word string, status string, source_file string"), at("cases"))
    assert rows(spark.read.json(at("cases")), "word", "source_file") == [("b", "f")]
    lines = spark.createDataFrame([("a", 0, 1, "x.png", "t,\"1\"", "train"), ("b", 0, 1, "y.png", "t2", "val")], "article_id string, page_index int, line_index int, file_name string, text string, split string")
    W.by_split(lines, at("split"))
    assert rows(spark.read.csv(at("split"), header=True, escape='"'), "split", "article_id") == [("train", "a"), ("val", "b")]
    W.by_article(lines, at("crops"))
    back = spark.read.csv(at("crops"), header=True, escape="\\")
    assert rows(back, "article_id", "file_name", "text") == [("a", "x.png", 't,"1"'), ("b", "y.png", "t2")]
    W.replace_pages(lines.select("article_id", "page_index", "text"), at("pages"))
    W.replace_pages(spark.createDataFrame([("a", 0, "new")], "article_id string, page_index int, text string"), at("pages"))
    assert rows(spark.read.parquet(at("pages")), "article_id", "text") == [("a", "new"), ("b", "t2")]
    boxes = spark.createDataFrame([("a", 0, 1, 10.0, 20.0, 20.0, 40.0, "train"), ("a", 0, 2, 0.0, 0.0, 0.0, 5.0, "train"), ("b", 1, 1, 0.0, 0.0, 100.0, 100.0, "val")], "article_id string, page_index int, line_index int, x double, y double, width double, height double, split string")
    labels = D.detector_labels(boxes, ["split", "article_id", "page_index"])
    W.detector_labels(labels, at("labels"))
    assert rows(spark.read.text(at("labels")), "split", "value") == [("train", "0 0.200000 0.400000 0.200000 0.400000"), ("val", "0 0.500000 0.500000 1.000000 1.000000")]
    summary = D.export_summary(boxes, ["article_id", "page_index"], spark.createDataFrame([("z",)], "article_id string"))
    assert rows(summary) == [("excluded", 0, 0, ["z"]), ("train", 1, 1, ["a"]), ("val", 1, 1, ["b"])]
    W.tasks(spark.createDataFrame([('{"id":1}',)], "task string"), at("tasks"))
    assert spark.read.json(at("tasks")).first()[0] == 1
    W.evaluation(lines.select("article_id", "page_index"), lines.select("text"), report, at("eval"))
    assert spark.read.csv(at("eval/pages"), header=True).count() == 2 and spark.read.json(at("eval/predictions")).count() == 2 and spark.read.json(at("eval/report")).count() == 1
    runs = spark.createDataFrame([("r1", "2024-01-02 03:04:05", "sum")], "run_id string, finished_at string, summary string").withColumn("finished_at", F.to_timestamp("finished_at"))
    W.pipeline_results(runs, at("runs"), ("summary",))
    assert str(spark.read.parquet(at("runs/runs")).first()["run_date"]) == "2024-01-02" and spark.read.json(at("runs/summary")).first()["text"] == "sum"
    W.original(report, at("once"))
    with pytest.raises(Exception, match="(?i)already exists"):
        W.original(report, at("once"))
    W.original(spark.createDataFrame([(7,)], "entries long"), at("once"), overwrite=True)
    assert spark.read.parquet(at("once")).first()[0] == 7
    W.stamped(report, at("stamped"))
    assert spark.read.json(at("stamped")).first()["generated_at"]
    W.order_template(lines.select(F.concat_ws("_", "article_id", "page_index").alias("page_key")), "page_key", at("orders"))
    assert rows(spark.read.json(at("orders")), "page_key", "order") == [("a_0", [0]), ("b_0", [0])]
    assert rows(D.page_boxes(boxes)) == [("a", 1, 2, [(0, 2)]), ("b", 1, 1, [(1, 1)])]


def test_pairing_and_plug_ins(spark):
    h, r = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, hypothesis string"), spark.createDataFrame([("1", "x"), ("2", "y")], "id string, reference string")
    assert rows(M.paired(h, r)) == [("1", "a", "x"), ("2", "b", "y")]
    with pytest.raises(Exception, match="do not align"):
        M.paired(h, r.filter("id = '1'")).collect()
    pages = spark.createDataFrame([("d", 1, bytearray(b"one\ntwo")), ("d", 2, bytearray(b""))], "document string, page int, content binary")
    read = P.recognise_pages(pages, lambda content: [(t, None if t == "two" else 0.9) for t in content.decode().split("\n") if t])
    assert rows(read, "document", "page", "ord", "text", "confidence") == [("d", 1, 1, "one", 0.9), ("d", 1, 2, "two", None)]
    stages = {s: spark.range(1).select(P.stand_in(s, F.lit("ايبو")).alias("o")).first()["o"] for s in ("romanise", "translate", "summarise", "extract")}
    assert all(stages.values())
