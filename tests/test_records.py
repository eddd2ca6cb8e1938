"""Records that span lines, and records that are rejected."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from folioworks.functions import text as X
from folioworks.sources import readers as R
from folioworks.sources import records as C


def put(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_cells_of_several_lines(spark, tmp_path):
    text = 'head,"col ""x"""\r\n"line one\nline two",x\r\n\r\n"a, b",\r\n"","end\r\n\r\nof it"\r\nplain,"tail\n'
    path = put(tmp_path / "1950_01_001.csv", text[: text.rindex('plain,')])
    got = {(r["row"], r["col"]): r["value"] for r in R.sheet_cells(spark, path, 2).collect()}
    assert got == {(0, 0): "head", (0, 1): 'col "x"', (1, 0): "line one\nline two", (1, 1): "x", (3, 0): "a, b", (4, 1): "end\n\nof it"} | {k: v for k, v in got.items() if k == (4, 0) and v == ""}
    cells = R.sheet_cells(spark, path, 2).filter("row = 1 and col = 0").select(X.cell_lines(F.col("value")).alias("lines"))
    assert cells.head()["lines"] == ["line one", "line two"]
    assert R.sheet_rejects(spark, path).count() == 0


@pytest.mark.parametrize("size", [64, 1000])
def test_records_of_split_files_equal_the_csv_module(spark, tmp_path, size):
    rnd = random.Random(size)
    cell = lambda: "".join(rnd.choice(["a", "b ", ",", '"', "\n", "ü", ""]) for _ in range(rnd.randint(0, 12)))
    want = {}
    for name in ("one", "two"):
        rows = [[f"k{k}", cell(), cell()] for k in range(150)]
        out = io.StringIO()
        csv.writer(out, lineterminator=rnd.choice(["\n", "\r\n"])).writerows(rows)
        put(tmp_path / f"{name}.csv", "﻿" * (name == "two") + out.getvalue())
        want |= {(name, k): rows[k] for k in range(150)}
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        records, bad = C.csv_records(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        got = {(r["file"].rsplit("/", 1)[1][:3], r["record"]): next(csv.reader(io.StringIO(r["value"], newline=""))) for r in records.collect()}
        cells = {}
        for r in R.sheet_cells(spark, str(tmp_path), 3).collect():
            cells.setdefault((r["article_id"], r["row"]), ["", "", ""])[r["col"]] = r["value"]
        assert bad.count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    assert got == want
    assert cells == want


def test_open_quotes_are_rejected(spark, tmp_path):
    put(tmp_path / "bad.csv", 'a,"b\nc,d\n')
    put(tmp_path / "good.csv", "a,b\n")
    put(tmp_path / "empty.csv", "")
    assert {r["article_id"] for r in R.sheet_cells(spark, str(tmp_path), 2).collect()} == {"good"}
    assert [(r["file"].rsplit("/", 1)[1], r["reason"]) for r in R.sheet_rejects(spark, str(tmp_path)).collect()] == [("bad.csv", "a quote is left open")]


def told(df):
    return sorted((r["file"].rsplit("/", 1)[1], r["reason"], r["value"]) for r in df.collect())


def test_rejected_json_lines(spark, tmp_path):
    path = put(tmp_path / "e.jsonl", '{"id": "1", "n": 2}\n\n{broken\n{"id": "2", "n": "two"}\n  \n{"n": 3}\n[1]\n{"id": "4"}\n')
    schema = "id string, n int"
    assert [tuple(r) for r in R.json_lines(spark, path, schema, ("id",)).collect()] == [("1", 2), ("4", None)]
    assert told(R.json_line_rejects(spark, path, schema, ("id",))) == [("e.jsonl", "no JSON", "{broken"), ("e.jsonl", "not of the schema", "[1]"), ("e.jsonl", "not of the schema", '{"id": "2", "n": "two"}'), ("e.jsonl", "without id", '{"n": 3}')]


def test_rejected_tasks_and_pages(spark, tmp_path):
    (tmp_path / "t").mkdir()
    put(tmp_path / "t" / "a.json", '[{"id": 1, "data": {"article_id": "x"}}, {"data": {}},\n {"id": "z"}]')
    put(tmp_path / "t" / "b.json", '[{"id": 1}')
    put(tmp_path / "t" / "c.json", '{"id": 2}')
    assert sorted((r["id"], r["data"] and r["data"]["article_id"]) for r in R.annotation_tasks(spark, str(tmp_path / "t")).collect()) == [(1, "x"), (2, None)]
    assert [r[:2] for r in told(R.annotation_task_rejects(spark, str(tmp_path / "t")))] == [("a.json", "not of the schema"), ("a.json", "without id"), ("b.json", "no JSON")]
    (tmp_path / "p").mkdir()
    put(tmp_path / "p" / "1.json", '{"run_id": "r",\n "page": 1, "lines": [{"text": "a", "confidence": 0.5}]}')
    put(tmp_path / "p" / "2.json", '{"run_id": "r", "page": ')
    put(tmp_path / "p" / "3.json", '{"run_id": "r"}')
    assert [r["lines"][0]["text"] for r in R.ocr_pages(spark, str(tmp_path / "p")).collect()] == ["a"]
    assert [r[:2] for r in told(R.ocr_page_rejects(spark, str(tmp_path / "p")))] == [("2.json", "no JSON"), ("3.json", "without page")]
