"""Rules with literals: pixels, truth lines, run summaries, gates, stages on nulls, and boxes that meet."""

import random

from pyspark.sql import functions as F

from folioworks.functions import boxes as B
from folioworks.operators import annotations as A
from folioworks.operators import dataset as D
from folioworks.operators import plugins as P
from folioworks.operators import reading_order as O
from folioworks.operators import runs as R
from folioworks.sources import readers


def test_pixels(spark):
    r = spark.range(1).select(B.pixel_box(*(F.lit(x) for x in (10.0, 50.0, 25.0, 0.25)), F.lit(1250.0), F.lit(410.0)).alias("b")).head()["b"]
    assert tuple(r) == (125, 205, 438, 206)


def test_first_pages(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("a", 2), ("a", 10), ("c", 1)], "article string, page int")
    assert sorted(map(tuple, D.first_pages(rows, ["article", "page"], 3).collect())) == [("a", 2), ("a", 10), ("b", 1)]


def test_truth_lines_of_a_sheet(spark, tmp_path):
    (tmp_path / "s1.csv").write_text('no,text\n1,"first\n second \n\n"\n2,\n3,third\n')
    cells = readers.sheet_cells(spark, str(tmp_path / "s1.csv"), 2)
    chosen = spark.createDataFrame([("s1", 1)], "article_id string, truth_col int")
    assert [r["text"] for r in A.truth_lines(cells, chosen).orderBy("ord").collect()] == ["first", "second", "third"]


def test_run_summary_counts_failed_pages(spark):
    line = "array<struct<text:string,confidence:double>>"
    pages = spark.createDataFrame(
        [("r", 1, "completed", [("a", 0.5), ("b", None), ("c", 0.9)]), ("r", 2, "failed_timeout", None), ("r", 3, "failed_exception", []), ("s", 1, None, [])], f"run_id string, page int, status string, lines {line}"
    )
    got = {(r["run_id"], r["page"]): tuple(r)[2:] for r in R.ocr_run_summary(pages).collect()}
    assert got == {("r", 1): (1, 0, 3, 0.7, 1), ("r", 2): (1, 1, 0, None, 0), ("r", 3): (1, 1, 0, None, 0), ("s", 1): (1, 0, 0, None, 0), ("r", None): (3, 2, 3, 0.7, 1), ("s", None): (1, 0, 0, None, 0)}


def test_missing_gate_asks_for_review(spark):
    gates = spark.createDataFrame([(1, ("passed", "fine", True)), (2, ("flagged", "low", False)), (3, None)], "id int, g struct<status:string,reason:string,passed:boolean>")
    got = {r["id"]: tuple(r["x"]) for r in gates.select("id", R.gate_or_skipped(F.col("g")).alias("x")).collect()}
    assert got == {1: ("passed", "fine", False), 2: ("flagged", "low", True), 3: ("skipped", R.NO_GATE, True)}


def test_pages_of_an_article_are_joined_by_one_line_end(spark):
    lines = spark.createDataFrame([("r", 1, 1, "a"), ("r", 1, 2, "b"), ("r", 2, 1, ""), ("r", 3, 1, "c")], "run_id string, page int, ord int, text string")
    assert R.article_text(lines).head()["text"] == "a\nb\nc"


def test_text_stage_on_null_texts(spark):
    texts = spark.createDataFrame([(1, None), (2, "x")], "doc_id int, text string")
    got = {r["doc_id"]: (r["output"], r["status"], r["error"]) for r in P.text_stage(texts, lambda t: t.upper(), "s").collect()}
    assert got == {1: ("", "failed_empty_output", None), 2: ("X", "completed", None)}


def test_boxes_that_meet_and_no_others(spark):
    rnd = random.Random(3)
    rows = [(k, i, y := rnd.choice([0.0, rnd.uniform(0, 900)]), y + rnd.choice([0.0, 5.0, rnd.uniform(0, 60), 400.0])) for k in range(12) for i in range(rnd.randint(1, 30))]
    df = spark.createDataFrame(rows, "page_id int, idx int, y1 double, y2 double")
    got = sorted((r["page_id"], r["p"]["idx"], r["q"]["idx"]) for r in O._meeting(df, ["page_id"], ["idx", "y1", "y2"], "y1", "y2").collect())
    assert got == sorted((k, i, j) for k, i, a, b in rows for m, j, c, d in rows if k == m and i != j and min(b, d) > max(a, c))


def test_a_long_page_makes_few_pairs(spark):
    n = 20_000
    tall = spark.range(n).select(F.lit(1).alias("page_id"), F.col("id").cast("int").alias("idx"), (F.col("id") * 30.0).alias("y1"), (F.col("id") * 30.0 + 35).alias("y2"))
    tall = tall.unionByName(spark.createDataFrame([(1, -1, 0.0, n * 30.0)], "page_id int, idx int, y1 double, y2 double"))
    assert O._meeting(tall, ["page_id"], ["idx", "y1", "y2"], "y1", "y2").count() == 2 * (n - 1) + 2 * n
