"""Cases of the findings of round 3 on growth."""

import re

from pyspark.sql import functions as F

from folioworks.functions import scalars as S
from folioworks.operators import reading_order as O
from folioworks.operators import runs as R


def _optimised(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_answer_is_parsed_once(spark):
    good = '{"people":"A","places":[],"dates":[" "],"organizations":[],"themes":[],"key_claims":["x"]}'
    rows = spark.createDataFrame([(1, f"Here: {good}"), (2, None), (3, "{"), (4, "[1]"), (5, good.replace('["x"]', "[1, {}]")), (6, "{}")], "id int, r string")
    out = rows.select("id", S.validate_knowledge(F.col("r")).alias("k")).select("id", "k.valid", "k.reason", "k.fields")
    got = {r["id"]: r for r in out.collect()}
    assert [i for i in got if got[i]["valid"]] == [1]
    assert got[1]["fields"].asDict() == {"people": ["A"], "places": [], "dates": [], "organizations": [], "themes": [], "key_claims": ["x"]}
    assert {got[i]["reason"] for i in (2, 3, 4)} == {"response is not a JSON object"}
    assert got[5]["reason"] == "not a list of strings: key_claims" and got[6]["reason"].startswith("missing keys: people, places")
    chat = rows.select("id", S.message_text(F.col("r")).alias("m")).select("m.text", "m.error")
    for plan in (_optimised(out), _optimised(chat)):
        assert len(re.findall(r"(?i)parse_?json", plan)) == 1


def test_a_region_too_small_for_gutters_is_cut_once_and_gutters_need_no_join(spark, monkeypatch):
    rounds, cut = [], O._cut
    monkeypatch.setattr(O, "_cut", lambda *a: (rounds.append(1), cut(*a))[1])
    rows = [(1, 0, 300.0, 320.0), (1, 1, 100.0, 120.0), (1, 2, 200.0, 220.0), (2, 0, 0.0, 20.0), (3, 0, 10.0, 30.0), (3, 1, 12.0, 32.0)]
    boxes = spark.createDataFrame(rows, "page_id int, idx int, y1 double, y2 double").selectExpr("*", "100.0D + idx AS x1", "400.0D + idx AS x2", "1200.0D AS page_width")
    got = {(r["page_id"], r["idx"]): r["place"] for r in O.reading_order(boxes, ["page_id"]).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 0): 2, (2, 0): 0, (3, 1): 0, (3, 0): 1}
    assert len(rounds) == 1
    assert "Join" not in _optimised(O.gutters(boxes, ["page_id"], 8.0))


def test_article_lines_are_sorted_by_spark_and_joined_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 3, raising=False)
    rows = [(run, page, k, "" if k % 5 == 0 else f"{run}-{page}-{k}") for run in (1, 2) for page in (10, 9) for k in range(12, -1, -1)]
    lines = spark.createDataFrame([*rows, (3, 1, 1, ""), (4, 1, 7, "b"), (4, 1, 7, "a")], "run_id int, page int, n int, text string")
    out = R.article_text(lines.select("run_id", "page", F.struct("n").alias("ord"), "text"))
    want = {run: "\n".join(f"{run}-{page}-{k}" for page in (9, 10) for k in range(13) if k % 5) for run in (1, 2)} | {4: "a\nb"}
    assert {r["run_id"]: r["text"] for r in out.collect()} == want
    assert "Window" in _optimised(out)  # no array of all lines of a page is sorted
